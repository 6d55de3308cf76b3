"""Link lists of a page: array expressions, so no row leaves its task for them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.constants import NEWS_DOMAIN
from newsloom.functions.predicates import news_link


def news_links(links: Column, domain: str = NEWS_DOMAIN) -> Column:
    """The (pos, href, title) entries that point to news and have a title."""
    return F.filter(links, lambda link: news_link(link["href"], link["title"], domain))


def capped_links(links: Column, max_links: int | None = None) -> Column:
    """The first ``max_links`` entries, or all, then one entry per href.

    The cap counts repeated hrefs; each keeps its first position and its last title.
    """
    head = links if max_links is None else F.slice(links, 1, max_links)

    def merged(href: Column) -> Column:
        same = F.filter(head, lambda link: link["href"] == href)
        return F.struct(
            F.get(same, F.lit(0))["pos"].alias("pos"), href.alias("href"),
            F.element_at(same, -1)["title"].alias("title"),
        )

    return F.transform(F.array_distinct(head["href"]), merged)
