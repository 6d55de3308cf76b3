"""Requests to news: from asked tickers to articles, snapshots and the next stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.constants import LINK_CLASS, NEWS_DOMAIN, ORG_CLASS, SNAPSHOT_TTL_HOURS
from newsloom.functions.links import capped_links, news_links
from newsloom.functions.predicates import expired
from newsloom.functions.status import news_ready
from newsloom.operators.lookups import attach_pages, known_urls, snapshot_lookup
from newsloom.operators.records import child_seq, new_articles, new_snapshots, new_status
from newsloom.operators.spread import spread_join
from newsloom.session import materialise
from newsloom.sources.html import chart_links
from newsloom.sources.pages import newest_pages


@dataclass(frozen=True)
class ChartLayout:
    """How links and the organisation are told on a chart page, and how many links to take."""

    link_class: str | None = LINK_CLASS
    org_class: str = ORG_CLASS
    title_attr: str | None = "title"
    domain: str = NEWS_DOMAIN
    max_links: int | None = None


@dataclass(frozen=True)
class Ingested:
    """New rows of each table, and the requests of the next stage."""

    snapshots: DataFrame
    articles: DataFrame
    status: DataFrame
    requests: DataFrame


def ticker_news(
    requests: DataFrame, snapshots: DataFrame, chart_pages: DataFrame,
    as_of: datetime | Column, ttl_hours: int = SNAPSHOT_TTL_HOURS,
    layout: ChartLayout = ChartLayout(),
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """Each asked ticker once: (ticker, seq, renewed, org, links).

    A fresh snapshot gives its stored urls; otherwise the newest landed chart page is
    read. Tickers with neither drop out. ``seq`` is the first request's.
    """
    asked = requests.groupBy("ticker").agg(F.min("seq").alias("seq"))
    known = snapshot_lookup(requests, snapshots, as_of, ttl_hours).drop("expired")
    known = keep(known.join(asked, "ticker"))
    is_stale = expired(F.col("time_created"), as_of, ttl_hours)
    stored = F.transform("url_keys", lambda url, pos: F.struct(
        pos.alias("pos"), url.alias("href"), F.lit("").alias("title")
    ))
    fresh = known.filter(~is_stale).select(
        "ticker", "seq", F.lit(False).alias("renewed"), "org", stored.alias("links")
    )
    stale = known.filter(is_stale).select("ticker", "seq")
    newest = newest_pages(chart_pages, stale, ["ticker"])
    read = chart_links(
        newest, link_class=layout.link_class, org_class=layout.org_class,
        title_attr=layout.title_attr,
    )
    links = capped_links(news_links(F.col("links"), layout.domain), layout.max_links)
    renewed = read.withColumn("links", links).select(
        "ticker", "seq", F.lit(True).alias("renewed"), "org", "links"
    )
    return fresh.unionByName(renewed)


def ingest(
    requests: DataFrame, snapshots: DataFrame, chart_pages: DataFrame, news_pages: DataFrame,
    articles: DataFrame, as_of: datetime | Column, ttl_hours: int = SNAPSHOT_TTL_HOURS,
    layout: ChartLayout = ChartLayout(),
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> Ingested:
    """One pass over crawl requests (seq, job_id, ticker).

    Tickers are worked on once however many jobs ask for them, and the result goes back
    to every job. Several outputs come from the parsed pages, hence ``keep``.
    """
    news = keep(ticker_news(requests, snapshots, chart_pages, as_of, ttl_hours, layout, keep))
    renewed = news.filter("renewed")
    found = keep(
        renewed.select("seq", F.posexplode("links").alias("n", "link"))
        .select(child_seq(F.col("seq"), F.col("n")).alias("seq"), "link.href", "link.title")
        .groupBy(F.col("href").alias("url"))
        .agg(F.min_by("title", "seq").alias("title"), F.min("seq").alias("seq"))
    )
    unknown = attach_pages(found, news_pages).join(known_urls(found, articles), "url", "left_anti")
    urls = F.col("links")["href"]
    answered = spread_join(
        requests.select("seq", "job_id", "ticker"),
        news.select("ticker", "org", urls.alias("urls")), ["ticker"], "inner", spread_by=["seq"],
    )
    status = answered.select(child_seq(F.col("seq"), F.lit(0)).alias("seq"), "job_id")
    return Ingested(
        snapshots=new_snapshots(
            renewed.select(
                child_seq(F.col("seq"), F.lit(0)).alias("seq"), "ticker", "org",
                urls.alias("url_keys"),
            ),
            as_of,
        ),
        articles=new_articles(unknown, as_of),
        status=new_status(status, news_ready(F.col("job_id")), as_of),
        requests=answered.select("seq", "job_id", "urls", "ticker", "org"),
    )
