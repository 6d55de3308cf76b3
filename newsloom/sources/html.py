"""Article text and news links out of landed pages.

Tag soup needs a tolerant parser, which Spark has not, so the page column alone is
parsed with the standard library's in Arrow batches. Splitting, reflowing, filtering,
capping and everything after stay in Spark. Pages that cannot hold what is looked for
are emptied before they leave the JVM.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsloom.constants import LINK_CLASS, ORG_CLASS
from newsloom.functions.text import cut_story, reflow

# Elements of HTML that have no end tag, and elements whose text is not
# part of the readable page.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
SILENT_TAGS = frozenset("script style template rt rp".split())
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


class _RootClosed(Exception):
    pass


class _RootText(HTMLParser):
    """Text nodes of the first ``root`` element, one list entry per node."""

    def __init__(self, root: str):
        super().__init__(convert_charrefs=False)
        self.root = root
        self.open: list[str] = []
        self.open_count: Counter[str] = Counter()
        self.void_closed: Counter[str] = Counter()
        self.root_at: int | None = None
        self.silent_at: int | None = None
        self.node: list[str] = []
        self.nodes: list[str] = []

    def end_node(self):
        text = "".join(self.node).strip()
        self.node.clear()
        if text:
            self.nodes.append(text)

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag in VOID_TAGS:
            self.void_closed[tag] += 1
            return
        if self.root_at is None and tag == self.root:
            self.root_at = len(self.open)
        elif self.silent_at is None and tag in SILENT_TAGS:
            self.silent_at = len(self.open)
        self.open.append(tag)
        self.open_count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS:
            self.end_node()
        else:
            self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.void_closed[tag]:
            # Its start tag has ended the text node.
            self.void_closed[tag] -= 1
            return
        self.end_node()
        if not self.open_count[tag]:
            return
        closed = None
        while closed != tag:
            closed = self.open.pop()
            self.open_count[closed] -= 1
        if self.silent_at is not None and len(self.open) <= self.silent_at:
            self.silent_at = None
        if self.root_at is not None and len(self.open) <= self.root_at:
            raise _RootClosed

    def handle_data(self, data):
        if self.root_at is not None and self.silent_at is None:
            self.node.append(data)

    def handle_charref(self, name):
        digits = name[1:] if name[0] in "xX" else name
        try:
            code = int(digits, 16 if digits is not name else 10)
            # Numbers below 256 are read in the encoding browsers assume for them.
            text = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
        except UnicodeDecodeError:
            text = chr(code)
        except (ValueError, OverflowError):
            text = REPLACEMENT
        self.handle_data(REPLACEMENT if "\ud800" <= text <= "\udfff" else text)

    def handle_entityref(self, name):
        self.handle_data(html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.end_node()
        if data.upper().startswith("CDATA["):
            self.handle_data(data[len("CDATA["):])
            self.end_node()


def root_text(html: str | None, root: str) -> str | None:
    if html is None:
        return None
    parser = _RootText(root)
    try:
        parser.feed(html)
        parser.close()
        parser.end_node()
    except _RootClosed:
        pass
    except AssertionError:
        # The standard parser's way to refuse a malformed declaration: no readable page.
        return None
    return None if parser.root_at is None else "\n".join(parser.nodes)


class _ChartLinks(HTMLParser):
    """Anchors and the organisation of a chart page, told by their class."""

    def __init__(self, link_class: str | None, org_class: str, title_attr: str | None):
        super().__init__()
        self.link_class, self.org_class, self.title_attr = link_class, org_class, title_attr
        self.links: list[list[str | None]] = []
        self.reading = False
        self.org_seen = False
        self.org: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            values = _attributes(attrs)
            self.reading = self.link_class is None or _has_class(values, self.link_class)
            if self.reading:
                title = values.get(self.title_attr) if self.title_attr else ""
                self.links.append([values.get("href"), title])
        elif tag == "div" and not self.org_seen:
            values = _attributes(attrs)
            if _has_class(values, self.org_class):
                self.org_seen, self.org = True, values.get("title")

    def handle_endtag(self, tag):
        if tag == "a":
            self.reading = False

    def handle_data(self, data):
        if self.reading and not self.title_attr:
            self.links[-1][1] += data


def _attributes(attrs: list[tuple[str, str | None]]) -> dict[str, str]:
    return {name: value or "" for name, value in attrs}


def _has_class(values: dict[str, str], wanted: str) -> bool:
    """The whole class list reads like ``wanted``, or one of its entries is ``wanted``."""
    classes = values.get("class", "").split()
    return " ".join(classes) == wanted or wanted in classes


LINKS = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()),
    T.StructField("title", T.StringType()),
]))
ARROW_TYPES = {
    T.StringType(): pa.string(),
    LINKS: pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("title", pa.string())])),
}


def _replace_column(
    df: DataFrame, column: str, fields: dict[str, T.DataType],
    parse: Callable[[str | None], tuple],
) -> DataFrame:
    """``df`` with ``column`` replaced by the fields that ``parse`` makes of its text."""
    kept = [name for name in df.columns if name != column]
    added = T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])
    schema = T.StructType([*df.select(*kept).schema.fields, *added.fields])
    types = [ARROW_TYPES[dtype] for dtype in fields.values()]
    names = [*kept, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(text.as_py()) for text in batch.column(column)]
            parsed = [
                pa.array([row[i] for row in rows], type=dtype) for i, dtype in enumerate(types)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + parsed, names=names
            )

    return df.mapInArrow(run, schema)


def page_text(pages: DataFrame, root: str = "main", html: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by ``text``: the text nodes of the first ``root``, one
    per line, or NULL without such an element."""
    candidate = F.when(F.col(html).rlike(f"(?i)<{root}"), F.col(html))
    return _replace_column(
        pages.withColumn(html, candidate), html, {"text": T.StringType()},
        lambda page: (root_text(page, root),),
    )


def readable(text: Column) -> Column:
    """Page text up to the story break, reflowed; an empty text gives one blank."""
    return reflow(cut_story(text))


def article_text(pages: DataFrame, root: str = "main", html: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by the readable ``text`` of the first ``root``."""
    return page_text(pages, root, html).withColumn("text", readable(F.col("text")))


def chart_links(
    pages: DataFrame, html: str = "html", link_class: str | None = LINK_CLASS,
    org_class: str = ORG_CLASS, title_attr: str | None = "title",
) -> DataFrame:
    """``pages`` with ``html`` replaced by ``org`` and ``links``, still one row per page.

    ``links`` holds (pos, href, title) in document order. ``link_class`` None takes every
    anchor, ``title_attr`` None the anchor's text for its title.
    """
    def parse(page: str | None):
        found = _ChartLinks(link_class, org_class, title_attr)
        try:
            found.feed(page or "")
            found.close()
        except AssertionError:
            return None, []
        links = [
            {"pos": pos, "href": href, "title": title}
            for pos, (href, title) in enumerate(found.links)
        ]
        return found.org, links

    return _replace_column(pages, html, {"org": T.StringType(), "links": LINKS}, parse)


def link_rows(pages: DataFrame) -> DataFrame:
    """One row per link of each page."""
    others = [name for name in pages.columns if name != "links"]
    return pages.select(*others, F.inline("links"))
