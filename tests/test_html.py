"""Article text and chart links on hand-written pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom.functions.links import capped_links, news_links
from newsloom.sources.html import article_text, chart_links, link_rows, root_text

DOMAIN = "https://sg.finance.yahoo.com/news/"
LINK = "subtle-link fin-size-small titles noUnderline yf-1btaiiq"


@pytest.mark.parametrize("page, nodes", [
    ("<p>no root</p>", None),
    ("<main></main>", ""),
    ("<main/>text", ""),
    ("<MAIN>a</MAIN>", "a"),
    ("<main><script>var a = '</p>';</script>a<style>p{}</style>b</main>", "a\nb"),
    ("<main>A &amp; B &#65; &copy</main>", "A & B A ©"),
    ("<main>a &unknown; b</main>", "a &unknown b"),
    ("<main>&#150; &#xD800;</main>", "– �"),
    ("<main>one<!-- hidden -->two</main>", "one\ntwo"),
    ("<main>a<p>b<p>c</main>d", "a\nb\nc"),
    ("<div><main>a<p>b</div>c</main>", "a\nb"),
    ("<main>a</main><main>b</main>", "a"),
    ("<main>a<main>b</main>c</main>d", "a\nb\nc"),
    ("<main>a</span>b</main>", "a\nb"),
    ("<main>a<br>b<br/>c<br></br>d</main>", "a\nb\nc\nd"),
    ("<main> \n <b> x </b> </main>", "x"),
    ("<main>a<template>t<b>u</b></template><ruby>k<rt>r</rt></ruby></main>", "a\nk"),
    ("<!-- <main>no</main> --><main>yes", "yes"),
    ("<script>'<main>no</main>'</script><main>yes</main>", "yes"),
    ("<main>a <b>bold", "a\nbold"),
    ("<main>a<br>b<br/>c<br/>d</br>e</main>", "a\nb\nc\nd\ne"),
    ("<main>a<![CDATA[b]]>c</main>", "a\nb\nc"),
    ("<main>a<![nonsense]>b</main>", None),
    ("<main>&#0;&#999999999999;</main>", "\x00\ufffd"),
])
def test_root_text(page, nodes):
    assert root_text(page, "main") == nodes


def test_article_text_reflows(spark):
    pages = {
        "none": "<p>x</p>", "empty": "<main></main>", "null": None,
        "lines": "<main><p>A long first line</p><b>)</b><i>123456789</i><p>1234567890</p></main>",
        "cut": "<main>The beginning of it<p>Story continues</p>rest Story continues</main>",
    }
    rows = spark.createDataFrame(list(pages.items()), "id string, html string")
    found = {r.id: r.text for r in article_text(rows).collect()}
    assert found == {
        "none": None, "empty": " ", "null": None,
        "lines": "\nA long first line ) 123456789\n1234567890",
        "cut": "\nThe beginning of it ",
    }


def anchor(href, title, css=LINK):
    attributes = "".join(
        f' {name}="{value}"' for name, value in (("class", css), ("href", href), ("title", title))
        if value is not None
    )
    return f"<a{attributes}>text</a>"


def links_of(spark, page, **options):
    parsed = chart_links(spark.createDataFrame([("p", page)], "id string, html string"), **options)
    return parsed, parsed.select(
        capped_links(news_links(F.col("links")), 5).alias("links"), "org"
    ).head()


def test_unfit_links_are_dropped(spark):
    page = "".join([
        anchor(DOMAIN + "a", None), anchor(None, "no href"), anchor(DOMAIN + "b", ""),
        anchor("https://elsewhere/news/c", "other"), anchor(DOMAIN + "d", "wrong class", "x"),
        anchor(DOMAIN + "e", "A &amp; B"), anchor(DOMAIN + "f", "spaced", f"  {LINK} "),
        anchor(DOMAIN + "g", "reordered", " ".join(reversed(LINK.split()))),
    ])
    _, row = links_of(spark, page)
    assert [(link.href, link.title) for link in row.links] == [
        (DOMAIN + "e", "A & B"), (DOMAIN + "f", "spaced"),
    ]
    assert row.org is None


def test_cap_comes_before_merging_and_the_last_title_stays(spark):
    names = ["a", "b", "a", "c", "d", "e", "f"]
    page = "<div title='first' class='name yf-1c9i0iv'></div>" + "".join(
        anchor(DOMAIN + name, f"title {i}") for i, name in enumerate(names)
    ) + "<div title='second' class='name yf-1c9i0iv'></div>"
    parsed, row = links_of(spark, page)
    assert [(link.pos, link.href[-1], link.title) for link in row.links] == [
        (0, "a", "title 2"), (1, "b", "title 1"), (3, "c", "title 3"), (4, "d", "title 4"),
    ]
    assert row.org == "first"
    assert link_rows(parsed).count() == 7


def test_page_without_links(spark):
    parsed, row = links_of(spark, "<div class='name yf-1c9i0iv' title='Org'>x</div>")
    assert row.links == [] and row.org == "Org" and link_rows(parsed).count() == 0


def test_anchor_text_as_title(spark):
    parsed, _ = links_of(
        spark, "<a href='/x'>one <b>two</b> &amp; three</a> after", link_class=None, title_attr=None
    )
    assert [(r.href, r.title) for r in link_rows(parsed).collect()] == [("/x", "one two & three")]


def test_capped_links_equal_brute_force(spark):
    rng = random.Random(5)
    pages = [
        [(pos, DOMAIN + rng.choice("abcd"), f"t{pos}") for pos in range(rng.randrange(9))]
        for _ in range(300)
    ]
    expected = []
    for links in pages:
        merged = {}
        for pos, href, title in links[:5]:
            merged[href] = (merged.get(href, (pos,))[0], href, title)
        expected.append(list(merged.values()))
    rows = spark.createDataFrame(
        list(enumerate(pages)), "i int, links array<struct<pos:int,href:string,title:string>>")
    found = rows.select("i", capped_links(F.col("links"), 5).alias("links")).orderBy("i").collect()
    assert [[tuple(link) for link in r.links] for r in found] == expected


@pytest.mark.parametrize("part", ["<br>", "<p>", "<br></p>", "<i></b>"])
def test_two_megabytes_of_tags_are_read_in_time(part):
    page = "<main>" + part * (2_000_000 // len(part)) + "end</main>"
    start = time.process_time()
    assert root_text(page, "main") == "end"
    assert time.process_time() - start < 20
