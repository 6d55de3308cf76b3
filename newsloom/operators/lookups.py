"""Bulk lookups: the per-key searches of a request, done for all requests at once.

Request rows are (seq, job_id, pos, url, ticker, org), one per requested url.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.constants import SNAPSHOT_TTL_HOURS
from newsloom.functions.predicates import expired, needs_summary
from newsloom.operators.current import first_by, latest_by
from newsloom.operators.spread import spread_join
from newsloom.session import key_folders, materialise

PAIR = ["url", "ticker"]


def request_rows(requests: DataFrame) -> DataFrame:
    """One row per url of each request, with its position in the list."""
    others = [name for name in requests.columns if name != "urls"]
    return requests.select(*others, F.posexplode("urls").alias("pos", "url"))


def only(table: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``table`` whose key is asked for, taken before anything is aggregated.

    The distinct keys are stored first: however often a key is asked for, it travels once per
    map task and is one row of the join. A short list of keys, the usual case, is broadcast
    and the table is not shuffled. With a long one both sides come straight from a shuffle,
    so adaptive execution can split a table partition that one key has filled.

    Where the table lies in folders by a key, or by a key's hash (``key_folder``), only the
    folders of asked keys are read. Spark prunes at run time if the other side is filtered,
    so the stored keys are: by a comparison that holds for all but nulls, which match nothing.
    """
    asked = materialise(wanted.select(*keys).distinct())
    given = asked.filter(reduce(and_, (F.col(key).cast("string") >= "" for key in keys)))
    folders = key_folders(table.sparkSession)
    named = {
        folder_of(key): key_folder(F.col(key), folders) for key in keys if folder_of(key) in table.columns
    }
    found = table.join(given.withColumns(named), [*keys, *named], "left_semi")
    return found.drop(*[name for name in table.columns if name.endswith("_folder")])


def folder_of(key: str) -> str:
    """Name of the column that says in which folder the rows of a key are."""
    return f"{key}_folder"


def key_folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def narrowed(table: DataFrame, *columns: str | Column) -> DataFrame:
    """Some columns of a table, and what says where its rows are."""
    return table.select(*columns, *[name for name in table.columns if name.endswith("_folder")])


def first_articles(
    requested: DataFrame, articles: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Every requested url once, with its first inserted article or NULLs."""
    urls = requested.select("url").distinct()
    found = first_by(only(articles, requested, ["url"]), ["url"], columns=columns)
    return urls.join(found, "url", "left")


def latest_articles(
    requested: DataFrame, articles: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Requested rows with the newest article of their url; unknown urls drop out."""
    found = latest_by(only(articles, requested, ["url"]), ["url"], "create_time", columns=columns)
    found = found.withColumnRenamed("seq", "article_seq")
    return spread_join(requested, found, ["url"], "inner")


def pending_urls(requested: DataFrame, articles: DataFrame) -> DataFrame:
    """Requested urls whose first inserted article still waits for its summary."""
    narrow = narrowed(articles, "seq", "url", needs_summary(F.col("content")).alias("waiting"))
    found = first_articles(requested, narrow, columns=["waiting"])
    return found.filter("waiting").select("url")


def known_pairs(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Distinct (url, ticker) among ``pairs`` that have a fragment."""
    return only(narrowed(fragments, *PAIR), pairs, PAIR).distinct()


def fragment_exists(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``pairs`` with ``found``: whether a fragment of that url and ticker is stored."""
    known = known_pairs(pairs, fragments).withColumn("_known", F.lit(True))
    joined = spread_join(pairs, known, PAIR, "left")
    return joined.withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")


def stored_pairs(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Only the pairs that have a fragment."""
    return spread_join(pairs, known_pairs(pairs, fragments), PAIR, "left_semi")


def new_pairs(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Only the pairs without a fragment; repeated pairs all stay."""
    return spread_join(pairs, known_pairs(pairs, fragments), PAIR, "left_anti")


def known_urls(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct urls among ``links`` that an article has."""
    return only(narrowed(articles, "url"), links, ["url"]).distinct()


def new_links(links: DataFrame, articles: DataFrame) -> DataFrame:
    """``links`` (one row per url) whose url no article has."""
    return links.join(known_urls(links, articles), "url", "left_anti")


def attach_pages(links: DataFrame, news_pages: DataFrame) -> DataFrame:
    """``links`` (one row per url) with the path of the newest landed page of the url."""
    pages = only(narrowed(news_pages, "url", "path", "downloaded_at"), links, ["url"])
    newest = pages.groupBy("url").agg(
        F.max_by("path", F.struct("downloaded_at", "path")).alias("file_path")
    )
    return links.join(newest, "url", "left")


def snapshot_lookup(
    tickers: DataFrame, snapshots: DataFrame, as_of: datetime | Column,
    ttl_hours: int = SNAPSHOT_TTL_HOURS, columns: Sequence[str] = ("org", "url_keys"),
) -> DataFrame:
    """Every asked ticker once, with its newest snapshot and whether that has expired."""
    asked = tickers.select("ticker").distinct()
    newest = latest_by(
        only(snapshots, tickers, ["ticker"]), ["ticker"], "time_created",
        columns=["time_created", *columns],
    )
    return asked.join(newest, "ticker", "left").withColumn(
        "expired", expired(F.col("time_created"), as_of, ttl_hours)
    )
