"""News to summaries: read landed articles, ask for a summary, set the fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.predicates import needs_summary, usable_file
from newsloom.functions.status import summaries_ready
from newsloom.functions.text import publish_date_of, summary_of, summary_prompt
from newsloom.operators.lookups import only, request_rows
from newsloom.operators.records import child_seq, new_status
from newsloom.plans.annotate import Annotator
from newsloom.plans.ledger import Store, ask_once
from newsloom.session import materialise
from newsloom.sources.html import page_text, readable
from newsloom.sources.pages import newest_pages, with_path_fields


@dataclass(frozen=True)
class Summarised:
    """Fields to set per url, status events, the requests handed on unchanged, and new entries
    of the ledger."""

    updates: DataFrame
    status: DataFrame
    requests: DataFrame
    entries: DataFrame


def waiting_files(requested: DataFrame, articles: DataFrame) -> DataFrame:
    """(url, file_path) of requested urls that wait for a summary and have a landed page.

    Whether a url waits is read off its first inserted row, its page off the newest one;
    both come out of one aggregation.
    """
    rows = only(articles, requested, ["url"]).select(
        "url", "seq", "create_time", "file_path", needs_summary(F.col("content")).alias("waits")
    )
    per_url = rows.groupBy("url").agg(
        F.min_by("waits", "seq").alias("waits"),
        F.max_by("file_path", F.struct(F.col("create_time"), -F.col("seq"))).alias("file_path"),
    )
    return per_url.filter(F.col("waits") & usable_file(F.col("file_path"))).drop("waits")


def summary_questions(
    requested: DataFrame, articles: DataFrame, pages: DataFrame, root: str = "main",
    pages_by_ticker: bool = False,
) -> DataFrame:
    """(url, content, user_prompt), one row per url with readable text.

    Say ``pages_by_ticker`` for pages stored by ticker under their usual path names: the
    ticker read off each wanted path then prunes the other tickers' folders at run time.
    """
    waiting = waiting_files(requested, articles).withColumnRenamed("file_path", "path")
    keys = ["path"]
    if pages_by_ticker:
        keys = ["ticker", "path"]
        waiting = with_path_fields(waiting).select("url", *keys)
    waiting = materialise(waiting)
    # Several urls may name one page.
    paths = waiting.select(*keys).distinct()
    if "downloaded_at" not in pages.columns:
        pages = pages.withColumn("downloaded_at", F.lit(None).cast("timestamp_ntz"))
    texts = page_text(newest_pages(pages, paths, keys), root).filter(F.col("text").isNotNull())
    per_url = waiting.join(texts, keys)
    return per_url.select("url", readable(F.col("text")).alias("content")).withColumn(
        "user_prompt", summary_prompt(F.col("content"))
    )


def summarise(
    requests: DataFrame, articles: DataFrame, pages: DataFrame, system_prompt: str,
    annotator: Annotator, as_of: datetime | Column, root: str = "main",
    tasks: int | None = None, pages_by_ticker: bool = False, ledger: DataFrame | None = None,
    retry_failed: bool = True, waves: int = 1, store: Store | None = None,
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> Summarised:
    """One pass over stage requests (seq, job_id, urls, ticker, org).

    Urls wanted by several jobs are asked about once. A url whose question fails stays
    pending. Apply ``updates`` with ``update_fields``. With a ``ledger`` nothing in it is asked
    again (``ledger.ask_once``).
    """
    questions = summary_questions(
        request_rows(requests), articles, pages, root, pages_by_ticker
    ).withColumn("seq", F.lit(0).cast("bigint"))
    asked = ask_once(
        questions, ledger, annotator, system_prompt, as_of, tasks=tasks, retry_failed=retry_failed,
        waves=waves, store=store, keep=keep)
    updates = asked.rows.filter(F.col("answer").isNotNull()).select(
        "url", "content", summary_of(F.col("answer")).alias("summary"),
        publish_date_of(F.col("answer")).alias("publish_date"),
    )
    status = requests.select(child_seq(F.col("seq"), F.lit(1)).alias("seq"), "job_id")
    return Summarised(updates, new_status(status, summaries_ready(), as_of), requests, asked.entries)
