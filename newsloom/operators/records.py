"""Scans, appends, field updates and deletions on the keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import schemas
from newsloom.constants import PENDING
from newsloom.functions.text import moment, or_default
from newsloom.operators.lookups import narrowed, only
from newsloom.session import materialise

ARTICLE_FIELDS = ("content", "summary", "publish_date")
# Room for the rows one request can add to a table, between its seq and the next.
CHILD_BITS = 20


def child_seq(seq: Column, position: Column) -> Column:
    """Insertion order of the ``position``-th row that request ``seq`` adds.

    Taken from the request alone, so a repeated run numbers its rows the same way and
    no global counter or sort is needed.
    """
    most = 1 << (63 - CHILD_BITS)
    checked = (
        F.when(position >= 1 << CHILD_BITS,
               F.raise_error(F.lit("a request adds more rows than seq has room for")))
        .when(~seq.between(-most, most - 1), F.raise_error(F.lit("seq is out of range")))
        .otherwise(position)
    )
    return F.shiftleft(seq.cast("bigint"), CHILD_BITS) + checked


def snapshots(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """All chart snapshots, or one ticker's; an empty ticker means all."""
    return df.filter(F.col("ticker") == ticker) if ticker else df


def new_snapshots(found: DataFrame, as_of: datetime | Column) -> DataFrame:
    """(seq, ticker, org, url_keys) stamped with ``as_of``."""
    return _shaped(found.withColumn("time_created", moment(as_of)), schemas.CHART_SNAPSHOTS)


def new_articles(links: DataFrame, as_of: datetime | Column) -> DataFrame:
    """(seq, url, title[, file_path]) as articles waiting for their summary."""
    path = or_default(F.col("file_path")) if "file_path" in links.columns else F.lit("")
    waiting = links.withColumns({
        "file_path": path,
        "create_time": moment(as_of),
        "content": F.lit(PENDING),
        "summary": F.lit(PENDING),
        "publish_date": F.lit(""),
    })
    return _shaped(waiting, schemas.ARTICLES)


def new_fragments(rows: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Fragments with ``as_of`` where no creation time is given."""
    stamp = moment(as_of)
    if "time_created" in rows.columns:
        stamp = F.coalesce(F.col("time_created"), stamp)
    return _shaped(rows.withColumn("time_created", stamp), schemas.FRAGMENTS)


def new_status(jobs: DataFrame, status: Column, as_of: datetime | Column) -> DataFrame:
    """One status event for each row of (seq, job_id)."""
    return _shaped(
        jobs.withColumns({"status": status, "time": moment(as_of)}), schemas.JOB_STATUS
    )


def append(table: DataFrame, *added: DataFrame) -> DataFrame:
    for rows in added:
        table = table.unionByName(rows)
    return table


def collapse_updates(
    updates: DataFrame, fields: Sequence[str] = ARTICLE_FIELDS, key: str = "url", seq: str = "seq"
) -> DataFrame:
    """One row per key from a log of updates: per field the last value that was set."""
    last = [
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(name) for name in fields
    ]
    return updates.groupBy(key).agg(*last)


def update_fields(
    table: DataFrame, updates: DataFrame, fields: Sequence[str] = ARTICLE_FIELDS, key: str = "url"
) -> DataFrame:
    """``table`` with the fields set in ``updates`` on every row of the key.

    ``updates`` has one row per key; NULL leaves a field alone. Few updates are broadcast;
    many are shuffled, and adaptive execution splits the table's heavy keys, for which
    the rows of ``collapse_updates`` should be materialised first.
    """
    unknown = set(fields) - set(table.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    values = updates.select(key, *[F.col(name).alias(f"_new_{name}") for name in fields])
    joined = table.join(values, key, "left")
    return joined.withColumns(
        {name: F.coalesce(f"_new_{name}", name) for name in fields}
    ).select(*table.columns)


def update_report(table: DataFrame, updates: DataFrame, key: str = "url") -> DataFrame:
    """Per updated key whether the table knows it."""
    return _asked_and_known(table, updates, key).withColumnRenamed("_known", "found")


def delete_jobs(status: DataFrame, jobs: DataFrame) -> DataFrame:
    """The status log without the given jobs, each of which travels once."""
    return status.join(materialise(jobs.select("job_id").distinct()), "job_id", "left_anti")


def deleted_jobs(status: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per given job 1 if it had a history to delete, else 0."""
    return _asked_and_known(status, jobs, "job_id").select(
        "job_id", F.col("_known").cast("int").alias("removed")
    )


def _asked_and_known(table: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    keys = materialise(asked.select(key).distinct())
    known = only(narrowed(table, key), keys, [key]).distinct()
    return keys.join(known.withColumn("_known", F.lit(True)), key, "left").select(
        key, F.coalesce("_known", F.lit(False)).alias("_known")
    )


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    """All urls of the article table, or all job ids of the status log."""
    return table.select(column).distinct()


def _shaped(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(field.name).cast(field.dataType) for field in schema])
