"""Job status out of the append-only status log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.constants import INSIGHTS_READY, NO_EVENTS, STAGE_DONE, STUCK_AFTER_SECONDS
from newsloom.functions.status import finished_stage, status_class
from newsloom.functions.text import moment
from newsloom.operators.lookups import only


def latest_status(events: DataFrame) -> DataFrame:
    """Status of every job in the log: ready once it ever was, else that of the newest event.

    Both aggregates combine on the map side, and the same plan runs as a streaming
    aggregation.
    """
    ready = F.bool_or(F.col("status") == INSIGHTS_READY)
    newest = F.max_by("status", F.struct(F.col("time"), -F.col("seq")))
    return events.groupBy("job_id").agg(
        F.when(ready, F.lit(INSIGHTS_READY)).otherwise(newest).alias("status")
    )


def status_of(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Status of each asked job; a job without events has the status "nothing"."""
    asked = jobs.select("job_id").distinct()
    return asked.join(latest_status(only(events, jobs, ["job_id"])), "job_id", "left").select(
        "job_id", F.coalesce("status", F.lit(NO_EVENTS)).alias("status")
    )


def history(events: DataFrame, job_id: str | None = None) -> DataFrame:
    """Events newest first, equal times in insertion order, of one job or job by job.

    A range sort: the events of a very busy job spread over several tasks.
    """
    chosen = events if job_id is None else events.filter(F.col("job_id") == job_id)
    return chosen.orderBy("job_id", F.desc("time"), F.asc("seq"))


def queue_depth(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Requests per stage, out of (stage, job_id) rows, whose job has not ended the stage yet."""
    asked = requests.groupBy("stage", "job_id").agg(F.count("*").alias("n"))
    ended = (
        events.select("job_id", finished_stage(F.col("status")).alias("stage"))
        .filter(F.col("stage").isNotNull())
        .distinct()
    )
    waiting = asked.join(ended, ["stage", "job_id"], "left_anti")
    # One row with a column per stage, so that an empty queue shows as 0.
    depths = waiting.agg(*[
        F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("n"))), F.lit(0)).alias(stage)
        for stage in STAGE_DONE
    ])
    return depths.unpivot([], list(STAGE_DONE), "stage", "n")


def stuck_jobs(
    submissions: DataFrame, events: DataFrame, as_of: datetime | Column,
    after_seconds: int = STUCK_AFTER_SECONDS,
) -> DataFrame:
    """Jobs, out of (job_id, submitted_at), that are still running after the waiting time."""
    submitted = submissions.groupBy("job_id").agg(F.min("submitted_at").alias("submitted_at"))
    limit = moment(as_of) - F.expr(f"INTERVAL {int(after_seconds)} SECONDS")
    late = submitted.filter(F.col("submitted_at") < limit)
    current = latest_status(only(events, submissions, ["job_id"]))
    known = late.join(current, "job_id", "left").withColumn(
        "status", F.coalesce("status", F.lit(NO_EVENTS))
    )
    return known.filter(status_class(F.col("status")) == "running")
