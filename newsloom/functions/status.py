"""Status texts and what they mean to a reader."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.constants import INSIGHTS_READY, JOB_FAILED, NEWS_READY, STAGE_DONE, SUMMARIES_READY


def news_ready(job_id: Column) -> Column:
    return F.concat(F.lit(NEWS_READY + " "), job_id)


def summaries_ready() -> Column:
    return F.lit(SUMMARIES_READY)


def insights_ready() -> Column:
    return F.lit(INSIGHTS_READY)


def job_failed(reason: Column) -> Column:
    return F.concat(F.lit(JOB_FAILED), reason)


def status_class(status: Column) -> Column:
    """``done``, ``failed`` or ``running``, looked for anywhere in the text in any case."""
    text = F.lower(status)
    return (
        F.when(F.contains(text, F.lit(INSIGHTS_READY)), "done")
        .when(F.contains(text, F.lit("fail")) | F.contains(text, F.lit("error")), "failed")
        .otherwise("running")
    )


def finished_stage(status: Column) -> Column:
    """Name of the stage this status ends, NULL if it ends none."""
    ends = F.lit(None).cast("string")
    for stage, text in STAGE_DONE.items():
        ends = F.when(F.startswith(status, F.lit(text)), stage).otherwise(ends)
    return ends
