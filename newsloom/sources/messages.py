"""Request messages: JSON texts to columns and back.

The producer's ``seq`` travels in the message, since rows of a distributed source have
no order of their own. Messages without one are accepted and get NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.predicates import complete_request

CRAWL_MESSAGE = "job_id string, data string, seq bigint"
STAGE_MESSAGE = "job_id string, data array<string>, ticker string, org string, seq bigint"


def decode_crawl(messages: DataFrame, value: str = "value") -> DataFrame:
    """(seq, job_id, ticker); messages that are not JSON or name no job are left out.

    Other columns of ``messages``, such as an arrival time, stay.
    """
    decoded, others = _decoded(messages, value, CRAWL_MESSAGE)
    return decoded.select("m.seq", "m.job_id", F.col("m.data").alias("ticker"), *others)


def decode_stage(messages: DataFrame, value: str = "value") -> DataFrame:
    """(seq, job_id, urls, ticker, org) of the summary and the insight stage."""
    decoded, others = _decoded(messages, value, STAGE_MESSAGE)
    return decoded.select(
        "m.seq", "m.job_id", F.col("m.data").alias("urls"), "m.ticker", "m.org", *others
    )


def rejected(
    messages: DataFrame, schema: str = CRAWL_MESSAGE, value: str = "value"
) -> DataFrame:
    """The messages that decoding leaves out, whole, each with its ``reason``."""
    reason = F.when(F.get_json_object(value, "$").isNull(), "not JSON").otherwise("no job_id")
    left_out = F.from_json(value, schema)["job_id"].isNull()
    return messages.filter(left_out).withColumn("reason", reason)


def encode_crawl(requests: DataFrame) -> DataFrame:
    return _encoded(requests, "job_id", F.col("ticker").alias("data"))


def encode_stage(requests: DataFrame) -> DataFrame:
    return _encoded(requests, "job_id", F.col("urls").alias("data"), "ticker", "org")


def normalised(forms: DataFrame) -> DataFrame:
    """Requests out of (seq, user_id, session_id, ticker, suffix) forms.

    Forms without user, session or ticker are refused. ``suffix`` is the caller's eight
    hex digits; with ``random_suffix()`` keep the result before using it twice.
    """
    accepted = forms.filter(
        complete_request(F.col("user_id"), F.col("session_id"), F.col("ticker"))
    )
    ticker = F.upper("ticker")
    return accepted.select(
        "seq",
        F.concat_ws("@", "user_id", "session_id", ticker, "suffix").alias("job_id"),
        ticker.alias("ticker"),
    )


def random_suffix() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


def _decoded(messages: DataFrame, value: str, schema: str) -> tuple[DataFrame, list[str]]:
    others = [name for name in messages.columns if name != value]
    decoded = messages.select(F.from_json(value, schema).alias("m"), *others)
    return decoded.filter("m.job_id is not null"), others


def _encoded(requests: DataFrame, *fields) -> DataFrame:
    if "seq" in requests.columns:
        fields = (*fields, "seq")
    return requests.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    )
