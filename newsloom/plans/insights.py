"""Summaries to fragments: what each article means for the asked company."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.constants import INSIGHT_DEFAULTS, NO_RELATION
from newsloom.functions.insight import insight_field, insight_value, related, with_insight
from newsloom.functions.predicates import usable_content
from newsloom.functions.status import insights_ready
from newsloom.functions.text import insight_prompt, or_default
from newsloom.operators.lookups import PAIR, known_pairs, latest_articles, request_rows
from newsloom.operators.records import child_seq, new_fragments, new_status
from newsloom.plans.annotate import Annotator
from newsloom.plans.ledger import ANSWERED, FAILED, Store, ask_once, pair_counts
from newsloom.session import materialise


@dataclass(frozen=True)
class Insights:
    """New fragments and status events, per job what became of its pairs, and new ledger entries."""

    fragments: DataFrame
    status: DataFrame
    counts: DataFrame
    entries: DataFrame


def pairs_to_ask(
    requested: DataFrame, fragments: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """(seq, url, ticker, org) of the pairs without a fragment, each once.

    A pair wanted by several jobs is asked about for the first of them. ``known`` are the pairs
    that have a fragment, if they were looked up already.
    """
    order = child_seq(F.col("seq"), F.col("pos"))
    wanted = requested.groupBy(*PAIR).agg(
        F.min_by("org", order).alias("org"), F.min(order).alias("seq")
    )
    # Both sides hold each pair once and are already shuffled by it.
    stored = known_pairs(requested, fragments) if known is None else known
    return wanted.join(stored, PAIR, "left_anti")


def insight_questions(
    pairs: DataFrame, articles: DataFrame, max_chars: int | None = None
) -> DataFrame:
    """(seq, url, ticker, org, title, user_prompt), one row per pair with content."""
    found = latest_articles(pairs, articles, columns=["title", "content", "publish_date"])
    prompt = insight_prompt(*map(F.col, ("org", "ticker", "title", "publish_date", "content")), max_chars)
    return found.filter(usable_content(F.col("content"))).select(
        "seq", *PAIR, "org", "title", prompt.alias("user_prompt")
    )


def parsed_insights(answers: DataFrame) -> DataFrame:
    """Rows whose ``answer`` is an insight that found a relation, one column per field."""
    return (
        with_insight(answers, out="_insight")
        .filter(related(F.col("_insight")))
        .withColumns({key: insight_field(F.col("_insight"), key) for key in INSIGHT_DEFAULTS})
        .drop("_insight", "answer")
    )


def insight_outcome(answers: DataFrame) -> DataFrame:
    """``answers`` with ``outcome``: an answer that is no insight object counts as failed."""
    insight = F.col("_insight")
    no_relation = insight_value(insight, "related_reason_simple") == NO_RELATION
    outcome = F.when(related(insight), ANSWERED).when(no_relation, NO_RELATION).otherwise(FAILED)
    return with_insight(answers, out="_insight").withColumn("outcome", outcome).drop("_insight")


def extract_insights(
    requests: DataFrame, articles: DataFrame, fragments: DataFrame, system_prompt: str,
    annotator: Annotator, as_of: datetime | Column, tasks: int | None = None,
    max_chars: int | None = None, ledger: DataFrame | None = None, retry_failed: bool = True,
    waves: int = 1, store: Store | None = None,
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> Insights:
    """One pass over stage requests (seq, job_id, urls, ticker, org); every job ends ready.

    With a ``ledger`` of earlier answers nothing in it is asked again (``ledger.ask_once``).
    """
    requested = request_rows(requests)
    known = keep(known_pairs(requested, fragments))
    pairs = keep(pairs_to_ask(requested, fragments, known))
    questions = insight_questions(pairs, articles, max_chars)
    asked = ask_once(
        questions, ledger, annotator, system_prompt, as_of, insight_outcome, tasks, retry_failed,
        waves, store, keep)
    found = asked.rows.filter(F.col("outcome") == ANSWERED).drop("outcome", "reused")
    found = parsed_insights(found).withColumn("org", or_default(F.col("org")))
    status = requests.select(child_seq(F.col("seq"), F.lit(2)).alias("seq"), "job_id")
    states = known.withColumn("state", F.lit("stored")).unionByName(
        asked.rows.select(*PAIR, F.col("outcome").alias("state"), "reused"), allowMissingColumns=True)
    return Insights(
        new_fragments(found, as_of), new_status(status, insights_ready(), as_of),
        pair_counts(requested, states), asked.entries,
    )
