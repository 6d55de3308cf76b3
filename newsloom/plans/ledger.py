"""A ledger of questions to the model and what became of them, so that none is asked twice.

An entry is known by its url, its ticker (empty where a question has none) and a digest of both
prompts, so a changed prompt is a new question. It holds what came of the question: an answer, no
relation, or a failure. Questions are looked up before the model is asked; what the ledger knows
is used again, answers that found nothing included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import schemas
from newsloom.constants import NO_RELATION
from newsloom.functions.text import moment
from newsloom.operators.lookups import only
from newsloom.operators.spread import spread_join
from newsloom.plans.annotate import Annotator, annotate
from newsloom.session import materialise

ANSWERED, FAILED = "answered", "failed"
KEY = ["url", "ticker", "prompt"]
Store = Callable[[DataFrame], None]


@dataclass(frozen=True)
class Asked:
    """The questions' rows with ``answer``, ``outcome`` and ``reused`` in place of the prompt, and
    the entries that the ledger did not have."""

    rows: DataFrame
    entries: DataFrame


def prompt_digest(system_prompt: str, user_prompt: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{len(system_prompt)}:{system_prompt}"), user_prompt), 256)


def answered_or_failed(answers: DataFrame) -> DataFrame:
    return answers.withColumn("outcome", F.when(F.col("answer").isNotNull(), ANSWERED).otherwise(FAILED))


def known_answers(questions: DataFrame, ledger: DataFrame, retry_failed: bool) -> DataFrame:
    """(url, ticker, prompt, outcome, answer) of questions that need not be asked.

    Of several entries the first that did not fail counts.
    """
    entries = only(ledger, questions, KEY)
    if retry_failed:
        entries = entries.filter(F.col("outcome") != FAILED)
    first = F.min_by(F.struct("outcome", "answer"), F.struct(F.col("outcome") == FAILED, "seq"))
    return entries.groupBy(*KEY).agg(first.alias("_entry")).select(*KEY, "_entry.*")


def ask_once(
    questions: DataFrame, ledger: DataFrame | None, annotator: Annotator, system_prompt: str,
    as_of: datetime | Column, judged: Callable[[DataFrame], DataFrame] = answered_or_failed,
    tasks: int | None = None, retry_failed: bool = True, waves: int = 1, store: Store | None = None,
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> Asked:
    """Answers to ``questions`` (seq, url, user_prompt and others), one row per key.

    ``judged`` adds ``outcome`` to rows with an ``answer``. Failed questions are asked again, or
    not if ``retry_failed`` is false. The questions go out in ``waves``; each wave's entries
    are handed to ``store`` before the next begins, so a run that breaks off loses one wave.
    """
    if "ticker" not in questions.columns:
        asked = ask_once(
            questions.withColumn("ticker", F.lit("")), ledger, annotator, system_prompt, as_of, judged,
            tasks, retry_failed, waves, store, keep)
        return Asked(asked.rows.drop("ticker"), asked.entries)
    named = keep(questions.withColumn("prompt", prompt_digest(system_prompt, F.col("user_prompt"))))
    rows, waiting = [], named
    if ledger is not None:
        known = keep(known_answers(named, ledger, retry_failed))
        waiting = named.join(known.select(*KEY), KEY, "left_anti")
        rows = [named.drop("user_prompt").join(known, KEY).withColumn("reused", F.lit(True))]
    fresh = []
    for wave in range(waves):
        share = F.pmod(F.xxhash64(*KEY), F.lit(waves)) == wave
        answers = judged(annotate(waiting.filter(share), annotator, system_prompt, KEY, tasks))
        fresh.append(keep(answers.withColumn("reused", F.lit(False))))
        if store is not None:
            store(ledger_entries(fresh[-1], as_of))
    rows += fresh
    everything = rows[0]
    for more in rows[1:]:
        everything = everything.unionByName(more)
    added = fresh[0]
    for more in fresh[1:]:
        added = added.unionByName(more)
    return Asked(everything.drop("prompt"), ledger_entries(added, as_of))


def ledger_entries(answers: DataFrame, as_of: datetime | Column) -> DataFrame:
    return answers.withColumn("time", moment(as_of)).select(*schemas.ANSWERS.names)


def pair_counts(requested: DataFrame, states: DataFrame) -> DataFrame:
    """Per job what became of the pairs it asked for, out of one ``state`` per (url, ticker)."""
    joined = spread_join(requested, states, ["url", "ticker"], "left")

    def count(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    state, reused = F.col("state"), F.col("reused")
    return joined.groupBy("job_id").agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("wanted"),
        count(state == "stored").alias("stored"), F.count_if(state.isNull()).alias("no_content"),
        count(~reused).alias("asked"), count(reused).alias("reused"),
        count(state == ANSWERED).alias("answered"), count(state == NO_RELATION).alias("no_relation"),
        count(state == FAILED).alias("failed"),
    ).select(*schemas.JOB_COUNTS.names)
