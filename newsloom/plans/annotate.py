"""The annotation hook: rows with a question go out to a model, answers come back.

The library has no model client. A user passes an annotator, a function from a pandas
DataFrame with ``system_prompt`` and ``user_prompt`` to one answer (or None) per row.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

Annotator = Callable[[pd.DataFrame], Sequence[str | None]]


def one_by_one(ask: Callable[[str, str], str], calls_at_once: int = 1) -> Annotator:
    """An annotator out of a function for a single question; a question that fails gives None."""
    def attempt(system_prompt: str, user_prompt: str) -> str | None:
        try:
            return ask(system_prompt, user_prompt)
        except Exception:
            logging.getLogger(__name__).exception("no answer to a question")
            return None

    def annotator(batch: pd.DataFrame) -> list[str | None]:
        with ThreadPoolExecutor(max_workers=calls_at_once) as pool:
            return list(pool.map(attempt, batch["system_prompt"], batch["user_prompt"]))

    return annotator


def annotate(
    questions: DataFrame, annotator: Annotator, system_prompt: str, key: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """``questions`` with ``user_prompt`` replaced by ``answer``, NULL where none came.

    Every row is one call, so rows should be distinct by ``key``. ``tasks`` bounds how
    many tasks ask at the same time, by default one per core of the cluster; rows are spread over
    them by key. Where the annotator fails on a batch, its rows are asked one by one, so that
    one bad question costs no answer but its own.
    """
    spread = questions.repartition(tasks or questions.sparkSession.sparkContext.defaultParallelism, *key)
    kept = [name for name in questions.columns if name != "user_prompt"]
    schema = T.StructType(
        [*questions.select(*kept).schema.fields, T.StructField("answer", T.StringType())]
    )

    def attempt(asked: pd.DataFrame) -> list[str | None] | None:
        try:
            return list(annotator(asked))
        except Exception:
            logging.getLogger(__name__).exception("no answers to %d questions", len(asked))
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            asked = batch.select(["user_prompt"]).to_pandas()
            asked = asked.assign(system_prompt=system_prompt)
            answers = attempt(asked)
            if answers is None:
                rows = (asked.iloc[i:i + 1].reset_index(drop=True) for i in range(len(asked)))
                answers = [(attempt(row) or [None])[0] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + [pa.array(answers, type=pa.string())],
                names=kept + ["answer"],
            )

    return spread.mapInArrow(run, schema)
