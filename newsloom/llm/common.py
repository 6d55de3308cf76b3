"""Expressions and per-process helpers that several operators share."""

from __future__ import annotations

import hashlib
import string
import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: What separates words: the ASCII white space, and nothing else.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 digest as a number; other engines can compute it too."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def even_parts(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Spread rows that wait for costly Python evenly, whatever their files looked like."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)


class Memo(dict):
    """A bounded memo: ``memo[key]`` computes a missing value once and keeps it.

    It starts again when full, so its memory is bounded and its answers never change.
    """

    def __init__(self, compute: Callable, limit: int):
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def per_process(name: str, make: Callable):
    """What ``make`` returned for ``name`` in this Python worker, which serves many tasks.

    A worker holds one such thing: asking for another drops what earlier stages remembered.
    """
    state = sys.modules.setdefault("_newsloom_worker", types.ModuleType("_newsloom_worker"))
    held = state.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def given_back(batches):
    """``batches`` as they come; before each, this Python worker's freed memory goes back.

    Allocators keep what they have freed, and a worker lives through all stages of an executor, so
    it would hold the most that any batch of any stage has taken.
    """
    import ctypes

    import pyarrow as pa

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

    def give_back():
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)
    for batch in batches:
        yield batch
        del batch
        give_back()
    give_back()


def file_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def parts(texts, budget: int):
    """Cut an Arrow text column into (start, slice) of about ``budget`` bytes each.

    One text above the budget is a slice of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        used = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, used + budget, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def slices(texts, budget: int):
    """The same with lists of texts; nulls come out as empty texts."""
    for start, part in parts(texts, budget):
        yield start, [text or "" for text in part.to_pylist()]


def aside(docs: DataFrame, names) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns called like ``names`` renamed, and what gives back its columns."""
    columns = docs.columns
    moved = {c: f"_aside_{c}" for c in columns if c in names}

    def restored(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(moved.get(c, c)).alias(c) for c in columns])
    return docs.withColumnsRenamed(moved), restored


def discard(table: DataFrame) -> None:
    """Delete a stored table whose results are stored too, so that nothing reads it again."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
