"""Equi-joins that hold up when one key owns a large share of the left rows.

A shuffle join sends all rows of a key to one task, and adaptive skew handling only
steps in where both sides come straight from a shuffle, which a side that was just
aggregated on the same key does not. So heavy keys are looked for first, by one narrow
count that combines on the map side. Mostly there is none and the join is an ordinary
one. Otherwise heavy keys are cut into slices: each left row goes to one slice, each
right row of a heavy key to all of them, and every pair still meets exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.session import materialise, rows_per_task

NULL_SLICES = 1024


def heavy_keys(df: DataFrame, on: Sequence[str], max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows, with the number of slices each one needs."""
    counts = df.groupBy(*on).count().filter(F.col("count") > max_rows)
    return counts.select(*on, F.ceil(F.col("count") / max_rows).cast("int").alias("_slices"))


def _is_keyless(on: Sequence[str]) -> Column:
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    return missing


def spread_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``right`` to ``left`` (inner, left, left_semi or left_anti) on equal ``on``.

    ``spread_by`` names the left columns whose hash picks a slice; they should tell
    rows of one key apart. A hash, unlike a random number, gives a retried task the
    same rows again.
    """
    spark, on = left.sparkSession, list(on)
    # At most a key per ``rows_per_task`` rows; Spark checks the stored size before a broadcast.
    slices = materialise(heavy_keys(left, on, rows_per_task(spark)))
    if slices.isEmpty():
        return left.join(right, on, how)
    hashed = F.xxhash64(*(spread_by or left.columns))
    # Rows without a key match nothing, so they may go anywhere.
    slice_no = (
        F.when(_is_keyless(on), F.pmod(hashed, F.lit(NULL_SLICES)))
        .otherwise(F.pmod(hashed, F.coalesce("_slices", F.lit(1))))
        .cast("int")
    )
    last_slice = F.coalesce(F.col("_slices"), F.lit(1)) - 1
    sliced_left = left.join(slices, on, "left").withColumn("_slice", slice_no).drop("_slices")
    sliced_right = (
        right.join(slices, on, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), last_slice)))
        .drop("_slices")
    )
    return sliced_left.join(sliced_right, [*on, "_slice"], how).drop("_slice")
