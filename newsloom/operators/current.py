"""Current rows of append-only tables, and the newest N."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from newsloom.constants import FRAGMENTS_SHOWN
from newsloom.session import materialise

# Up to here the built-in group limit of row_number() keeps few rows per map task.
DIRECT_LIMIT = 100
PRE_LIMIT_SLICES = 64


def latest_seq(df: DataFrame, keys: Sequence[str], time: str, seq: str = "seq") -> DataFrame:
    """(keys, seq, time) of one row per key: greatest ``time``, of equal times the first inserted.

    Two hash aggregations of fixed-width columns: the first inserted of each time, then that of
    the greatest. Both combine on the map side and neither sorts, whatever else a row holds. An
    absent time is older than all others.
    """
    moments = df.select(*keys, F.col(time).alias("_time"), F.col(seq).alias("_seq"))
    first = moments.groupBy(*keys, "_time").agg(F.min("_seq").alias("_seq"))
    newest = first.groupBy(*keys).agg(
        F.coalesce(F.max_by("_seq", "_time"), F.min("_seq")).alias("_seq"), F.max("_time").alias("_time"))
    named = {seq: F.col("_seq")} | {time: F.col("_time")}
    return newest.select(*keys, *[column.alias(name) for name, column in named.items()])


def first_seq(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """(keys, seq) of the first inserted row per key."""
    return df.groupBy(*keys).agg(F.min(seq).alias(seq))


def rows_of(
    df: DataFrame, chosen: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
    seq: str = "seq",
) -> DataFrame:
    """The rows of ``df`` that ``chosen`` names by key and ``seq``, with ``columns`` or all.

    Wide columns are read for this join only. The stored choice has a size that Spark knows: a
    small one is broadcast and no wide row is shuffled.
    """
    wanted = [name for name in (columns or df.columns) if name not in keys]
    if set(wanted) <= set(chosen.columns):
        return chosen.select(*keys, *wanted)
    named = materialise(chosen.select(*[F.col(name).alias(f"_{name}") for name in (*keys, seq)]))
    same = F.col(seq) == F.col(f"_{seq}")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return df.join(named, same, "left_semi").select(*keys, *wanted)


def latest_by(
    df: DataFrame, keys: Sequence[str], time: str, seq: str = "seq",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: greatest ``time``, and of equal times the first inserted.

    ``seq`` tells the rows of a key apart. Name the ``columns`` needed: the rest never leaves
    the scan.
    """
    return rows_of(df, latest_seq(df, keys, time, seq), keys, columns, seq)


def first_by(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the first inserted."""
    return rows_of(df, first_seq(df, keys, seq), keys, columns, seq)


def newest_per_key(
    df: DataFrame, key: str, time: str, n: int = FRAGMENTS_SHOWN, seq: str = "seq",
    rank: str = "rn",
) -> DataFrame:
    """The ``n`` newest rows per key, ranked from 1, equal times in insertion order.

    The rank filter is pushed below the shuffle by Spark. For a large ``n`` each key is
    first limited in slices, which keeps the last sort of a heavy key small as well.
    """
    order = [F.desc(time), F.asc(seq)]
    if n > DIRECT_LIMIT:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(seq), F.lit(PRE_LIMIT_SLICES)))
        within = Window.partitionBy(key, "_slice").orderBy(*order)
        df = (
            sliced.withColumn(rank, F.row_number().over(within))
            .filter(F.col(rank) <= n)
            .drop("_slice", rank)
        )
    per_key = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(per_key)).filter(F.col(rank) <= n)


def newest_of(
    df: DataFrame, key: str, value: str, time: str, n: int = FRAGMENTS_SHOWN, seq: str = "seq"
) -> DataFrame:
    """The ``n`` newest rows of one key, in order; each task keeps only its own ``n``."""
    return df.filter(F.col(key) == value).orderBy(F.desc(time), F.asc(seq)).limit(n)
