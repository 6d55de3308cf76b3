"""Shards of near-equal size by sampled splitters.

A size-weighted sample of the keys gives quantile boundaries, the boundaries cut the keys
into many small ranges, and ranges that turn out overfull are sampled again and subdivided.
Exact sums per range then place every row: its position in the order of keys, in bytes and
in rows, is the start of its range plus a running sum inside the range. So no window is
larger than a range, only narrow columns are shuffled, and the sample decides how even the
work is, not the result.

The key is a hash of the text, then the id. Equal texts are neighbours and stay in one shard
unless they weigh more than a range's share; such heavy groups are cut by id.

Defined results: a null text has no bytes, so size 1. A null id comes before all others. An
empty table gives an empty table. Rows equal in text and id are told apart by nothing, so
which of them has which slot is open. Extra columns stay; ``size``, ``shard`` and ``slot``
are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import hash60, text_or_empty
from newsloom.session import materialise

LEAST = -(1 << 63)
#: Sampled rows per range; more make the ranges more even.
SAMPLED = 16
FAN_OUT = 32
BOUNDARY = "array<array<struct<h:bigint,t:bigint>>>"


def text_size(text: str = "text") -> Column:
    return F.octet_length(text_or_empty(text)).cast("long") + 1


def _at_or_below(boundary: Column, h: Column, t: Column) -> Column:
    return (boundary["h"] < h) | ((boundary["h"] == h) & (boundary["t"] <= t))


def range_of(boundaries: list[tuple[int, int]], h: Column, t: Column) -> Column:
    """Number of the range that holds key (h, t); two short scans in place of a long one."""
    groups = [boundaries[i:i + FAN_OUT] for i in range(0, len(boundaries), FAN_OUT)]
    nested = F.from_json(
        F.lit(json.dumps([[{"h": a, "t": b} for a, b in g] for g in groups])), BOUNDARY
    )
    firsts = F.from_json(
        F.lit(json.dumps([[{"h": g[0][0], "t": g[0][1]} for g in groups]])), BOUNDARY
    )
    group = F.size(F.filter(firsts[0], lambda b: _at_or_below(b, h, t)))
    within = F.size(F.filter(F.element_at(nested, group), lambda b: _at_or_below(b, h, t)))
    return (group - 1) * FAN_OUT + within - 1


def draw_boundaries(keys: DataFrame, total: int, parts: int, heavy: DataFrame) -> list[tuple[int, int]]:
    """Quantiles of a sample in which a key's chance is its size; at most ``parts`` of them.

    Only a heavy hash is cut by id.
    """
    rate = SAMPLED * parts / max(1, total)
    chance = F.col("size") * F.lit(rate)
    # The ends of a hash scramble bits the keys' own order does not use.
    uniform = F.pmod(F.xxhash64("h", "t", F.lit(total)), F.lit(1 << 30)) / float(1 << 30)
    sample = keys.filter(uniform < chance).select(
        "h", "t", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)).alias("weight")
    )
    cut = sample.join(F.broadcast(heavy.select("h", F.lit(True).alias("cut"))), "h", "left")
    cut = cut.withColumn("t", F.when(F.col("cut"), F.col("t")).otherwise(F.lit(LEAST)))
    in_order = Window.orderBy("h", "t")
    before = F.sum("weight").over(in_order) - F.col("weight")
    part = F.floor(before * parts / F.sum("weight").over(Window.partitionBy()))
    quantiles = cut.withColumn("part", part).groupBy("part").agg(
        F.min(F.struct("h", "t")).alias("first")
    )
    return [(r.first.h, r.first.t) for r in quantiles.select("first").collect()]


def find_ranges(keys: DataFrame, total: int, ranges: int, heavy: DataFrame):
    """Boundaries and the table (range, bytes, rows); no range is above twice its share
    unless a single key is."""
    goal = max(1, total // ranges)
    boundaries = sorted({(LEAST, LEAST), *draw_boundaries(keys, total, ranges, heavy)})
    while True:
        numbered = keys.withColumn("range", range_of(boundaries, F.col("h"), F.col("t")))
        sums = materialise(numbered.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
        ))
        overfull = sums.filter((F.col("bytes") > 2 * goal) & (F.col("rows") > 1))
        excess = overfull.agg(F.sum("bytes"), F.sum(F.ceil(F.col("bytes") / goal))).first()
        if excess[0] is None:
            return boundaries, sums
        inside = numbered.join(F.broadcast(overfull.select("range")), "range", "left_semi")
        finer = sorted({*boundaries, *draw_boundaries(inside, excess[0], 2 * excess[1], heavy)})
        if len(finer) == len(boundaries):
            return boundaries, sums
        boundaries = finer


def _keys(docs: DataFrame, id_col: str, text_col: str, taken: str = "") -> DataFrame:
    return docs.withColumns({
        f"{taken}h": hash60(text_or_empty(text_col)),
        f"{taken}t": F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST + 1)),
        f"{taken}size": text_size(text_col),
    })


def shard(
    docs: DataFrame, shards: int = 8, ranges_per_shard: int = 128,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with size, shard and slot; shards follow the order of keys.

    The driver holds the boundaries only, a few for each of ``shards * ranges_per_shard``
    ranges, and so many rows at most are broadcast.
    """
    keys = materialise(_keys(docs, id_col, text_col).select("h", "t", "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    goal = max(1, total // (shards * ranges_per_shard))
    heavy = materialise(
        keys.groupBy("h").agg(F.sum("size").alias("group_bytes"))
        .filter(F.col("group_bytes") > goal).select("h")
    )
    boundaries, sums = find_ranges(keys, total, shards * ranges_per_shard, heavy)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.select(
        "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    ))

    def placed(rows: DataFrame) -> DataFrame:
        ranged = rows.withColumn("_range", range_of(boundaries, F.col("_h"), F.col("_t")))
        in_range = Window.partitionBy("_range").orderBy("_h", "_t").rowsBetween(
            Window.unboundedPreceding, 0
        )
        in_group = Window.partitionBy("_range", "_h")
        ranged = ranged.withColumns({
            "_end": F.sum("_size").over(in_range), "_row": F.row_number().over(in_range),
        }).withColumns({
            "_group_start": F.min(F.col("_end") - F.col("_size")).over(in_group),
            "_group_size": F.sum("_size").over(in_group),
        })
        start = F.broadcast(starts.select(
            F.col("range").alias("_range"), F.col("bytes_before").alias("_bytes_before"),
            F.col("rows_before").alias("_rows_before"),
        ))
        cut = F.broadcast(heavy.select(F.col("h").alias("_h"), F.lit(True).alias("_cut")))
        # Twice the middle of what goes together: the row itself or its group.
        middle = F.when(F.col("_cut"), 2 * F.col("_end") - F.col("_size")).otherwise(
            2 * F.col("_group_start") + F.col("_group_size")
        ) + 2 * F.col("_bytes_before")
        number = F.floor(middle * shards / F.lit(2 * max(1, total)))
        return ranged.join(start, "_range").join(cut, "_h", "left").withColumns({
            "_shard": F.least(number, F.lit(shards - 1)).cast("int"),
            "_rank": F.col("_rows_before") + F.col("_row") - 1,
        })

    first = materialise(
        placed(keys.select(*[F.col(c).alias(f"_{c}") for c in keys.columns]))
        .groupBy("_shard").agg(F.min("_rank").alias("_first"))
    )
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    rows = placed(_keys(docs.select(*kept), id_col, text_col, "_"))
    return rows.join(F.broadcast(first), "_shard").select(
        *kept, F.col("_size").alias("size"), F.col("_shard").alias("shard"),
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"),
    )
