"""Mixing sources to target weights by thresholds on a hash, found in histograms.

Every document has a fixed hash. Sizes are summed by source and hash bucket, the bucket in
which a source's budget runs out is refined into smaller buckets, and so on, until the
boundary holds one document; all documents below the threshold are taken. Nothing is sorted
by document, each level is an aggregation that combines on the map side, and a larger budget
takes all that a smaller one took. What the boundary document leaves of a budget goes to
documents that still fit, by the same search (``top_ups`` times).

Defined results: a null text has size 0, a null source is a source of its own and comes
last. Documents with equal id and text share a hash, so they are taken together. An empty
table gives an empty table; a source without words has target 0. Extra columns stay; the
columns added are ``size``, ``source_size``, ``target`` and ``taken`` and replace any of
that name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.common import HASH_BITS, WORD, aside, hash60, text_or_empty
from newsloom.session import materialise

BITS = 10
OUTPUT = ["size", "source_size", "target", "taken"]


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def document_hash(id_col: str = "doc_id", text: str = "text") -> Column:
    return hash60(F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text_or_empty(text)
    ))


def targets(
    sources: DataFrame, weights: Sequence[int], share: float, most: int
) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    The ones with the least room for their weight fill up first. What is left when all that
    fill up are taken out, by the weight left, is the level of all others.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("room"), F.col("place")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("place", F.row_number().over(in_order))
        .withColumn("weight", F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1
        ))
        .withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("room", F.col("cap") / F.col("weight"))
    )
    level = (
        (F.sum("source_size").over(everything) * share
         - F.coalesce(F.sum("cap").over(by_room), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0)))
    )
    filled = ranked.withColumn("level", level).withColumn(
        "open", F.col("cap") > F.col("weight") * F.col("level")
    )
    common = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    return filled.select(
        "source", "source_size",
        F.when(F.col("open"), F.col("weight") * common).otherwise(F.col("cap")).alias("target"),
    )


def _find_cut(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash below which ``rows`` fit the budget, and what is left of it."""
    state = budgets.withColumns({"low": F.lit(0).cast("long"), "open": F.lit(True)})
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        within = (
            F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("s.open")
            & (F.col("hash") >= F.col("low"))
            & (F.col("hash") < F.col("low") + F.lit(1 << (shift + BITS)))
        )
        buckets = (
            rows.alias("r").join(state.alias("s"), within)
            .groupBy("s.source", "low", "budget",
                     F.shiftright(F.col("hash") - F.col("low"), shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        )
        before = F.sum("words").over(
            Window.partitionBy("source").orderBy("bucket")
        ) - F.col("words")
        boundary = (
            buckets.withColumn("before", before)
            .filter(F.col("before") + F.col("words") > F.col("budget"))
            .groupBy("source").agg(F.min(F.struct("bucket", "before", "docs")).alias("at"))
        )
        # Without a boundary all rows of the interval fit.
        total = buckets.groupBy("source").agg(F.sum("words").alias("fits"))
        state = materialise(
            state.alias("s")
            .join(boundary.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")), "left")
            .join(total.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left")
            .select(
                "s.source",
                F.when(~F.col("open"), F.col("low"))
                .when(F.col("at").isNull(), F.col("low") + F.lit(1 << (shift + BITS)))
                .otherwise(F.col("low") + F.shiftleft(F.col("at.bucket"), shift)).alias("low"),
                (F.col("budget") - F.when(~F.col("open"), 0)
                 .when(F.col("at").isNull(), F.coalesce("fits", F.lit(0)))
                 .otherwise(F.col("at.before"))).alias("budget"),
                (F.col("open") & F.col("at").isNotNull() & (F.col("at.docs") > 1)).alias("open"),
            )
        )
        if state.filter("open").isEmpty():
            break
    return state.select("source", F.col("low").alias("cut"), F.col("budget").alias("left"))


def _picked(cuts: int, size: str = "size", hashed: str = "hash", prefix: str = "") -> Column:
    """Whether a row is below one of the cuts; later ones are for rows that fit what was left."""
    any_cut = F.lit(False)
    for i in range(cuts):
        any_cut = any_cut | (
            (F.col(size) <= F.col(f"{prefix}limit_{i}"))
            & (F.col(hashed) < F.col(f"{prefix}cut_{i}"))
        )
    return any_cut


def thresholds(
    rows: DataFrame, weights: Sequence[int], share: float, most: int, top_ups: int
) -> tuple[DataFrame, int]:
    """Targets and cuts per source, from (source, hash, size) rows."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    size, target = F.col("source_size"), F.col("target")
    rounds = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    plan = materialise(
        targets(sums, weights, share, most).withColumn("rounds", rounds)
        .withColumn("left", F.floor(target - F.col("rounds") * size).cast("long"))
    )
    done = 0
    for i in range(1 + top_ups):
        known = rows.alias("r").join(
            plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
        )
        fits = known.filter(~_picked(done) & (F.col("size") <= F.col("left")) & (F.col("size") > 0))
        open_rows = (known if i == 0 else fits).select("r.source", "hash", "size")
        cut = _find_cut(open_rows, plan.select("source", F.col("left").alias("budget")))
        limit = F.lit((1 << 62)) if i == 0 else F.col("p.left")
        plan = materialise(
            plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")))
            .select(
                *[f"p.{c}" for c in plan.columns if c != "left"], limit.alias(f"limit_{i}"),
                F.col("cut").alias(f"cut_{i}"), "c.left",
            )
        )
        done += 1
    return plan, done


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2,
    top_ups: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``taken``: how many words of each the mix takes, repeats counted.

    Sources in order of code points weigh ``weights``, repeating, and share ``share`` times
    all sizes; no target is above ``most`` times its source's size. Reads the texts twice:
    once for the narrow table of hashes, once for the result.
    """
    sized = docs.drop(*OUTPUT).withColumns({
        "_size": word_count(text_col), "_hash": document_hash(id_col, text_col)
    })
    rows = materialise(sized.select(
        F.col(source_col).alias("source"), F.col("_hash").alias("hash"),
        F.col("_size").alias("size"),
    ))
    plan, cuts = thresholds(rows, weights, share, most, top_ups)
    return apply_thresholds(sized, plan, cuts, source_col)


def apply_thresholds(
    sized: DataFrame, plan: DataFrame, cuts: int, source_col: str = "source"
) -> DataFrame:
    """Filter by comparison with the cuts; needs ``_size`` and ``_hash``, drops them."""
    kept = [c for c in sized.columns if c not in ("_size", "_hash")]
    named = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    times = F.col("_mix_rounds") + _picked(cuts, "_size", "_hash", "_mix_").cast("long")
    return sized.join(named, F.col(source_col).eqNullSafe(F.col("_mix_source"))).select(
        *kept, F.col("_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_size") * times).alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its words are taken, none where they are not."""
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")
    return mixed.select("*", copies).drop(*OUTPUT, "_copy")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``."""
    moved, restored = aside(docs, OUTPUT)
    return restored(repeated(mix(moved, **options)))
