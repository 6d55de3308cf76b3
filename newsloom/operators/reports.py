"""Cards, details, run counters and the profile of each kind of insight."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.constants import FRAGMENTS_SHOWN, NOT_AVAILABLE
from newsloom.operators.current import newest_per_key
from newsloom.operators.lookups import fragment_exists


def cards(fragments: DataFrame) -> DataFrame:
    """What a reader sees of each fragment, numbered by its rank."""
    def shown(name: str):
        return F.coalesce(F.col(name), F.lit(NOT_AVAILABLE))

    return fragments.select(
        "rn",
        F.concat(F.lit("Insight "), F.col("rn"), F.lit(": "), shown("related_reason_simple"))
        .alias("heading"),
        shown("ticker").alias("ticker"),
        shown("related_reason_simple").alias("event"),
        shown("related_reason_short").alias("insight"),
        shown("polarity").alias("polarity"),
        shown("url").alias("source"),
    )


def top_cards(fragments: DataFrame, n: int = FRAGMENTS_SHOWN) -> DataFrame:
    return cards(newest_per_key(fragments, "ticker", "time_created", n))


def details(fragments: DataFrame) -> DataFrame:
    """Every field of each fragment as one JSON text."""
    return fragments.select(
        "seq", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("detail")
    )


def pair_counters(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Per job how many (url, ticker) pairs were asked for and how many of them are new."""
    return fragment_exists(pairs, fragments).groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(~F.col("found")).alias("new")
    )


def snapshot_sizes(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("seq", "ticker", F.size("url_keys").alias("n_links"))


def saved_counters(pairs: DataFrame, saved: DataFrame) -> DataFrame:
    """Per job the asked pairs and those that ended with a fragment."""
    return fragment_exists(pairs, saved).groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if("found").alias("saved")
    )


def shown_counters(fragments: DataFrame, n: int = FRAGMENTS_SHOWN) -> DataFrame:
    """Per ticker how many insights a reader is shown."""
    return fragments.groupBy("ticker").agg(F.least(F.count("*"), F.lit(n)).alias("shown"))


KIND = ["related_reason_simple", "polarity", "actual_trend"]


def profile_parts(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What some fragments add to the profile: counts per kind, and each kind's tickers once."""
    counts = fragments.groupBy(*KIND).agg(F.count("*").alias("n"))
    return counts, fragments.select(*KIND, "ticker").distinct()


def merged_parts(counts: DataFrame, tickers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of several batches as one."""
    return counts.groupBy(*KIND).agg(F.sum("n").alias("n")), tickers.select(*KIND, "ticker").distinct()


def profile_of(counts: DataFrame, tickers: DataFrame) -> DataFrame:
    """``reason_profile`` out of the parts of all fragments. Both sides are as small as the
    number of kinds and of kinds by ticker."""
    n, pairs = merged_parts(counts, tickers)
    seen = pairs.groupBy(*[F.col(name).alias(f"_{name}") for name in KIND]).agg(
        F.count("ticker").alias("n_tickers"))
    same = F.lit(True)
    for name in KIND:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return n.join(seen, same).select(*KIND, "n", "n_tickers")


def reason_profile(fragments: DataFrame) -> DataFrame:
    """How often each kind of insight occurs, with which effect, and for how many tickers."""
    return fragments.groupBy(*KIND).agg(
        F.count("*").alias("n"), F.countDistinct("ticker").alias("n_tickers")
    )
