"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list has two kinds of entries: rules, a host with a path prefix that fits the host and all
its subdomains, and single canonical URLs. Each distinct URL is turned into the few keys that
could be listed: its own canonical form, and host suffix plus path prefix for every shape
(labels of the host, length of the path) that some rule has. Keys the filter may hold go on
to an exact join with the list, which removes false positives. Of the rules that fit, the
longest decides, host and path together, the longer host first among equals; where none
fits, a listed URL is blocked and any other allowed. An entry listed with both verdicts blocks.

A block of the filter is one row of eight words, and a key sets one bit in each word of one
block, so a test reads one row. The filter is broadcast while it is below ``MAX_BROADCAST``
bytes; above, Spark joins by block. All is DataFrame functions.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and
is allowed. Repeated URLs and ids each keep their row; an empty list allows all. Extra
columns stay; ``host``, ``path``, ``rule`` and ``verdict`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import ascii_lower
from newsloom.session import materialise

WORDS = 8
KEYS_PER_BLOCK = 40
BLOCK_BYTES = 80
MAX_BROADCAST = 16 << 20
OUTPUT = ["host", "path", "rule", "verdict"]
RULE, URL = "rule ", "url "


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without its default port, path or ``/``, and the query; no scheme or fragment.

    Empty where there is no host.
    """
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^#?]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, path, query)).otherwise("")


def rule_entries(rules: DataFrame) -> DataFrame:
    """List entries of rules (host, path, verdict)."""
    return rules.select(
        F.concat(F.lit(RULE), "host", "path").alias("key"), "verdict",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"),
    )


def url_entries(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """List entries that block single URLs."""
    return (
        urls.select(canonical(F.col(url_col)).alias("url")).filter(F.col("url") != "").distinct()
        .select(F.concat(F.lit(URL), "url").alias("key"), F.lit("block").alias("verdict"),
                F.lit(None).cast("int").alias("labels"),
                F.lit(None).cast("int").alias("path_length"))
    )


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: str, word: int) -> Column:
    """The bit a key has in a word of its block: six bits of a second hash for each word."""
    place = f"cast(shiftrightunsigned(xxhash64({key}, 'bits'), {6 * word}) & 63 as int)"
    return F.expr(f"shiftleft(1L, {place})")


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    return entries.groupBy(_block("key", blocks).alias("block")).agg(
        *[F.bit_or(_bit("key", w)).alias(f"word_{w}") for w in range(WORDS)]
    )


def possible_hits(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The ``keys`` that the filter may hold: every listed one and few others."""
    if blocks * BLOCK_BYTES <= MAX_BROADCAST:
        bloom = F.broadcast(bloom)
    found = F.lit(True)
    for w in range(WORDS):
        found = found & (F.col(f"word_{w}").bitwiseAND(_bit("key", w)) != 0)
    tested = keys.withColumn("block", _block("key", blocks)).join(bloom, "block")
    return tested.filter(found).select(*keys.columns)


def _candidates(urls: DataFrame, shapes: DataFrame) -> DataFrame:
    """Keys of each url that could be listed; ``rank`` orders rules by length, then host."""
    pairs = [(r.labels, r.path_length) for r in shapes.collect()]
    whole = urls.select(
        "url", F.concat(F.lit(URL), canonical(F.col("url"))).alias("key"),
        F.lit(0).cast("long").alias("host_length"), F.lit(0).cast("long").alias("path_length"),
    )
    if not pairs:
        return whole
    parsed = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shape = F.explode(F.array(*[
        F.struct(F.lit(a).alias("labels"), F.lit(b).alias("path_length")) for a, b in pairs
    ])).alias("shape")
    fits = (
        (F.size(F.split("host", r"\.")) >= F.col("shape.labels"))
        & (F.length("path") >= F.col("shape.path_length")) & (F.col("host") != "")
    )
    suffix = F.expr("substring_index(host, '.', -shape.labels)")
    prefix = F.expr("substring(path, 1, shape.path_length)")
    rules = parsed.select("url", "host", "path", shape).filter(fits).select(
        "url", F.concat(F.lit(RULE), suffix, prefix).alias("key"),
        F.length(suffix).cast("long").alias("host_length"),
        F.col("shape.path_length").cast("long").alias("path_length"),
    )
    return whole.unionByName(rules)


def filter_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, the rule that decides (or null) and the verdict.

    ``listed`` is a union of ``rule_entries`` and ``url_entries``. The driver holds the
    distinct shapes of the rules only, bounded by the longest rule, not by their number.
    """
    entries = materialise(
        listed.groupBy("key", "labels", "path_length").agg(
            F.max(F.col("verdict") == "block").alias("blocks")
        )
    )
    blocks = max(1, -(-entries.count() // KEYS_PER_BLOCK))
    shapes = entries.filter(F.col("labels").isNotNull()).select("labels", "path_length").distinct()
    urls = pages.select(F.col(url_col).alias("url")).filter(F.col("url").isNotNull()).distinct()
    hits = possible_hits(_candidates(urls, shapes), bloom_filter(entries, blocks), blocks)
    exact = hits.join(entries.select("key", "blocks"), "key")
    length = F.col("host_length") + F.col("path_length")
    rank = ((length * (1 << 20) + F.col("host_length")) * 2 + F.col("blocks").cast("int"))
    decided = materialise(
        exact.groupBy(F.col("url").alias("_url")).agg(F.max(rank).alias("_rank"))
    )
    kept = [c for c in pages.columns if c not in OUTPUT]
    joined = pages.select(*kept).join(decided, F.col(url_col) == F.col("_url"), "left")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    host_length = F.shiftright(F.col("_rank"), 1).bitwiseAND((1 << 20) - 1)
    path_length = F.shiftright(F.col("_rank"), 21) - host_length
    rule = F.concat(
        F.substr(host, F.length(host) - host_length + 1),
        F.substr(path, F.lit(1), path_length),
    )
    by_rule = F.col("_rank") > 1
    return joined.select(
        *kept, host.alias("host"), path.alias("path"), F.when(by_rule, rule).alias("rule"),
        F.when(F.col("_rank").bitwiseAND(1) == 1, "block").otherwise("allow").alias("verdict"),
    )
