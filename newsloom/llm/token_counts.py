"""Token counts through a cache keyed by digests of content and tokenizer.

Each distinct text is looked up by its SHA-256 among the counts stored for this version of
the tokenizer, which is the digest of its vocabulary file. Only distinct misses are encoded,
then appended to the cache. Texts are shuffled once, by digest and after a map-side combine,
so copies neither travel nor get encoded twice; counts go back to documents by a join of
narrow rows whose large side adaptive execution may split.

Content is not changed before it is digested, but for a null that becomes empty, because
every other change could change the count. The tokenizer sees whole texts, without added
special tokens; special strings inside a text count as the library's default says. A run
that is repeated after a failure at most appends equal counts again; reading ignores those.

Defined results: null and empty text have 0 bytes and 0 tokens; repeated rows and null ids
keep their rows; an empty table gives an empty table; extra columns stay, ``n_bytes`` and
``n_tokens`` are replaced.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm.common import file_digest, per_process, slices, text_or_empty
from newsloom.session import materialise

CACHE_SCHEMA = "content binary, n_tokens bigint, tokenizer string"
#: Bytes of text given to the library at once; bounds what it holds.
SLICE_BYTES = 256 << 10
#: A worker remembers about so many chunks, none longer than ``MEMO_CHARS``.
MEMO_CHUNKS = 1_000_000
MEMO_CHARS = 64


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Counts of one tokenizer version; the first use creates the table."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("append").partitionBy("tokenizer").parquet(folder)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(folder)
    return stored.filter(F.col("tokenizer") == version).groupBy("content").agg(
        F.min("n_tokens").alias("n_tokens")
    )


def splits_at_spaces(tokenizer) -> bool:
    """Whether no token ever spans a blank between two visible characters from its left side.

    True of byte-level vocabularies with the usual pattern: all its branches end before white
    space, and each takes one blank in front of what it matches.
    """
    rules = json.loads(tokenizer.to_str())
    cut = rules["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"])
        for t in rules["added_tokens"]
    )
    return bool(plain and added and rules["normalizer"] is None)


def encoder(vocabulary: str):
    """A function from texts to token counts; every token comes from the library.

    Where ``splits_at_spaces`` holds, a text is the sum of its chunks, each from a blank up to
    the next, and workers remember the counts of short ones. Otherwise texts go in whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encoded(texts):
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not splits_at_spaces(tokenizer):
        return encoded
    # U+180E was white space in old Unicode versions: no cut beside it.
    edge = re.compile("(?= [^\\s\u180e])(?<=[^\\s\u180e])")
    memo: dict[str, int] = {}

    def count(texts):
        chunks = [edge.split(text) for text in texts]
        unknown = list({c for part in chunks for c in part if c not in memo})
        known = dict(zip(unknown, encoded(unknown)))
        counts = [sum(memo[c] if c in memo else known[c] for c in part) for part in chunks]
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        memo.update((c, n) for c, n in known.items() if len(c) <= MEMO_CHARS)
        return counts
    return count


def _encode_misses(make_counter, vocabulary: str):
    def run(batches):
        import pyarrow as pa

        name = f"{make_counter.__module__}.{make_counter.__qualname__} of {vocabulary}"
        count = per_process(name, lambda: make_counter(vocabulary))
        for batch in batches:
            counts = batch.column("n_tokens").to_pylist()
            missing = [i for i, n in enumerate(counts) if n is None]
            texts = batch.column("text").take(pa.array(missing, pa.int64()))
            for start, part in slices(texts, SLICE_BYTES):
                for i, n in zip(missing[start:start + len(part)], count(part)):
                    counts[i] = n
            fresh = [False] * len(counts)
            for i in missing:
                fresh[i] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64()), pa.array(fresh)],
                names=["content", "n_tokens", "fresh"],
            )
    return run


def count_tokens(
    docs: DataFrame, vocabulary: str, cache: str, text_col: str = "text", make_counter=encoder,
) -> DataFrame:
    """``docs`` with n_bytes and n_tokens; adds the distinct misses to the table in ``cache``."""
    spark, version = docs.sparkSession, file_digest(vocabulary)
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    texts = docs.select(digest.alias("content"), text_or_empty(text_col).alias("text"))
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    looked_up = distinct.join(read_cache(spark, cache, version), "content", "left").select(
        "content", F.when(F.col("n_tokens").isNull(), F.col("text")).alias("text"), "n_tokens"
    )
    counts = materialise(looked_up.mapInArrow(
        _encode_misses(make_counter, vocabulary), "content binary, n_tokens bigint, fresh boolean"
    ))
    new = counts.filter("fresh").select("content", "n_tokens", F.lit(version).alias("tokenizer"))
    new.write.mode("append").partitionBy("tokenizer").parquet(cache)
    kept = docs.drop("n_bytes", "n_tokens")
    sized = kept.withColumns({
        "_content": digest, "n_bytes": F.octet_length(text_or_empty(text_col)).cast("long"),
    })
    found = counts.select(F.col("content").alias("_content"), "n_tokens")
    return sized.join(found, "_content").drop("_content")
