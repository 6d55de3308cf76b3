"""Exact duplicates: group by a 128-bit content hash and compare the bytes inside groups.

The grouping key is the hash and the normalised text itself, so rows share a group only if
their bytes are the same; a collision of hashes makes two groups. The aggregation combines
on the map side, so a group that holds a third of all rows reaches the shuffle as one row
per task. Texts are shuffled once, distinct ones only.

Defined results: a null text counts as empty. A null id is kept only where a group has no
other id. Rows that repeat both text and id are one document: the report marks each of them
as kept, ``deduplicate`` returns one of them. Empty tables give empty tables, other columns
pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsloom.llm.common import ascii_lower, text_or_empty
from newsloom.session import materialise

KEEP = {"smallest": (F.min, F.min_by), "largest": (F.max, F.max_by)}


def normalised(text: str = "text") -> Column:
    return ascii_lower(text_or_empty(text))


def duplicate_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Id, keep_id, group_size, kept and text_sha256 of every row.

    Rows find their group again by hash and SHA-256, which were both taken of the bytes
    that were compared.
    """
    pick = KEEP[keep][0]
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    groups = materialise(
        texts.groupBy(content_hash(F.col("norm")).alias("content"), "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), pick("id").alias("keep_id"))
        .select("content", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    rows = texts.select(
        "id", content_hash(F.col("norm")).alias("content"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    return rows.join(groups, ["content", "text_sha256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One whole row of every group, with the columns of ``docs``."""
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    norm = normalised(text_col)
    # Of rows with the same text and id the hash of all columns decides.
    order = F.struct(F.col(id_col), F.xxhash64(*plain))
    row = KEEP[keep][1](F.struct(*docs.columns), order).alias("row")
    return docs.groupBy(content_hash(norm), norm).agg(row).select("row.*")
