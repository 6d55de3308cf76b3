"""A corpus pipeline out of the operators of ``newsloom.llm``: documents in, sequences out.

Each stage takes what the one before it kept, and all but the last return the columns of
documents. Stages define what nulls, empty texts, repeated rows and empty tables give in the
modules of their operators; rows without an id pass the join of n-grams. Every stage sets the
session's Arrow batches small, since workers hold whole texts by the batch.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from newsloom.session import configure, materialise


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality_rules.keep_good(docs, vocabulary("piece_bpe_32k.model"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return exact_dedup.deduplicate(docs, keep="largest")


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good_texts),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_of_alike),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenizers decide two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
