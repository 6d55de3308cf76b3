"""Prompts are data: a table of (name, version, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions.text import strip
from newsloom.operators.current import latest_by


def read_prompt_files(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt texts kept as ``<folder>/<name>.txt``; the file's time is its version."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True)
    return files.select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("name"),
        F.unix_micros("_metadata.file_modification_time").alias("version"),
        F.col("value").alias("text"),
    )


def current_prompts(prompts: DataFrame) -> DataFrame:
    """Newest version of each prompt, stripped."""
    newest = latest_by(prompts, ["name"], "version", seq="version", columns=["version", "text"])
    return newest.withColumn("text", strip(F.col("text")))


def load_prompt(prompts: DataFrame, name: str) -> str:
    """The current text of one prompt: a single row, read once when a job is set up."""
    row = current_prompts(prompts.filter(F.col("name") == name)).head()
    if row is None:
        raise FileNotFoundError(f"no prompt named {name!r}")
    return row["text"]
