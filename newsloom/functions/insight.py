"""The model's insight object: tolerant parsing, the relation test and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.constants import INSIGHT_DEFAULTS, NO_RELATION


def parse_insight(answer: Column) -> Column:
    """The objects of an answer, read as the elements of one array.

    Maps keep a missing key apart from an explicit null, which structs cannot. Reading the
    answer inside an array makes text after the object a syntax error instead of being
    passed over. NULL if the answer is not JSON.
    """
    as_list = F.concat(F.lit("["), answer, F.lit("]"))
    return F.from_json(as_list, "array<map<string,string>>")


def with_insight(answers: DataFrame, answer: str = "answer", out: str = "insight") -> DataFrame:
    """``answers`` with the insight as MAP<STRING, STRING>, NULL unless it is one object.

    Going through ``explode`` parses each answer once, however often filters and fields
    refer to it.
    """
    objects = F.col("_objects")
    parsed = answers.withColumn("_objects", F.explode(F.array(parse_insight(F.col(answer)))))
    single = F.when(F.size(objects) == 1, F.get(objects, F.lit(0)))
    return parsed.withColumn(out, single).drop("_objects")


def insight_value(insight: Column, key: str) -> Column:
    """The value under ``key``; of repeated keys the last one counts."""
    values = F.map_values(F.map_filter(insight, lambda name, _: name == key))
    return F.try_element_at(values, F.lit(-1))


def insight_field(insight: Column, key: str) -> Column:
    """Value with the default for a missing key; an explicit null stays null."""
    default = F.lit(INSIGHT_DEFAULTS[key])
    return F.when(F.map_contains_key(insight, key), insight_value(insight, key)).otherwise(default)


def related(insight: Column) -> Column:
    """A non-empty object that does not say it found no relation (no reason at all passes)."""
    reason = insight_value(insight, "related_reason_simple")
    return (F.size(insight) > 0) & ~reason.eqNullSafe(F.lit(NO_RELATION))
