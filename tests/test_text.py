"""Text, time, predicate and insight expressions against hand-written cases."""

import json
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsloom.constants import WHITESPACE
from newsloom.functions import insight, predicates, status, text


def values(spark, inputs, expression, dtype="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {dtype}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_whitespace_is_every_unicode_blank():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_reflow_cases(spark):
    cases = {
        "": " ",
        "a line of more than ten": "\na line of more than ten",
        "the first long line\n) closes": "\nthe first long line ) closes",
        "123456789": " 123456789",
        "1234567890": "\n1234567890",
        "😀23456789": " 😀23456789",
        "\n\n": "   ",
    }
    assert values(spark, list(cases), text.reflow) == list(cases.values())


def expected_reflow(whole):
    joined = ""
    for line in whole.split("\n"):
        joined += (" " if line.startswith(")") or len(line) < 10 else "\n") + line
    return joined


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="ab)\n\r é😀", max_size=40), min_size=100, max_size=100))
def test_reflow_and_strip_equal_brute_force(spark, texts):
    assert values(spark, texts, text.reflow) == [expected_reflow(t) for t in texts]
    assert values(spark, texts, text.strip) == [t.strip() for t in texts]


def test_cut_story_at_the_first_break(spark):
    assert values(spark, ["a Story continues b Story continues c", "none"], text.cut_story) == [
        "a ", "none",
    ]


def test_labelled_fields(spark):
    answers = [
        "Summary: a: b \nDate: 2024", "no fields", "date:\xa0x\nSUMMARY:\tone\nsummary: two",
        " Summary: blank first", "Summary:", "x\r\nSummary: y", None,
    ]
    assert values(spark, answers, text.summary_of) == [
        "a: b", "no fields", "one", " Summary: blank first", "", "y", None,
    ]
    assert values(spark, answers, text.publish_date_of) == ["2024", "", "x", "", "", "", None]


def test_parse_time(spark):
    texts = ["2024-01-05 03:04:05", "2024-1-5 3:4:5", "2024-01-05", "x", "", None]
    moment = datetime(2024, 1, 5, 3, 4, 5)
    assert values(spark, texts, text.parse_time) == [moment, moment, None, None, None, None]
    assert values(spark, texts[:1], lambda x: text.format_time(text.parse_time(x))) == texts[:1]


def test_expired_is_strict_and_missing_is_expired(spark):
    as_of = datetime(2024, 1, 2, 12, 0, 0)
    times = [as_of - timedelta(hours=24), as_of - timedelta(hours=24, seconds=1), as_of, None]
    found = values(spark, times, lambda t: predicates.expired(t, as_of), "timestamp_ntz")
    assert found == [False, True, False, True]


def test_has_value(spark):
    assert values(spark, ["x", "", "pending", None], predicates.has_value) == [
        True, False, False, False,
    ]


@pytest.mark.parametrize("answer, kept, polarity", [
    ('{"polarity": "up"}', True, "up"),
    ('{"related_reason_simple": "no relation"}', False, None),
    ('{"related_reason_simple": null, "polarity": null}', True, None),
    ('{"related_reason_simple": "x"}', True, "neutral"),
    ('{"polarity": "a", "polarity": "b"}', True, "b"),
    ('{"polarity": 1.5}', True, "1.5"),
    ("{}", False, None),
    ("[1]", None, None),
    ('{"polarity": "cut', None, None),
    ('{"polarity": "up"} tail', None, None),
    ('{"polarity": "up"} {"polarity": "up"}', None, None),
    ('{"polarity": "up"}, {}', None, None),
    ("null", None, None),
    ("", None, None),
    (None, None, None),
])
def test_insight(spark, answer, kept, polarity):
    parsed = insight.with_insight(spark.createDataFrame([(answer,)], "answer string"))
    row = parsed.select(
        insight.related(F.col("insight")).alias("kept"),
        insight.insight_field(F.col("insight"), "polarity").alias("polarity"),
    ).head()
    assert row.kept == kept
    if kept:
        assert row.polarity == polarity
        assert json.loads(answer).get("related_reason_simple") != "no relation"


def test_an_answer_is_parsed_once(spark):
    answers = spark.createDataFrame([('{"polarity": "up"}',)], "answer string")
    rows = insight.with_insight(answers).filter(insight.related(F.col("insight"))).select(
        *[insight.insight_field(F.col("insight"), key).alias(key) for key in insight.INSIGHT_DEFAULTS]
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_status_class_looks_anywhere_in_the_text(spark):
    cases = {
        "News Crops Ready": "done", "news ready a@b@C@1": "running", "Job failed: x": "failed",
        "news ready error@s@T@1": "failed", "nothing": "running", "sumaries ready": "running",
    }
    assert values(spark, list(cases), status.status_class) == list(cases.values())


def test_prompts_keep_whole_content_apart_from_the_model_limit(spark):
    long = "é" * 9000
    asked = values(spark, [long], text.summary_prompt)[0]
    assert long in asked
    found = values(spark, [long], lambda x: text.insight_prompt(
        F.lit(None).cast("string"), F.lit("T"), F.lit("title"), F.lit(""), x, 8000))[0]
    whole = values(spark, [long], lambda x: text.insight_prompt(
        F.lit(None).cast("string"), F.lit("T"), F.lit("title"), F.lit(""), x))[0]
    assert long in whole
    assert "é" * 8000 in found and "é" * 8001 not in found
    assert found.startswith("Company: Not specified\nTicker: T\n")
    assert "Publication Date: Not specified\n" in found


def test_years_have_four_digits(spark):
    texts = ["24-1-5 3:04:05", "12024-01-05 03:04:05", "-5-1-1 1:1:1", "2024-1-5 3:04:05 "]
    assert values(spark, texts, text.parse_time) == [None] * 4
