"""Text and time expressions. All of them are built-in column functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from newsloom.constants import (
    NOT_SPECIFIED, SHORT_LINE, STORY_BREAK, TIME_FORMAT, WHITESPACE,
)


def moment(as_of: datetime | Column) -> Column:
    """``as_of`` as a zone-free timestamp literal in whole seconds."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """``2024-1-5 3:04:05`` or ``2024-01-05 03:04:05`` to a timestamp, anything else to NULL."""
    shaped = text.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z")
    time = F.try_to_timestamp(text, F.lit("y-M-d H:m:s"))
    return F.when(shaped, time).cast("timestamp_ntz")


def format_time(time: Column) -> Column:
    return F.date_format(time, TIME_FORMAT)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def or_default(text: Column, default: str = "") -> Column:
    """``default`` in place of NULL and of the empty string."""
    return F.when(F.length(text) > 0, text).otherwise(F.lit(default))


def cut_story(text: Column) -> Column:
    """Everything before the first story break."""
    return F.substring_index(text, STORY_BREAK, 1)


def reflow(text: Column) -> Column:
    """Join lines: a blank before short lines and lines opening with ``)``, else a line break.

    The first line gets its separator too, so an empty text becomes one blank.
    """
    joins_up = rf"\n(?=\)|[^\n]{{0,{SHORT_LINE - 1}}}(?:\n|\z))"
    return F.regexp_replace(F.concat(F.lit("\n"), text), joins_up, " ")


def labelled_field(answer: Column, label: str, default: Column) -> Column:
    """Stripped rest of the first line that opens with ``label:`` in any letter case."""
    line = rf"(?i)(?:\A|\n){label}:([^\n]*)"
    return F.when(answer.rlike(line), strip(F.regexp_extract(answer, line, 1))).otherwise(default)


def summary_of(answer: Column) -> Column:
    return labelled_field(answer, "summary", answer)


def publish_date_of(answer: Column) -> Column:
    return F.when(answer.isNotNull(), labelled_field(answer, "date", F.lit("")))


def summary_prompt(content: Column) -> Column:
    return F.concat(
        F.lit("Content: "), content,
        F.lit("\n\nPlease provide a summary and infer the publication date.\n"),
    )


def insight_prompt(
    org: Column, ticker: Column, title: Column, publish_date: Column, content: Column,
    max_chars: int | None = None,
) -> Column:
    """The question about one company and one article.

    The whole content goes in. ``max_chars`` is for a model with an input limit; stored
    content is never cut.
    """
    asked = content if max_chars is None else F.substring(content, 1, max_chars)
    return F.concat(
        F.lit("Company: "), or_default(org, NOT_SPECIFIED),
        F.lit("\nTicker: "), ticker,
        F.lit("\nArticle Title: "), F.coalesce(title, F.lit("")),
        F.lit("\nPublication Date: "), or_default(publish_date, NOT_SPECIFIED),
        F.lit("\n\nNews Content:\n"), asked, F.lit("\n"),
    )
