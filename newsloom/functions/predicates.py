"""Row predicates. Each is a plain column expression, so it can reach the scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from newsloom.constants import NEWS_DOMAIN, PENDING, SNAPSHOT_TTL_HOURS
from newsloom.functions.text import moment


def expired(
    time_created: Column, as_of: datetime | Column, ttl_hours: int = SNAPSHOT_TTL_HOURS
) -> Column:
    """Older than the time to live (exactly at the limit is still fresh), or absent.

    Absent counts as long ago, which keeps this one comparison: Spark takes a comparison
    as a reason to prune other tables' partitions by the tickers that pass it.
    """
    limit = moment(as_of) - F.expr(f"INTERVAL {int(ttl_hours)} HOURS")
    long_ago = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(time_created, long_ago) < limit


def needs_summary(content: Column) -> Column:
    return content == PENDING


def has_value(text: Column) -> Column:
    """Set to something other than the empty string and the pending mark."""
    return ~F.coalesce(text, F.lit("")).isin("", PENDING)


usable_file = has_value
usable_content = has_value


def news_link(href: Column, title: Column, domain: str = NEWS_DOMAIN) -> Column:
    return F.contains(href, F.lit(domain)) & (F.length(href) > 0) & (F.length(title) > 0)


def complete_request(user_id: Column, session_id: Column, ticker: Column) -> Column:
    return (F.length(user_id) > 0) & (F.length(session_id) > 0) & (F.length(ticker) > 0)
