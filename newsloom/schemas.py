"""Fixed table schemas. Every table carries ``seq``, its insertion order."""

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


STRING, LONG, TIME = T.StringType(), T.LongType(), T.TimestampNTZType()
URLS = T.ArrayType(STRING)

CHART_SNAPSHOTS = _table(
    ("seq", LONG), ("ticker", STRING), ("org", STRING), ("time_created", TIME), ("url_keys", URLS)
)
ARTICLES = _table(
    ("seq", LONG), ("url", STRING), ("title", STRING), ("file_path", STRING), ("create_time", TIME),
    ("content", STRING), ("summary", STRING), ("publish_date", STRING),
)
ARTICLE_UPDATES = _table(
    ("seq", LONG), ("url", STRING), ("content", STRING), ("summary", STRING), ("publish_date", STRING)
)
FRAGMENTS = _table(
    ("seq", LONG), ("org", STRING), ("ticker", STRING), ("url", STRING), ("time_created", TIME),
    ("related_reason_simple", STRING), ("related_reason_short", STRING), ("polarity", STRING),
    ("title", STRING), ("actual_trend", STRING), ("quote_frag", STRING),
)
JOB_STATUS = _table(("seq", LONG), ("job_id", STRING), ("status", STRING), ("time", TIME))
CRAWL_REQUESTS = _table(("seq", LONG), ("job_id", STRING), ("ticker", STRING))
STAGE_REQUESTS = _table(
    ("seq", LONG), ("job_id", STRING), ("urls", URLS), ("ticker", STRING), ("org", STRING)
)
CHART_PAGES = _table(("path", STRING), ("ticker", STRING), ("downloaded_at", TIME), ("html", STRING))
NEWS_PAGES = _table(
    ("path", STRING), ("ticker", STRING), ("downloaded_at", TIME), ("html", STRING), ("url", STRING)
)
PROMPTS = _table(("name", STRING), ("version", LONG), ("text", STRING))
ANSWERS = _table(
    ("seq", LONG), ("url", STRING), ("ticker", STRING), ("prompt", STRING), ("outcome", STRING),
    ("answer", STRING), ("time", TIME),
)
REJECTED = _table(("file", STRING), ("value", STRING), ("reason", STRING), ("time", TIME))
JOB_COUNTS = _table(
    ("seq", LONG), ("job_id", STRING), ("wanted", LONG), ("stored", LONG), ("no_content", LONG),
    ("asked", LONG), ("reused", LONG), ("answered", LONG), ("no_relation", LONG), ("failed", LONG),
)
LIVE_STATUS = _table(
    ("job_id", STRING), ("status", STRING), ("ready", T.BooleanType()), ("seq", LONG), ("time", TIME)
)
SUBMISSIONS = _table(("job_id", STRING), ("submitted_at", TIME))
STUCK_JOBS = _table(
    ("job_id", STRING), ("submitted_at", TIME), ("status", STRING), ("stuck", T.BooleanType())
)
_KIND = (("related_reason_simple", STRING), ("polarity", STRING), ("actual_trend", STRING))
PROFILE_COUNTS = _table(*_KIND, ("n", LONG))
PROFILE_TICKERS = _table(*_KIND, ("ticker", STRING))
RUN_COUNTS = _table(("name", STRING), ("value", LONG))
