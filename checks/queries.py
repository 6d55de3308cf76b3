"""One query per operator on the test tables. ``oracle.py`` has the same in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import rules, views
from newsloom.constants import INSIGHT_INPUT_CHARS, LINKS_PER_PAGE
from newsloom.functions import insight, predicates, text
from newsloom.functions.links import capped_links, news_links
from newsloom.functions.status import job_failed, news_ready, status_class, summaries_ready
from newsloom.operators import current, jobs, lookups, records, reports
from newsloom import schemas
from newsloom.plans.annotate import annotate, one_by_one
from newsloom.plans.ingest import ChartLayout, Ingested, ingest
from newsloom.plans.insights import extract_insights
from newsloom.plans.read import job_cards
from newsloom.plans.summarise import summarise
from newsloom.session import materialise, scratch_folder
from newsloom.sources import html, messages, pages, prompts, tables
from newsloom.streaming import live, stages

STUCK_AT = datetime(2024, 1, 15)
PAGE_LAYOUT = ChartLayout(link_class=None, title_attr=None, domain="/")
MONTH = 24 * 30


# Sources and sinks


def _with_urls(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("urls", F.array_join("url_keys", "|")).drop("url_keys")


def snapshots_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_urls(records.snapshots(views.snapshots(spark, sf_dir), ""))


def snapshots_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_urls(records.snapshots(views.snapshots(spark, sf_dir), "T7"))


def append_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.snapshots(spark, sf_dir)
    added = views.crawls(spark, sf_dir).select(
        "seq", "ticker", F.col("job_id").alias("org"), F.array("job_id").alias("url_keys")
    )
    both = records.append(stored, records.new_snapshots(added, views.AS_OF))
    return _with_urls(both)


def append_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.page_articles(spark, sf_dir)
    added = views.word_articles(spark, sf_dir).withColumn("title", F.concat(F.lit("to "), "url"))
    return records.append(stored, records.new_articles(added, views.RUN_AT))


def append_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.fragments(spark, sf_dir)
    unstamped = stored.withColumn(
        "time_created", F.when(F.col("polarity") == "positive", F.col("time_created"))
    )
    both = records.append(stored, records.new_fragments(unstamped, views.RUN_AT))
    return both.withColumn("quote_frag", F.md5("quote_frag"))


def append_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.crawls(spark, sf_dir)
    news = records.new_status(asked, news_ready(F.col("job_id")), views.RUN_AT)
    summaries = records.new_status(asked, summaries_ready(), views.RUN_AT)
    failed = records.new_status(asked, job_failed(F.col("ticker")), views.RUN_AT)
    return records.append(views.status(spark, sf_dir), news, summaries, failed)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = materialise(records.collapse_updates(views.updates(spark, sf_dir)))
    updated = records.update_fields(views.articles(spark, sf_dir), last)
    return updated.select(
        "seq", "url", F.md5("content").alias("content_md5"), "summary", "publish_date"
    )


def upsert_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_asked = views.page_requests(spark, sf_dir).select(F.col("urls")[0].alias("url"))
    asked = views.updates(spark, sf_dir).select("url").unionByName(pages_asked)
    return records.update_report(views.articles(spark, sf_dir), asked)


def _jobs_to_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    signups = views.table(spark, sf_dir, "events").filter("event_type = 'signup'").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
        .alias("job_id")
    )
    return signups.unionByName(views.crawls(spark, sf_dir).select("job_id"))


def clear_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.delete_jobs(views.status(spark, sf_dir), _jobs_to_clear(spark, sf_dir))


def cleared_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.deleted_jobs(views.status(spark, sf_dir), _jobs_to_clear(spark, sf_dir))


def crawl_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.decode_crawl(messages.encode_crawl(views.crawls(spark, sf_dir)))


def stage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = messages.encode_stage(views.requests(spark, sf_dir))
    return lookups.request_rows(messages.decode_stage(sent)).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = views.word_pages(spark, sf_dir)
    kind = F.when(F.length("ticker") == 4, "chart").otherwise("news")
    built = landed.select(
        F.col("path").alias("id"),
        pages.page_path(F.lit("/raw"), F.col("ticker"), kind, F.col("downloaded_at")).alias("path"),
    )
    return pages.with_path_fields(built)


def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = prompts.current_prompts(views.prompts(spark, sf_dir)).select(
        F.col("text").alias("system")
    )
    system_prompt = prompts.load_prompt(views.prompts(spark, sf_dir), "insight")
    asked = views.articles(spark, sf_dir).withColumn("org", F.col("summary"))
    user = text.insight_prompt(*map(F.col, ("org", "url", "title", "publish_date", "content")), INSIGHT_INPUT_CHARS)
    answered = asked.select(
        "seq", F.md5(F.concat(F.lit(system_prompt), user)).alias("insight_md5"),
        F.md5(text.summary_prompt(F.col("content"))).alias("summary_md5"),
    )
    # The current prompt itself, as one more row.
    return answered.unionByName(
        system.select(F.lit(-1).cast("bigint").alias("seq"), F.md5("system").alias("insight_md5"),
                      F.lit("").alias("summary_md5"))
    )


# Predicates and projections


def freshness_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _freshness(spark, sf_dir, 24)


def freshness_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _freshness(spark, sf_dir, MONTH)


def _freshness(spark: SparkSession, sf_dir: str, ttl_hours: int) -> DataFrame:
    known = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker")
    )
    unknown = views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")
    )
    return lookups.snapshot_lookup(
        known.unionByName(unknown), views.snapshots(spark, sf_dir), views.AS_OF, ttl_hours,
        columns=("org", "seq"),
    )


def cached_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of the snapshots that are still fresh."""
    asked = views.crawls(spark, sf_dir)
    found = lookups.snapshot_lookup(asked, views.snapshots(spark, sf_dir), views.AS_OF, MONTH)
    return found.filter("not expired").select("ticker", F.explode("url_keys").alias("url"))


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.articles(spark, sf_dir).select(
        "seq", predicates.usable_file(F.col("file_path")).alias("usable_file"),
        predicates.usable_content(F.col("content")).alias("usable_content"),
    )


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = lookups.request_rows(views.requests(spark, sf_dir))
    return lookups.pending_urls(asked, views.articles(spark, sf_dir))


def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.status(spark, sf_dir).select("seq", "status")
    upper = own.select(
        (F.col("seq") + 1000000000).alias("seq"), F.upper("status").alias("status")
    )
    named = own.select(
        (F.col("seq") + 2000000000).alias("seq"),
        news_ready(F.concat(F.lit("Error"), F.col("status"))).alias("status"),
    )
    rows = own.union(upper).union(named)
    return rows.select("seq", status_class(F.col("status")).alias("state"))


def request_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.normalised(views.forms(spark, sf_dir))


def detail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = reports.details(views.fragments(spark, sf_dir))
    fields = schemas.FRAGMENTS.names
    return texts.select(F.json_tuple("detail", *fields).alias(*fields)).withColumns({
        "seq": F.col("seq").cast("bigint"), "time_created": F.col("time_created").cast("timestamp_ntz"),
        "quote_frag": F.md5("quote_frag"),
    })


# Joins


def first_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = lookups.request_rows(views.requests(spark, sf_dir))
    return lookups.first_articles(asked, views.articles(spark, sf_dir), ["seq", "title"])


def latest_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = lookups.request_rows(views.requests(spark, sf_dir))
    found = lookups.latest_articles(
        asked, views.articles(spark, sf_dir), ["seq", "title", "content"]
    )
    return found.select(
        "job_id", F.col("pos").cast("bigint").alias("pos"), "url", "article_seq", "title",
        F.md5("content").alias("content_md5"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.request_rows(views.requests(spark, sf_dir))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def fragment_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.fragment_exists(_pairs(spark, sf_dir), views.fragments(spark, sf_dir)).select(
        "seq", "job_id", "pos", "url", "ticker", "found"
    )


def stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.stored_pairs(_pairs(spark, sf_dir), views.fragments(spark, sf_dir)).select(
        "seq", "job_id", "pos", "url", "ticker"
    )


def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.new_pairs(_pairs(spark, sf_dir), views.fragments(spark, sf_dir)).select(
        "seq", "job_id", "pos", "url", "ticker"
    )


def _linked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked url once; kept, since a lookup reads it more than once and parsing is dear."""
    parsed = html.chart_links(
        views.news_pages(spark, sf_dir).select("path", "html"), link_class=None, title_attr=None
    )
    return materialise(parsed.select(F.explode("links.href").alias("url")).distinct())


def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _linked_urls(spark, sf_dir)
    return lookups.new_links(urls, views.word_articles(spark, sf_dir))


def attach_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _linked_urls(spark, sf_dir)
    return lookups.attach_pages(urls, views.word_pages(spark, sf_dir))


# Aggregates, windows, top-k


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.latest_by(
        views.snapshots(spark, sf_dir), ["ticker"], "time_created",
        columns=["seq", "org", "time_created"],
    )


def latest_article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.latest_by(
        views.articles(spark, sf_dir), ["url"], "create_time", columns=["seq", "title"]
    )


def first_article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current.first_by(views.articles(spark, sf_dir), ["url"], columns=["seq", "title"])


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.status(spark, sf_dir)
    asked = events.select("job_id").unionByName(views.crawls(spark, sf_dir).select("job_id"))
    return jobs.status_of(asked, events)


def all_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_status(views.status(spark, sf_dir))


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.history(views.status(spark, sf_dir))


def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.distinct_values(views.status(spark, sf_dir), "job_id")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.distinct_values(views.articles(spark, sf_dir), "url")


def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.status(spark, sf_dir)
    stage = F.when(F.col("status").startswith("news ready"), "summary").when(
        F.col("status") == "sumaries ready", "crop"
    ).otherwise("crawl")
    return jobs.queue_depth(events.select("job_id", stage.alias("stage")), events)


def stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.status(spark, sf_dir)
    submissions = events.select("job_id", F.col("time").alias("submitted_at"))
    return jobs.stuck_jobs(submissions, events, STUCK_AT)


def pair_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pair_counters(_pairs(spark, sf_dir), views.fragments(spark, sf_dir))


def saved_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.saved_counters(_pairs(spark, sf_dir), views.fragments(spark, sf_dir))


def snapshot_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.snapshot_sizes(views.snapshots(spark, sf_dir))


def shown_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shown_counters(views.fragments(spark, sf_dir))


def reason_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reason_profile(views.fragments(spark, sf_dir))


def top_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest insights of every ticker, as cards."""
    return reports.top_cards(views.fragments(spark, sf_dir))


def top_one_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = current.newest_of(views.fragments(spark, sf_dir), "ticker", "src3", "time_created")
    return newest.select("seq", "url", "time_created")


# Text functions


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    parts = [getattr(F, part)("ts").cast("string")
             for part in ("year", "month", "day", "hour", "minute", "second")]
    year, month, day, hour, minute, second = parts
    unpadded = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "),
                        hour, F.lit(":"), minute, F.lit(":"), second)
    written = F.when(F.col("event_type") == "error", F.col("props")).otherwise(unpadded)
    time = text.parse_time(written)
    return events.select("event_id", time.alias("t"), text.format_time(time).alias("formatted"))


def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    # A story break inside some texts, so that cutting shows.
    whole = F.when(F.col("doc_id") % 3 == 0, F.concat(
        "text", F.lit("\n)Story continues"), "source", F.lit("Story continues\n")
    )).otherwise(F.col("text"))
    flowed = text.reflow(text.cut_story(whole))
    return docs.select("doc_id", F.length(flowed).alias("n"), F.md5(flowed).alias("flowed_md5"))


def summary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.col("answer")
    return views.outputs(spark, sf_dir).select(
        "doc_id", F.md5(text.summary_of(answer)).alias("summary_md5"),
        text.publish_date_of(answer).alias("publish_date"),
    )


def insight_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = insight.with_insight(views.insights(spark, sf_dir), out="object")
    return parsed.filter(insight.related(F.col("object"))).select(
        "doc_id",
        *[insight.insight_field(F.col("object"), key).alias(key) for key in insight.INSIGHT_DEFAULTS],
    )


# Pages


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = html.chart_links(
        views.table(spark, sf_dir, "pages").select("page_id", "html"),
        link_class=None, title_attr=None,
    )
    kept = parsed.select("page_id", news_links(F.col("links"), "/t").alias("links"))
    return html.link_rows(kept).withColumn("pos", F.col("pos").cast("bigint"))


def links_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = html.chart_links(
        views.table(spark, sf_dir, "pages").select("page_id", "html"),
        link_class=None, title_attr=None,
    )
    capped = capped_links(news_links(F.col("links"), "/"), LINKS_PER_PAGE)
    rows = html.link_rows(parsed.select("page_id", capped.alias("links")))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def chart_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of chart pages in the default layout: news anchors of one class, titles from the
    attribute, next to others that are no news."""
    parsed = html.chart_links(views.chart_pages(spark, sf_dir))
    kept = parsed.select("page_id", "org", capped_links(news_links(F.col("links")), LINKS_PER_PAGE).alias("links"))
    return html.link_rows(kept).withColumn("pos", F.col("pos").cast("bigint"))


def chart_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisation each chart page names, NULL where it names none."""
    return html.chart_links(views.chart_pages(spark, sf_dir)).select("page_id", "org")


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the main element, between scripts, styles and comments."""
    read = html.article_text(views.main_pages(spark, sf_dir))
    return read.select("page_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html.article_text(
        views.table(spark, sf_dir, "pages").select("page_id", "html"), root="article"
    )
    return read.select("page_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


# Jobs


def _summarised(spark: SparkSession, sf_dir: str):
    return summarise(
        views.page_requests(spark, sf_dir), views.page_articles(spark, sf_dir),
        views.news_pages(spark, sf_dir), "Summarise.", rules.summary_rule, views.RUN_AT,
        root="article",
    )


def summarise_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summarised(spark, sf_dir).updates.select(
        "url", F.md5("content").alias("content_md5"), "summary", "publish_date"
    )


def summarise_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _summarised(spark, sf_dir)
    updated = records.update_fields(views.page_articles(spark, sf_dir), done.updates)
    return updated.select(
        "seq", "url", "title", F.md5("content").alias("content_md5"), "summary", "publish_date"
    )


def summarise_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summarised(spark, sf_dir).status


def _insights(spark: SparkSession, sf_dir: str):
    return extract_insights(
        views.requests(spark, sf_dir), views.articles(spark, sf_dir),
        views.fragments(spark, sf_dir), "Extract.", rules.insight_rule, views.RUN_AT,
    )


def insights_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insights(spark, sf_dir).fragments


def newest_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From requests to cards: what a run finds, next to what was stored, newest ten per ticker."""
    found = _insights(spark, sf_dir).fragments
    return reports.top_cards(records.append(views.fragments(spark, sf_dir), found))


def insights_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _insights(spark, sf_dir).status


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the third stage has counted itself while it wrote, over three batches."""
    root = _run_insights(spark, sf_dir)
    return tables.read_table(spark, root, "run_counts").groupBy("name").agg(F.sum("value").alias("value"))


def answer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each job's pairs: asked at first, once more without and with a second try
    of what failed. The second run asks nothing, the third only what failed."""
    # Three runs read them; the joins that make them are done once.
    asked, articles = materialise(views.requests(spark, sf_dir)), materialise(views.articles(spark, sf_dir))
    stored = materialise(views.fragments(spark, sf_dir).select("url", "ticker"))

    def run(ledger: DataFrame, retry_failed: bool):
        return extract_insights(
            asked, articles, stored, "Extract.", rules.insight_rule, views.RUN_AT,
            ledger=ledger, retry_failed=retry_failed, waves=2,
        )

    first = run(spark.createDataFrame([], schemas.ANSWERS), False)
    ledger = materialise(first.entries)
    runs = [first.counts, run(ledger, False).counts, run(ledger, True).counts]
    numbered = [counts.withColumn("run", F.lit(i + 1)) for i, counts in enumerate(runs)]
    return numbered[0].unionByName(numbered[1]).unionByName(numbered[2])


def annotate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions one by one to a model that fails on some: each loses its own answer only."""
    questions = views.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.concat("lang", F.lit(" "), F.col("doc_id").cast("string")).alias("user_prompt"))
    return annotate(questions, one_by_one(rules.brittle_model, 2), "System", ["doc_id"])


def annotate_broken_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a model for whole batches that fails on a batch if one question is bad."""
    questions = views.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.concat("lang", F.lit(" "), F.col("doc_id").cast("string")).alias("user_prompt"))
    return annotate(questions, rules.brittle_batches, "System", ["doc_id"])


def _ingested(spark: SparkSession, sf_dir: str) -> Ingested:
    return ingest(
        views.crawls(spark, sf_dir), views.snapshots(spark, sf_dir),
        views.news_pages(spark, sf_dir), views.word_pages(spark, sf_dir),
        views.word_articles(spark, sf_dir), views.AS_OF, MONTH, PAGE_LAYOUT,
    )


def ingest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).articles


def ingest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).snapshots.select(
        "seq", "ticker", "org", "time_created", F.posexplode_outer("url_keys").alias("pos", "url")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).requests.select(
        "seq", "job_id", "ticker", "org", F.posexplode_outer("urls").alias("pos", "url")
    ).withColumn("pos", F.col("pos").cast("bigint"))


def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).status


def read_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.status(spark, sf_dir)
    asked = views.table(spark, sf_dir, "events").join(
        views.table(spark, sf_dir, "documents"), F.col("event_id") == F.col("doc_id")
    ).select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
        .alias("job_id"),
        F.col("source").alias("ticker"),
    )
    return job_cards(asked, events, views.fragments(spark, sf_dir))


# Streams, run to the end of the tables


def stream_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live status over batches with a restart, folded after the second."""
    root = scratch_folder(spark)
    tables.create_tables(spark, root)
    _in_three(
        views.status(spark, sf_dir),
        lambda rows, n: tables.write_batch(rows, root, "job_status", "events", n),
        lambda: stages.start_status(
            spark, root, f"{root}/checkpoint", max_files=1, fold_every=2).awaitTermination(),
    )
    return stages.live_status(spark, root)


def stream_stuck_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live list of stuck jobs; timers put them there when time has passed."""
    root = scratch_folder(spark)
    tables.create_tables(spark, root)
    events = materialise(views.status(spark, sf_dir))
    # Time has to go on from file to file, so rows are cut by time here.
    timed = events.withColumn("order", F.col("seq")).withColumn("seq", live.micros_of(F.col("time")))

    def write(rows: DataFrame, n: int) -> None:
        tables.write_batch(rows.withColumn("seq", F.col("order")), root, "job_status", "events", n)
        tables.write_batch(
            rows.withColumn("submitted_at", F.col("time")), root, "submissions", "events", n)

    _in_three(timed, write, lambda: stages.start_stuck(
        spark, root, f"{root}/checkpoint", max_files=1).awaitTermination())
    limit = F.lit(STUCK_AT).cast("timestamp_ntz") - F.expr("INTERVAL 100 SECONDS")
    return stages.live_stuck(spark, root).filter(F.col("submitted_at") < limit)


def stream_unique_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of one user and day, each let through once."""
    root = scratch_folder(spark)
    arrivals = views.table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
        .alias("job_id"),
        F.col("ts").cast("timestamp").alias("arrived"),
    )
    arrivals.write.parquet(f"{root}/arrivals")
    stream = spark.readStream.schema(arrivals.schema).parquet(f"{root}/arrivals")
    written = stages.once_per_request(stream, ["job_id"]).select("job_id").writeStream.format("parquet")
    written.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(
        f"{root}/jobs"
    ).awaitTermination()
    return spark.read.schema("job_id string").parquet(f"{root}/jobs")


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that ask for several tickers; messages without a number, all of them sent twice."""
    root = scratch_folder(spark)
    sent = views.table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
        .alias("job_id"),
        F.concat(F.lit("T"), (F.col("event_id") % 5).cast("string")).alias("ticker"),
    )
    messages.encode_crawl(sent.unionAll(sent)).write.text(f"{root}/messages")
    stream = stages.crawl_requests(spark, f"{root}/messages").select("job_id", "ticker")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True
    ).start(f"{root}/requests").awaitTermination()
    return spark.read.schema("job_id string, ticker string").parquet(f"{root}/requests")


def _mixed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the messages is broken JSON, a third names no job."""
    kind, kept = F.col("event_id") % 3, F.col("event_type")
    value = (
        F.when(kind == 0, F.concat(F.lit("{"), kept))
        .when(kind == 1, F.concat(F.lit('{"data":"'), kept, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"job_id":"j","data":"'), kept, F.lit('"}')))
    )
    return views.table(spark, sf_dir, "events").select("event_id", value.alias("value"))


def rejected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.rejected(_mixed_messages(spark, sf_dir))


def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each kind of insight kept up to date over three batches, the first two of
    which are folded; no batch reads the fragments of another."""
    root = scratch_folder(spark)
    tables.create_tables(spark, root)
    rows = materialise(views.fragments(spark, sf_dir))
    for n in range(3):
        tables.write_batch(rows.filter(F.pmod("seq", F.lit(3)) == n), root, "fragments", "crop", n)
        stages.start_profile(spark, root, f"{root}/checkpoint", fold_every=2).awaitTermination()
    return stages.live_profile(spark, root)


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files through the landing stream, two thirds of them first; after a restart all of them
    once more from another folder. Each is read once."""
    root = scratch_folder(spark)
    named = views.page_files(spark, sf_dir)

    def land(files: DataFrame, n: int) -> None:
        views.write_page_files(files, f"{root}/files/{n}")
        stages.start_landing(
            spark, f"{root}/files/*", f"{root}/pages", f"{root}/checkpoint", views.decoded_names, nested=True,
        ).awaitTermination()

    land(named.filter("page_id % 3 < 2").select("html", "page"), 0)
    land(named.select("html", "page"), 1)
    return pages.read_landed(spark, f"{root}/pages").select(
        "path", "ticker", "kind", "downloaded_at", F.md5("html").alias("html_md5"))


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that the first stage left out, next to those it took, over several batches."""
    root = scratch_folder(spark)
    tables.create_tables(spark, root)
    _mixed_messages(spark, sf_dir).select("value").repartition(3).write.text(f"{root}/messages")
    stages.start_ingest(
        spark, f"{root}/messages", root, f"{root}/checkpoint",
        lambda session: views.news_pages(session, sf_dir),
        lambda session: views.word_pages(session, sf_dir),
        PAGE_LAYOUT, MONTH, clock=lambda: views.AS_OF, max_files=1,
    ).awaitTermination()
    return tables.read_table(spark, root, "rejected").select("value", "reason", "time")


def _added(spark: SparkSession, root: str, table: str, stage: str) -> DataFrame:
    rows = spark.read.schema(tables.stored_schema(table)).parquet(f"{root}/{table}")
    return rows.filter(F.col("stage") == stage).select(*tables.TABLES[table].names)


def _in_three(rows: DataFrame, write, run) -> None:
    """Two files and, after a restart, a third, each a batch of its own; a later one has later rows."""
    first, second = rows.approxQuantile("seq", [1 / 3, 2 / 3], 0.01) or (0, 0)
    write(rows.filter(F.col("seq") <= first).coalesce(1), 1)
    write(rows.filter((F.col("seq") > first) & (F.col("seq") <= second)).coalesce(1), 2)
    run()
    write(rows.filter(F.col("seq") > second).coalesce(1), 3)
    run()


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 1 as a stream over request messages, in batches with a restart; the articles it adds."""
    root = scratch_folder(spark)
    tables.create_tables(spark, root)
    stored = records.new_articles(
        views.word_articles(spark, sf_dir).withColumn("title", F.col("url")), views.AS_OF
    )
    tables.write_batch(stored, root, "articles", "start", 1)
    tables.write_batch(views.snapshots(spark, sf_dir), root, "snapshots", "start", 1)

    def run() -> None:
        stages.start_ingest(
            spark, f"{root}/messages/*", root, f"{root}/checkpoint",
            lambda session: views.news_pages(session, sf_dir),
            lambda session: views.word_pages(session, sf_dir),
            PAGE_LAYOUT, MONTH, clock=lambda: views.AS_OF, max_files=1,
        ).awaitTermination()

    _in_three(
        views.crawls(spark, sf_dir),
        lambda rows, n: messages.encode_crawl(rows).write.text(f"{root}/messages/{n}"), run)
    return _added(spark, root, "articles", "crawl")


def stream_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 2 as a stream over stage requests, in batches with a restart; the updates it logs."""
    root = scratch_folder(spark)
    tables.create_tables(spark, root)
    tables.write_batch(views.page_articles(spark, sf_dir), root, "articles", "start", 1)

    def run() -> None:
        stages.start_summaries(
            spark, root, f"{root}/checkpoint", lambda session: views.news_pages(session, sf_dir),
            "Summarise.", rules.summary_rule, "article", clock=lambda: views.RUN_AT, max_files=1,
        ).awaitTermination()

    _in_three(
        views.page_requests(spark, sf_dir),
        lambda rows, n: tables.write_batch(rows, root, "summary_requests", "start", n), run)
    return _added(spark, root, "article_updates", "summary").select(
        "url", F.md5("content").alias("content_md5"), "summary", "publish_date"
    )


def _run_insights(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_folder(spark)
    tables.create_tables(spark, root)
    tables.write_batch(views.articles(spark, sf_dir), root, "articles", "start", 1)
    tables.write_batch(views.fragments(spark, sf_dir), root, "fragments", "start", 1)

    def run() -> None:
        stages.start_insights(
            spark, root, f"{root}/checkpoint", "Extract.", rules.insight_rule,
            clock=lambda: views.RUN_AT, max_files=1,
        ).awaitTermination()

    _in_three(
        views.requests(spark, sf_dir),
        lambda rows, n: tables.write_batch(rows, root, "crop_requests", "start", n), run)
    return root


def stream_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 3 as a stream over stage requests, in batches with a restart; the fragments it adds."""
    return _added(spark, _run_insights(spark, sf_dir), "fragments", "crop")


QUERIES = {
    query.__name__: query
    for query in (
        top_fragments, top_one_ticker, snapshots_all, snapshots_ticker, append_snapshot,
        append_article, append_fragment, append_status, upsert, upsert_found, clear_jobs,
        cleared_jobs, crawl_messages, stage_messages, page_names, prompt, freshness_day,
        freshness_month, cached_urls, usable, pending, status_classes, request_forms, detail_json,
        first_article, latest_article, fragment_exists, stored_pairs, new_pairs, new_links,
        attach_pages, latest_snapshot, latest_article_rows, first_article_rows, job_status,
        all_job_status, job_history, job_ids, urls, queue_depth, stuck_jobs, pair_counters,
        saved_counters, shown_counters, snapshot_sizes, reason_profile, time_texts, reflow, summary_fields,
        insight_fields, links, links_capped, article_text, summarise_updates, summarise_articles,
        summarise_status, insights_fragments, newest_insights, insights_status, ingest_articles, ingest_snapshots,
        ingest_requests, ingest_status, read_cards, stream_job_status, stream_unique_jobs,
        stream_requests, rejected_messages,
        stream_ingest, stream_summaries, stream_insights,
        stream_stuck_jobs, stream_profile, stream_counters, answer_ledger, annotate_failures, annotate_broken_batches, stream_rejects, landed_pages,
        chart_news, chart_organisations, main_text,
    )
}
