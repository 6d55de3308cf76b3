"""The jobs: what one run adds, that a second run adds nothing, and failures of the model."""

import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators.lookups import request_rows
from newsloom.operators.records import update_fields
from newsloom.plans.annotate import annotate, one_by_one
from newsloom.plans.ingest import ingest, ticker_news
from newsloom.plans.insights import extract_insights, insight_questions, pairs_to_ask
from newsloom.plans.read import job_cards
from newsloom.plans.summarise import summarise, summary_questions
from newsloom.sources.pages import page_path, read_pages, write_pages
from newsloom.sources.prompts import load_prompt, read_prompt_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2024, 1, 2, 12, 0, 0)
NEWS = "https://sg.finance.yahoo.com/news/"
CSS = "subtle-link fin-size-small titles noUnderline yf-1btaiiq"


def chart(*names):
    anchors = "".join(f'<a class="{CSS}" href="{NEWS}{n}" title="About {n}">x</a>' for n in names)
    return f'<div class="name yf-1c9i0iv" title="Org"></div>{anchors}'


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def answers(system_prompt, user_prompt):
    if "boom" in user_prompt:
        raise RuntimeError("no answer")
    return f"Summary: {len(user_prompt)} asked\nDate: today"


def insight(system_prompt, user_prompt):
    if "dull" in user_prompt:
        return '{"related_reason_simple": "no relation"}'
    if "broken" in user_prompt:
        return '{"related_reason_simple": '
    return '{"related_reason_simple": "Earnings", "polarity": null}'


def crawl(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.CRAWL_REQUESTS)


@pytest.fixture
def landed(spark):
    charts = spark.createDataFrame(
        [("old", "A", datetime(2024, 1, 1), chart("gone")),
         ("new", "A", datetime(2024, 1, 2), chart("one", "two", "one")),
         ("b", "B", datetime(2024, 1, 2), chart("two", "three"))], schemas.CHART_PAGES)
    text = "<main>The text of this page is {} indeed</main>"
    news = spark.createDataFrame(
        [(f"/{name}", "A", datetime(2024, 1, 2), text.format(word), NEWS + name)
         for name, word in (("one", "fine"), ("two", "boom"), ("three", "dull"))], schemas.NEWS_PAGES)
    return charts, news


def run_ingest(spark, landed, requests, snapshots=None, articles=None):
    charts, news = landed
    return ingest(
        requests, snapshots or empty(spark, schemas.CHART_SNAPSHOTS), charts, news,
        articles or empty(spark, schemas.ARTICLES), NOW,
    )


def test_ingest(spark, landed):
    requests = crawl(spark, (1, "j1", "A"), (2, "j2", "B"), (3, "j3", "A"), (4, "j4", "NOPAGE"))
    done = run_ingest(spark, landed, requests)
    found = {r.url[len(NEWS):]: (r.title, r.file_path, r.content) for r in done.articles.collect()}
    assert found == {
        name: (f"About {name}", f"/{name}", "pending") for name in ("one", "two", "three")
    }
    assert {r.ticker: [u[len(NEWS):] for u in r.url_keys] for r in done.snapshots.collect()} == {
        "A": ["one", "two"], "B": ["two", "three"],
    }
    assert {(r.job_id, r.ticker, r.org, len(r.urls)) for r in done.requests.collect()} == {
        ("j1", "A", "Org", 2), ("j2", "B", "Org", 2), ("j3", "A", "Org", 2),
    }
    assert {r.status for r in done.status.collect()} == {
        "news ready j1", "news ready j2", "news ready j3",
    }
    # Within the time to live the next run works from the stored snapshots alone.
    again = run_ingest(spark, landed, requests, done.snapshots, done.articles)
    assert again.articles.count() == again.snapshots.count() == 0
    assert {(r.job_id, len(r.urls)) for r in again.requests.collect()} == {
        ("j1", 2), ("j2", 2), ("j3", 2),
    }


def test_summaries_and_insights(spark, landed):
    requests = crawl(spark, (1, "j1", "A"), (2, "j2", "B"))
    news = run_ingest(spark, landed, requests)
    done = summarise(
        news.requests, news.articles, landed[1], "Sum up.", one_by_one(answers, 2), NOW
    )
    updates = {r.url[len(NEWS):]: (r.summary[-5:], r.publish_date) for r in done.updates.collect()}
    # The failed question leaves its article pending, the others are stored.
    assert updates == {"one": ("asked", "today"), "three": ("asked", "today")}
    articles = update_fields(news.articles, done.updates)
    assert {r.url[len(NEWS):] for r in articles.filter("content = 'pending'").collect()} == {"two"}
    again = summarise(
        news.requests, articles, landed[1], "Sum up.", one_by_one(answers), NOW
    )
    assert again.updates.count() == 0

    nothing = empty(spark, schemas.FRAGMENTS)
    insights = extract_insights(
        done.requests, articles, nothing, "Extract.", one_by_one(insight), NOW
    )
    rows = insights.fragments.collect()
    assert [(r.url[len(NEWS):], r.ticker, r.polarity, r.actual_trend, r.org) for r in rows] == [
        ("one", "A", None, "unknown", "Org"),
    ]
    assert {r.status for r in insights.status.collect()} == {"news crops ready"}
    # Stored pairs are not asked about again; "no relation" pairs are not stored, so they are.
    pairs = pairs_to_ask(request_rows(done.requests), insights.fragments)
    questions = insight_questions(pairs, articles).collect()
    assert [(q.url[len(NEWS):], q.ticker) for q in questions] == [("three", "B")]
    again = extract_insights(
        done.requests, articles, insights.fragments, "Extract.", one_by_one(insight), NOW
    )
    assert again.fragments.count() == 0 and again.status.count() == 2


def test_one_pair_wanted_by_two_jobs_gives_one_fragment(spark):
    articles = spark.createDataFrame(
        [(1, "u", "t", "", NOW, "content", "s", ""), (2, "v", "t", "", NOW, "broken", "s", ""),
         (3, "w", "t", "", NOW, "pending", "s", "")], schemas.ARTICLES)
    requests = spark.createDataFrame(
        [(2, "late", ["u", "u"], "T", "Second"), (1, "early", ["v", "u", "w"], "T", None)],
        schemas.STAGE_REQUESTS)
    done = extract_insights(
        requests, articles, empty(spark, schemas.FRAGMENTS), "x", one_by_one(insight), NOW)
    rows = done.fragments.collect()
    assert [(r.url, r.org, r.seq) for r in rows] == [("u", "", (1 << 20) + 1)]
    assert done.status.count() == 2


def test_annotator_that_raises_leaves_nulls(spark):
    def always(batch):
        raise RuntimeError

    questions = spark.createDataFrame([(1, "q"), (2, "r")], "id long, user_prompt string")
    assert {(r.id, r.answer) for r in annotate(questions, always, "s").collect()} == {
        (1, None), (2, None),
    }


def test_annotate_bounds_tasks_and_passes_both_prompts(spark):
    questions = spark.range(100).withColumn("user_prompt", F.col("id").cast("string"))
    asked = annotate(
        questions, one_by_one(lambda system, user: f"{system}/{user}", 4), "s", ["id"], tasks=3)
    assert asked.rdd.getNumPartitions() == 3
    assert {r.answer for r in asked.collect()} == {f"s/{i}" for i in range(100)}


def test_answers_are_kept(spark, tmp_path):
    """Using the result twice must not ask twice."""
    calls = str(tmp_path)

    def annotator(batch):
        import tempfile

        tempfile.mkstemp(dir=calls)
        return ["Summary: x"] * len(batch)

    articles = spark.createDataFrame(
        [(1, "u", "t", "p", NOW, "pending", "pending", "")], schemas.ARTICLES)
    pages = spark.createDataFrame([("p", "<main>Long enough text</main>")], "path string, html string")
    requests = spark.createDataFrame([(1, "j", ["u"], "T", None)], schemas.STAGE_REQUESTS)
    done = summarise(requests, articles, pages, "s", annotator, NOW)
    assert done.updates.count() == 1 and done.updates.collect()[0].summary == "x"
    assert update_fields(articles, done.updates).count() == 1
    assert len(list(tmp_path.iterdir())) == 1


def test_read_path(spark):
    jobs = spark.createDataFrame(
        [("done", "A"), ("busy", "A"), ("lost", "A"), ("none", "Z")], "job_id string, ticker string")
    events = spark.createDataFrame(
        [(1, "done", "news crops ready", NOW), (2, "busy", "sumaries ready", NOW),
         (3, "lost", "Job failed: x", NOW), (4, "none", "news crops ready", NOW)], schemas.JOB_STATUS)
    fragments = spark.createDataFrame(
        [(i, "", "A", f"u{i}", NOW, "r", "s", "p", "t", "up", "q") for i in range(12)],
        schemas.FRAGMENTS)
    shown = job_cards(jobs, events, fragments).collect()
    assert {(r.job_id, r.rn, r.source) for r in shown} == {
        ("done", i + 1, f"u{i}") for i in range(10)
    }


def test_prompts(spark):
    prompts = spark.createDataFrame(
        [("a", 1, "old"), ("a", 2, "\n new \t"), ("b", 9, "other")], schemas.PROMPTS)
    assert load_prompt(prompts, "a") == "new"
    with pytest.raises(FileNotFoundError):
        load_prompt(prompts, "missing")


def test_prompt_files(spark, tmp_path):
    (tmp_path / "summary.txt").write_text("\n Sum up:\n- é \n")
    (tmp_path / "crop.txt").write_text("other")
    assert load_prompt(read_prompt_files(spark, str(tmp_path)), "summary") == "Sum up:\n- é"


def test_wanted_tickers_prune_landed_pages(spark, tmp_path):
    """Neither stage reads the folders of tickers that nobody asks for."""
    stamp = datetime(2024, 1, 2)
    rows = spark.range(40).select(
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"),
        F.lit(stamp.isoformat(" ")).cast("timestamp_ntz").alias("downloaded_at"),
        F.lit("<main>Long enough a text</main>").alias("html"), F.lit("u").alias("url"),
    )
    name = page_path(F.lit("/raw"), F.col("ticker"), F.lit("news"), F.col("downloaded_at"))
    landed_pages = rows.withColumn("path", name).select(*schemas.NEWS_PAGES.names)
    write_pages(landed_pages, str(tmp_path / "pages"))
    pages = read_pages(spark, str(tmp_path / "pages"), schemas.NEWS_PAGES)
    path = landed_pages.filter("ticker = 'T7'").head().path
    articles = spark.createDataFrame(
        [(1, "u", "t", path, NOW, "pending", "pending", "")], schemas.ARTICLES)
    asked = spark.createDataFrame([("u",)], "url string")

    questions = summary_questions(asked, articles, pages, pages_by_ticker=True)
    assert [r.content for r in questions.collect()] == ["\nLong enough a text"]
    assert "dynamicpruning" in questions._jdf.queryExecution().executedPlan().toString()

    requests = crawl(spark, (1, "j", "T3"))
    news = ticker_news(requests, empty(spark, schemas.CHART_SNAPSHOTS), pages, NOW)
    assert [r.ticker for r in news.collect()] == ["T3"]
    assert "dynamicpruning" in news._jdf.queryExecution().executedPlan().toString()
