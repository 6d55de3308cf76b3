"""Key folders, winners chosen on narrow columns, the answer ledger and landed pages."""

import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from checks import views
from newsloom import schemas
from newsloom.operators.current import first_by, first_seq, latest_by, latest_seq
from newsloom.operators.lookups import known_pairs, only
from newsloom.operators.records import deleted_jobs
from newsloom.plans.ingest import ticker_news
from newsloom.plans.insights import extract_insights
from newsloom.plans.ledger import ask_once, known_answers
from newsloom.plans.summarise import summary_questions
from newsloom.session import OPEN_COST, for_small_files
from newsloom.sources.pages import land_pages, newest_pages, read_landed
from newsloom.sources.tables import create_tables, read_table, write_batch
from newsloom.streaming import stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2024, 1, 2, 12, 0, 0)
ARTICLE = "html/1", NOW, "some content", "s", ""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the scans of the last stage of ``df`` have opened."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.finalPhysicalPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles"))


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("site"))
    create_tables(spark, root)
    urls = [f"u{i}" for i in range(600)]
    articles = [(i, u, "t", *ARTICLE) for i, u in enumerate(urls)]
    write_batch(spark.createDataFrame(articles, schemas.ARTICLES), root, "articles", "crawl", 1)
    fragments = [(i, "o", "T", u, NOW, "r", "s", "p", "t", "up", "q") for i, u in enumerate(urls)]
    write_batch(spark.createDataFrame(fragments, schemas.FRAGMENTS), root, "fragments", "crop", 1)
    return root


@pytest.mark.parametrize("table", ["articles", "fragments"])
def test_a_few_keys_read_a_few_folders(spark, site, table):
    asked = spark.createDataFrame([("u7",), ("u8",), ("u7",), (None,)], "url string")
    found = only(read_table(spark, site, table, folders=True), asked, ["url"])
    assert sorted(r.url for r in found.collect()) == ["u7", "u8"]
    assert "dynamicpruning" in plan_of(found)
    assert files_read(found) <= 2
    assert not [name for name in found.columns if name.endswith("_folder")]


def test_pair_lookups_prune_too(spark, site):
    pairs = spark.createDataFrame([("u7", "T"), ("u9", "X")], "url string, ticker string")
    known = known_pairs(pairs, read_table(spark, site, "fragments", folders=True))
    assert [tuple(r) for r in known.collect()] == [("u7", "T")]
    assert "dynamicpruning" in plan_of(known)


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    root = str(tmp_path)
    create_tables(spark, root)
    rows = spark.createDataFrame([(i, f"u{i}", "t", *ARTICLE) for i in range(50)], schemas.ARTICLES)
    for part in (rows, rows.filter("seq < 20")):
        write_batch(part, root, "articles", "crawl", 3)
    assert read_table(spark, root, "articles").count() == 20
    write_batch(rows.filter("seq >= 20"), root, "articles", "crawl", 3, "append")
    assert read_table(spark, root, "articles").count() == 50
    assert read_table(spark, root, "articles", "crawl", 3).count() == 0


def versions(spark):
    rows = [(1, "a", 1, "x"), (2, "a", 3, "y"), (3, "a", 3, "z"), (4, "b", None, "n"), (5, "b", None, "m"),
            (6, None, 2, "k"), (7, None, 9, None)]
    return spark.createDataFrame(rows, "seq long, url string, hour int, content string").withColumn(
        "time", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, hour, 0, 0)"))


def test_winners(spark):
    df = versions(spark)
    newest = {r.url: (r.seq, r.content) for r in latest_by(df, ["url"], "time", columns=["seq", "content"]).collect()}
    assert newest == {"a": (2, "y"), "b": (4, "n"), None: (7, None)}
    first = {r.url: (r.seq, r.content) for r in first_by(df, ["url"], columns=["seq", "content"]).collect()}
    assert first == {"a": (1, "x"), "b": (4, "n"), None: (6, "k")}
    times = {r.url: r.time for r in latest_by(df, ["url"], "time", columns=["time"]).collect()}
    assert times["b"] is None and times["a"] == datetime(2024, 1, 1, 3)
    assert latest_by(df.limit(0), ["url"], "time").count() == 0


def test_winners_are_chosen_on_narrow_columns(spark, tmp_path):
    versions(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for chosen in (latest_seq(df, ["url"], "time"), first_seq(df, ["url"])):
        plan = plan_of(chosen)
        assert "content" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan
        assert "Sort [" not in plan
    # The wide rows meet a broadcast choice where they are read.
    fetched = latest_by(df, ["url"], "time")
    fetched.collect()
    assert "Exchange hashpartitioning" not in plan_of(fetched) and "BroadcastHashJoin" in plan_of(fetched)


def test_no_html_below_an_exchange(spark, tmp_path):
    """Both page lookups choose by path and time, and fetch html for what they chose."""
    rows = [(f"/r/T{i}/T{i}_TM_2024-01-0{d}_T_00-00-00.html", f"T{i}", datetime(2024, 1, d), f"<main>Text {i} {d}, long enough</main>")
            for i in range(9) for d in (1, 2)]
    rows.append(rows[-1])
    spark.createDataFrame(rows, "path string, ticker string, downloaded_at timestamp_ntz, html string").write.parquet(
        str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    asked = spark.createDataFrame([("T3",), ("T8",), ("none",)], "ticker string")
    newest = newest_pages(pages, asked, ["ticker"])
    assert sorted((r.ticker, r.html[6:14]) for r in newest.collect()) == [("T3", "Text 3 2"), ("T8", "Text 8 2")]
    single = newest.filter("ticker = 'T3'")
    single.collect()
    articles = spark.createDataFrame(
        [(1, "u", "t", rows[-1][0], NOW, "pending", "pending", ""), (2, "v", "t", rows[-1][0], NOW, "pending", "pending", "")],
        schemas.ARTICLES)
    questions = summary_questions(spark.createDataFrame([("u",), ("v",)], "url string"), articles, pages)
    assert sorted((r.url, r.content) for r in questions.collect()) == [
        ("u", "\nText 8 2, long enough"), ("v", "\nText 8 2, long enough")]


def test_asked_keys_travel_once(spark):
    hot = spark.createDataFrame([("j",)] * 500 + [("k",)], "job_id string")
    status = spark.createDataFrame([(1, "j", "x", NOW)], schemas.JOB_STATUS)
    assert {(r.job_id, r.removed) for r in deleted_jobs(status, hot).collect()} == {("j", 1), ("k", 0)}


# The ledger


def questions_of(spark, n):
    return spark.range(n).selectExpr("id as seq", "concat('u', id) as url", "'T' as ticker", "concat('q', id) as user_prompt")


def counting(folder, broken=()):
    """A model that leaves a file per question and fails on some."""
    folder = str(folder)

    def annotator(batch):
        import os
        import uuid

        for prompt in batch["user_prompt"]:
            with open(os.path.join(folder, f"{prompt}-{uuid.uuid4().hex}"), "w"):
                pass
        return [None if p in broken else f"answer to {p}" for p in batch["user_prompt"]]
    return annotator


def test_nothing_is_asked_twice(spark, tmp_path):
    model = counting(tmp_path, broken={"q3"})
    first = ask_once(questions_of(spark, 10), None, model, "s", NOW)
    ledger = first.entries
    assert ledger.count() == 10 and len(list(tmp_path.iterdir())) == 10
    again = ask_once(questions_of(spark, 12), ledger, model, "s", NOW, retry_failed=False)
    got = {r.url: (r.answer, r.outcome, r.reused) for r in again.rows.collect()}
    assert got["u1"] == ("answer to q1", "answered", True) and got["u3"] == (None, "failed", True)
    assert got["u11"] == ("answer to q11", "answered", False) and len(got) == 12
    assert sorted(r.url for r in again.entries.collect()) == ["u10", "u11"]
    assert len(list(tmp_path.iterdir())) == 12
    # What failed is asked again if wanted, and a changed prompt is another question.
    retried = ask_once(questions_of(spark, 10), ledger, counting(tmp_path), "s", NOW)
    assert [r.url for r in retried.entries.collect()] == ["u3"] and len(list(tmp_path.iterdir())) == 13
    both = ledger.unionByName(retried.entries)
    named = questions_of(spark, 10).join(both.select("url", "prompt").distinct(), "url")
    assert {r.outcome for r in known_answers(named, both, False).collect()} == {"answered"}
    assert ask_once(questions_of(spark, 10), ledger, model, "other", NOW).entries.count() == 10


def test_a_run_that_breaks_off_keeps_its_waves(spark, tmp_path):
    stored = []

    def store(entries):
        if len(stored) == 2:
            raise RuntimeError("stopped")
        stored.append(entries.collect())

    with pytest.raises(RuntimeError):
        ask_once(questions_of(spark, 40), None, counting(tmp_path), "s", NOW, waves=4, store=store)
    asked = len(list(tmp_path.iterdir()))
    ledger = spark.createDataFrame([r for rows in stored for r in rows], schemas.ANSWERS)
    done = ask_once(questions_of(spark, 40), ledger, counting(tmp_path), "s", NOW, waves=4)
    assert done.rows.count() == 40 and done.entries.count() == 40 - ledger.count()
    # Only the wave whose answers were not stored was asked again.
    assert len(list(tmp_path.iterdir())) == asked + 40 - ledger.count()


def test_counts_of_a_job(spark):
    articles = spark.createDataFrame(
        [(i, u, "t", "", NOW, c, "s", "") for i, (u, c) in enumerate(
            [("good", "news"), ("dull", "dull"), ("bad", "broken"), ("wait", "pending")])], schemas.ARTICLES)
    fragments = spark.createDataFrame([(1, "o", "T", "old", NOW, "r", "s", "p", "t", "up", "q")], schemas.FRAGMENTS)
    requests = spark.createDataFrame(
        [(1, "j", ["good", "dull", "bad", "wait", "old", "none", "good"], "T", None), (2, "k", ["good"], "T", None)],
        schemas.STAGE_REQUESTS)

    def model(batch):
        return ['{"related_reason_simple": "no relation"}' if "dull" in p else "{" if "broken" in p
                else '{"related_reason_simple": "x"}' for p in batch["user_prompt"]]

    done = extract_insights(requests, articles, fragments, "s", model, NOW)
    counts = {r.job_id: r.asDict() for r in done.counts.collect()}
    assert counts["j"] == {
        "seq": 1, "job_id": "j", "wanted": 7, "stored": 1, "no_content": 2, "asked": 4, "reused": 0,
        "answered": 2, "no_relation": 1, "failed": 1}
    assert counts["k"]["answered"] == counts["k"]["wanted"] == 1
    assert {r.outcome for r in done.entries.collect()} == {"answered", "no relation", "failed"}


# Landed pages


def test_landed_pages_are_read_once(spark, tmp_path):
    root = str(tmp_path / "pages")
    schema = "path string, html string, ticker string, kind string, downloaded_at timestamp_ntz"
    batch = spark.createDataFrame([("/a", "old", "T", "news", NOW), ("/b", "b", None, None, None)], schema)
    land_pages(batch, root, 0)
    land_pages(batch, root, 0)
    land_pages(spark.createDataFrame([("/a", "new", "T", "news", NOW), ("/c", "c", "U", "chart", NOW)], schema), root, 1)
    assert sorted((r.path, r.html) for r in read_landed(spark, root).collect()) == [("/a", "new"), ("/b", "b"), ("/c", "c")]
    assert [r.path for r in read_landed(spark, root, "chart").collect()] == ["/c"]
    news = ticker_news(
        spark.createDataFrame([(1, "j", "U")], schemas.CRAWL_REQUESTS), spark.createDataFrame([], schemas.CHART_SNAPSHOTS),
        read_landed(spark, root, "chart"), NOW)
    assert [r.ticker for r in news.collect()] == ["U"]


def test_landed_pages_lie_in_few_folders_that_lookups_prune(spark, tmp_path):
    """However many tickers a batch has; a ticker's lookups read its folder alone."""
    root = str(tmp_path / "pages")
    spark.conf.set("newsloom.keyFolders", "4")
    try:
        landed = spark.range(100).select(
            F.concat(F.lit("/"), "id").alias("path"), F.concat(F.lit("html "), "id").alias("html"),
            F.concat(F.lit("T"), "id").alias("ticker"), F.lit("chart").alias("kind"),
            F.lit(NOW.isoformat(" ")).cast("timestamp_ntz").alias("downloaded_at"))
        land_pages(landed, root, 0)
        assert len(list((tmp_path / "pages").glob("*/*/*.parquet"))) == 4
        wanted = spark.createDataFrame([("T7",), ("T8",), ("none",)], "ticker string")
        found = newest_pages(read_landed(spark, root), wanted, ["ticker"])
        assert sorted(map(tuple, found.collect())) == [("T7", "html 7"), ("T8", "html 8")]
        assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("newsloom.keyFolders")


def test_page_files_lie_in_few_folders_and_are_read_many_to_a_task(spark, tmp_path):
    """Names with any signs, rows without a text or a name, and repeats, each a file of its own."""
    rows = [("<a>", "/raw/T=1/T+1%20_TM.html"), ("<a>", "/raw/T=1/T+1%20_TM.html"), ("<b>", "/raw/T=1/T+1%20_TM.html"),
            (None, "/raw/notes \u00e9"), ("<c>", None)]
    rows += [(f"<{i}>", f"/raw/notes {i}") for i in range(300)]
    root = tmp_path.as_uri()
    views.write_page_files(spark.createDataFrame(rows, "html string, page string"), f"{root}/files/0")
    files = [f for f in (tmp_path / "files").rglob("*") if f.is_file()]
    assert len(files) == len(rows)
    assert len({f.parent for f in files}) <= 4 * spark.sparkContext.defaultParallelism * views.FOLDERS
    before = spark.conf.get(OPEN_COST)
    stages.start_landing(
        spark, f"{root}/files/*", f"{root}/pages", f"{root}/checkpoint", views.decoded_names, nested=True,
    ).awaitTermination()
    assert spark.conf.get(OPEN_COST) == before
    got = [(r.html, r.path) for r in read_landed(spark, f"{root}/pages").collect()]
    expected = [((html or "") + "\n", page or views.NO_PAGE) for html, page in rows]
    assert sorted(got) == sorted(expected)
    pages = for_small_files(spark).read.text(f"{root}/files/*", wholetext=True, recursiveFileLookup=True)
    assert pages.rdd.getNumPartitions() < len(rows) / 8
