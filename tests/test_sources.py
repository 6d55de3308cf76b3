"""Messages, page files, landed pages and the batch-wise tables."""

from datetime import datetime

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.sources import messages, pages, tables

T0 = datetime(2024, 1, 2, 3, 4, 5)


def test_crawl_messages(spark):
    lines = ['{"job_id": "u@s@A@1", "data": "A"}', '{"job_id": "j", "data": "B", "seq": 7}',
             "not json", '{"data": "no job"}']
    rows = messages.decode_crawl(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {tuple(r) for r in rows.collect()} == {(None, "u@s@A@1", "A"), (7, "j", "B")}


def test_stage_messages_round_trip(spark):
    requests = spark.createDataFrame(
        [(1, "j", ["a", "b"], "T", None), (2, "k", [], "T", "Org \"x\"")], schemas.STAGE_REQUESTS)
    back = messages.decode_stage(messages.encode_stage(requests))
    assert sorted(back.collect()) == sorted(requests.collect())
    old = messages.encode_stage(requests.drop("seq")).first().value
    assert old == '{"job_id":"j","data":["a","b"],"ticker":"T","org":null}'


def test_normalised_requests(spark):
    forms = spark.createDataFrame(
        [(1, "u", "s", "0005.hk", "0a1b2c3d"), (2, "", "s", "A", "x"), (3, "u", None, "A", "x"),
         (4, "u", "s", "", "x")],
        "seq long, user_id string, session_id string, ticker string, suffix string")
    assert [tuple(r) for r in messages.normalised(forms).collect()] == [
        (1, "u@s@0005.HK@0a1b2c3d", "0005.HK"),
    ]
    suffix = spark.range(1).select(messages.random_suffix()).head()[0]
    assert len(suffix) == 8 and int(suffix, 16) >= 0


def test_page_files(spark, tmp_path):
    names = {
        "A/A_TM_2024-01-02_T_03-04-05.html": ("A", "chart", T0),
        "0005.HK/0005.HK_news_TM_2024-01-02_T_03-04-05.html": ("0005.HK", "news", T0),
        "A/B_TM_2024-01-02_T_03-04-05.html": (None, None, None),
        "A/other.html": (None, None, None),
    }
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"<p>\n{name}\n</p>\n")
    found = pages.read_page_files(spark, str(tmp_path)).collect()
    assert {(r.path.split(tmp_path.name + "/")[1], r.ticker, r.kind, r.downloaded_at) for r in found} == {
        (name, *fields) for name, fields in names.items()
    }
    assert all(r.html == f"<p>\n{r.path.split(tmp_path.name + '/')[1]}\n</p>\n" for r in found)


def test_page_path_is_read_back(spark):
    rows = spark.createDataFrame([("A", "chart", T0), ("B", "news", T0)],
                                 "t string, k string, d timestamp_ntz")
    built = rows.select("*", pages.page_path(F.lit("/raw"), F.col("t"), F.col("k"), F.col("d")).alias("path"))
    assert built.first().path == "/raw/A/A_TM_2024-01-02_T_03-04-05.html"
    back = pages.with_path_fields(built).filter("t = ticker and k = kind and d = downloaded_at")
    assert back.count() == 2


def test_landed_pages_prune_by_ticker(spark, tmp_path):
    rows = spark.createDataFrame([(f"/{i}", f"T{i % 3}", T0, "<p>") for i in range(30)], schemas.CHART_PAGES)
    pages.write_pages(rows, str(tmp_path / "pages"))
    back = pages.read_pages(spark, str(tmp_path / "pages"), schemas.CHART_PAGES)
    one = back.filter("ticker = 'T1'")
    assert one.count() == 10
    assert "PartitionFilters: [isnotnull(ticker" in one._jdf.queryExecution().toString()
    assert len([p for p in (tmp_path / "pages").iterdir() if p.name.startswith("ticker=")]) == 3


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    root = str(tmp_path)
    tables.create_tables(spark, root)

    def status(*jobs):
        return spark.createDataFrame([(1, job, "s", T0) for job in jobs], schemas.JOB_STATUS)

    def stored(**kwargs):
        return {r.job_id for r in tables.read_table(spark, root, "job_status", **kwargs).collect()}

    tables.write_batch(status("a", "b"), root, "job_status", "crawl", 0)
    tables.write_batch(status("other"), root, "job_status", "crop", 1)
    tables.write_batch(status("c"), root, "job_status", "crawl", 1)
    tables.write_batch(status("c", "d"), root, "job_status", "crawl", 1)
    assert stored() == {"a", "b", "c", "d", "other"}
    assert stored(stage="crawl", before=1) == {"a", "b", "other"}


def test_current_articles_apply_the_update_log(spark):
    articles = spark.createDataFrame(
        [(1, "a", "t", "", T0, "pending", "pending", ""), (2, "b", "t", "", T0, "pending", "pending", "")],
        schemas.ARTICLES)
    log = spark.createDataFrame(
        [(0, "a", "old", "s", "d"), (1, "a", "new", None, None)], schemas.ARTICLE_UPDATES)
    wanted = spark.createDataFrame([("a",)], "url string")
    assert [(r.url, r.content, r.summary) for r in
            tables.current_articles(articles, log, wanted).collect()] == [("a", "new", "s")]
    assert tables.current_articles(articles, log).count() == 2
    marked = tables.current_articles(articles, log, texts=False).collect()
    assert {(r.url, r.content) for r in marked} == {("a", tables.STORED), ("b", "pending")}


def test_rejected_messages_keep_text_and_reason(spark):
    sent = ['{"job_id": "j", "data": "T"}', "{", '{"data": "T"}', None, ""]
    found = messages.rejected(spark.createDataFrame([(s,) for s in sent], "value string"))
    assert sorted((r.value or "", r.reason) for r in found.collect()) == [
        ("", "not JSON"), ("", "not JSON"), ("{", "not JSON"), ('{"data": "T"}', "no job_id")]
