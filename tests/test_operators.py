"""Ties, missing keys, heavy keys and plans of the table operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import current, jobs, lookups, records, reports
from newsloom.operators.spread import heavy_keys, spread_join
from newsloom.session import ROWS_PER_TASK, materialise

T0 = datetime(2024, 1, 1)


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tasks(spark):
    spark.conf.set(ROWS_PER_TASK, "50")
    yield
    spark.conf.unset(ROWS_PER_TASK)


def versions(spark, n=400, seed=1):
    """Rows with many equal times; a third of them belong to one key."""
    rng = random.Random(seed)
    rows = [
        (seq, "hot" if rng.random() < 0.34 else f"k{rng.randrange(20)}",
         T0 + timedelta(hours=rng.randrange(3)), f"v{seq}")
        for seq in range(n)
    ]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "seq long, k string, t timestamp_ntz, v string")


def test_latest_and_first_by_break_ties_by_insertion(spark):
    rows, df = versions(spark)
    latest, first = {}, {}
    for row in sorted(rows):
        seq, key, time, value = row
        if key not in latest or time > latest[key][0]:
            latest[key] = (time, seq, value)
        first.setdefault(key, (seq, value))
    found = {r.k: (r.t, r.seq, r.v) for r in current.latest_by(df, ["k"], "t").collect()}
    assert found == latest
    assert {r.k: (r.seq, r.v) for r in current.first_by(df, ["k"]).collect()} == first


@pytest.mark.parametrize("n", [1, 10, 120])
def test_newest_per_key(spark, n):
    rows, df = versions(spark)
    expected = set()
    for key in {row[1] for row in rows}:
        ordered = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2].timestamp(), r[0]))
        expected |= {(key, i + 1, row[0]) for i, row in enumerate(ordered[:n])}
    newest = current.newest_per_key(df, "k", "t", n)
    assert {(r.k, r.rn, r.seq) for r in newest.collect()} == expected
    # The limit is applied before the shuffle.
    plan = executed_plan(newest)
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_newest_of_keeps_n_per_task(spark):
    rows, df = versions(spark)
    newest = current.newest_of(df, "k", "hot", "t", 7)
    expected = sorted((r for r in rows if r[1] == "hot"), key=lambda r: (-r[2].timestamp(), r[0]))
    assert [r.seq for r in newest.collect()] == [r[0] for r in expected[:7]]
    assert "TakeOrderedAndProject" in newest._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, small_tasks, how):
    _, left = versions(spark, 600)
    nulls = spark.createDataFrame(
        [(10_000 + i, None, T0, "x") for i in range(70)], left.schema
    )
    left = left.unionByName(nulls)
    right = spark.createDataFrame(
        [("hot", 1), ("k1", 2), ("k2", 3), ("absent", 4), (None, 5)], "k string, w int"
    )
    heavy = {r.k: r._slices for r in heavy_keys(left, ["k"], 50).collect()}
    assert heavy["hot"] >= 3 and heavy[None] == 2 and "k1" not in heavy
    joined = spread_join(left, right, ["k"], how, spread_by=["seq"])
    plain = left.join(right, "k", how)
    assert joined.columns == plain.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_heavy_key_is_cut_into_slices(spark, small_tasks):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, left = versions(spark, 3000)
        right = left.select("k").distinct().withColumn("w", F.lit(1))
        joined = spread_join(left, right, ["k"], "inner", spread_by=["seq"])
        assert joined.count() == 3000
        assert "_slice" in executed_plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_heavy_key_leaves_an_ordinary_join(spark):
    _, left = versions(spark)
    right = left.select("k").distinct().withColumn("w", F.lit(1))
    plan = executed_plan(spread_join(left, right, ["k"], "inner"))
    assert "_slice" not in plan


def test_a_key_asked_for_again_and_again_is_one_row_of_the_lookup(spark):
    table = spark.range(100).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("url"))
    asked = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "7").otherwise((F.col("id") % 50).cast("string")).alias("url")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookups.only(table, asked, ["url"])
        assert found.count() == 50
        keys = spark.read.parquet(*found.inputFiles())
        assert keys.count() == keys.distinct().count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_adaptive_execution_splits_a_heavy_key_of_a_table(spark, tmp_path):
    """``only`` and ``update_fields`` leave both join sides fresh from a shuffle for this."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    rows = spark.range(20000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.sha2(F.col("id").cast("string"), 512).alias("content"),
        F.lit("").alias("summary"), F.lit("").alias("publish_date"),
    )
    rows.repartition(8).write.parquet(str(tmp_path / "articles"))
    articles = spark.read.parquet(str(tmp_path / "articles"))
    wanted = articles.select("url").filter("url = 'hot' or url like '1%'").distinct()
    wanted.write.parquet(str(tmp_path / "wanted"))
    wanted = spark.read.parquet(str(tmp_path / "wanted"))
    log = wanted.select(F.lit(1).alias("seq"), "url", F.lit("new").alias("content"),
                        F.lit("s").alias("summary"), F.lit(None).cast("string").alias("publish_date"))
    updates = materialise(records.collapse_updates(log))
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        kept = lookups.only(articles, wanted, ["url"])
        assert "skew=true" in executed_plan(kept)
        updated = records.update_fields(articles, updates)
        assert "skew=true" in executed_plan(updated)
        assert updated.count() == 20000
        assert updated.filter("content = 'new'").count() == kept.count()
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    _, df = versions(spark)
    df.withColumnRenamed("k", "ticker").withColumn("wide", F.lit("x")).write.parquet(
        str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = executed_plan(records.snapshots(table, "hot").select("seq", "ticker"))
    assert "PushedFilters: [IsNotNull(ticker), EqualTo(ticker,hot)]" in plan
    assert "ReadSchema: struct<seq:bigint,ticker:string>" in plan
    latest = current.latest_by(table, ["ticker"], "t", columns=["seq"])
    assert "wide" not in executed_plan(latest)


def test_child_seq_orders_and_refuses_overflow(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "seq long, pos int")
    made = [r[0] for r in df.select(records.child_seq(F.col("seq"), F.col("pos"))).collect()]
    assert made == sorted(set(made))
    too_many = spark.createDataFrame([(1, 1 << 20)], "seq long, pos int")
    with pytest.raises(Exception, match="more rows than seq"):
        too_many.select(records.child_seq(F.col("seq"), F.col("pos"))).collect()


def articles(spark, *rows):
    full = [
        (seq, url, title, "", T0 + timedelta(hours=hour), content, content, "")
        for seq, url, title, hour, content in rows
    ]
    return spark.createDataFrame(full, schemas.ARTICLES)


def test_update_fields_touches_every_row_and_reports(spark):
    table = articles(spark, (1, "a", "t", 0, "pending"), (2, "a", "t", 0, "x"), (3, "b", "t", 0, "y"))
    log = spark.createDataFrame(
        [(1, "a", "first", "s1", None), (2, "a", None, "s2", None), (3, "zz", "n", "n", "n")],
        schemas.ARTICLE_UPDATES,
    )
    updated = records.update_fields(table, records.collapse_updates(log))
    assert {(r.seq, r.content, r.summary, r.publish_date) for r in updated.collect()} == {
        (1, "first", "s2", ""), (2, "first", "s2", ""), (3, "y", "y", ""),
    }
    report = records.update_report(table, log)
    assert {(r.url, r.found) for r in report.collect()} == {("a", True), ("zz", False)}
    with pytest.raises(ValueError, match="no such columns"):
        records.update_fields(table, log, fields=["colour"])


def test_first_and_latest_article_differ(spark):
    table = articles(
        spark, (1, "a", "old", 0, "pending"), (2, "a", "new", 1, "text"), (3, "a", "tie", 1, "late"),
    )
    asked = spark.createDataFrame([("a",), ("a",), ("miss",)], "url string")
    first = {r.url: r.title for r in lookups.first_articles(asked, table, ["title"]).collect()}
    assert first == {"a": "old", "miss": None}
    latest = lookups.latest_articles(asked, table, ["title"]).collect()
    assert [(r.url, r.title) for r in latest] == [("a", "new"), ("a", "new")]
    assert [r.url for r in lookups.pending_urls(asked, table).collect()] == ["a"]


def test_new_pairs_keep_repeats(spark):
    pairs = spark.createDataFrame([(i, u, "T") for i, u in enumerate("aabbc")], "seq long, url string, ticker string")
    known = spark.createDataFrame([("b", "T"), ("a", "OTHER"), ("b", "T")], "url string, ticker string")
    assert sorted(r.seq for r in lookups.new_pairs(pairs, known).collect()) == [0, 1, 4]
    assert sorted(r.seq for r in lookups.stored_pairs(pairs, known).collect()) == [2, 3]


def events(spark, *rows):
    return spark.createDataFrame(
        [(seq, job, status, T0 + timedelta(seconds=at)) for seq, job, status, at in rows],
        schemas.JOB_STATUS,
    )


def test_job_status_rules(spark):
    log = events(
        spark, (1, "tie", "first", 5), (2, "tie", "second", 5), (3, "ready", "news crops ready", 1),
        (4, "ready", "Job failed: x", 9), (5, "colon:id", "news ready colon:id", 0),
    )
    asked = spark.createDataFrame([("tie",), ("ready",), ("none",), ("tie",)], "job_id string")
    assert {(r.job_id, r.status) for r in jobs.status_of(asked, log).collect()} == {
        ("tie", "first"), ("ready", "news crops ready"), ("none", "nothing"),
    }
    assert {r.job_id for r in records.distinct_values(log, "job_id").collect()} == {
        "tie", "ready", "colon:id",
    }


def test_history_is_newest_first_with_stable_ties(spark):
    log = events(spark, (1, "a", "x", 5), (2, "a", "y", 5), (3, "a", "z", 9), (4, "b", "w", 1))
    assert [r.seq for r in jobs.history(log, "a").collect()] == [3, 1, 2]
    assert [r.seq for r in jobs.history(log).collect()] == [3, 1, 2, 4]
    assert jobs.history(log, "unknown").collect() == []


def test_queue_depth_shows_empty_queues(spark):
    asked = spark.createDataFrame(
        [("crawl", "a"), ("crawl", "b"), ("crawl", "b"), ("summary", "a")], "stage string, job_id string")
    log = events(spark, (1, "a", "news ready a", 1), (2, "a", "sumaries ready", 2))
    assert {r.stage: r.n for r in jobs.queue_depth(asked, log).collect()} == {
        "crawl": 2, "summary": 0, "crop": 0,
    }


def test_stuck_jobs(spark):
    asked = spark.createDataFrame(
        [(job, T0) for job in ("silent", "running", "done", "failed")]
        + [("young", T0 + timedelta(seconds=1))], "job_id string, submitted_at timestamp_ntz")
    log = events(
        spark, (1, "running", "news ready running", 1), (2, "done", "news crops ready", 1),
        (3, "failed", "Job failed: x", 1),
    )
    stuck = jobs.stuck_jobs(asked, log, T0 + timedelta(seconds=101))
    assert {r.job_id for r in stuck.collect()} == {"silent", "running"}


def test_deletion_counts(spark):
    log = events(spark, (1, "a", "x", 1), (2, "a", "y", 2), (3, "b", "z", 3))
    gone = spark.createDataFrame([("a",), ("c",)], "job_id string")
    assert [r.seq for r in records.delete_jobs(log, gone).collect()] == [3]
    assert {(r.job_id, r.removed) for r in records.deleted_jobs(log, gone).collect()} == {
        ("a", 1), ("c", 0),
    }


def test_cards_fill_missing_values(spark):
    row = (1, None, None, "u", T0, "why", None, None, "t", "up", "q")
    shown = reports.top_cards(spark.createDataFrame([row], schemas.FRAGMENTS)).head()
    assert (shown.ticker, shown.insight, shown.polarity, shown.heading) == (
        "N/A", "N/A", "N/A", "Insight 1: why",
    )


@pytest.mark.parametrize("seq", [1 << 44, 1 << 45, -(1 << 44)])
def test_child_seq_refuses_a_seq_it_has_no_room_for(spark, seq):
    df = spark.createDataFrame([(seq, 1)], "seq long, pos int")
    with pytest.raises(Exception, match="out of range"):
        df.select(records.child_seq(F.col("seq"), F.col("pos"))).collect()


def test_every_heavy_key_is_cut_into_slices(spark):
    left = spark.range(6000).select((F.col("id") % 1500).alias("k"), "id")
    assert heavy_keys(left, ["k"], 2).count() == 1500
