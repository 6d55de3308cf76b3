"""The stages as streams: equal to the batch plans, also after a restart."""

import json
import os
import sys
import time
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators.jobs import latest_status
from newsloom.plans.annotate import one_by_one
from newsloom.sources.tables import create_tables, current_articles, read_table, write_batch
from newsloom.streaming import stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2024, 1, 2, 12, 0, 0)
NEWS = "https://sg.finance.yahoo.com/news/"
CSS = "subtle-link fin-size-small titles noUnderline yf-1btaiiq"
PROMPT = "Do it."


def summary(system, user):
    return "Summary: fine\nDate: 2024"


def insight(system, user):
    return '{"related_reason_simple": "Earnings"}'


class Deployment:
    def __init__(self, spark, folder):
        self.spark = spark
        self.root, self.messages, self.checkpoint = (
            str(folder / name) for name in ("tables", "messages", "checkpoints"))
        (folder / "messages").mkdir()
        self.folder = folder
        create_tables(spark, self.root)
        anchors = {t: "".join(f'<a class="{CSS}" href="{NEWS}{n}" title="About {n}"></a>' for n in names)
                   for t, names in {"A": ("one", "two"), "B": ("two", "three")}.items()}
        charts = spark.createDataFrame(
            [(t, t, datetime(2024, 1, 2), html) for t, html in anchors.items()], schemas.CHART_PAGES)
        news = spark.createDataFrame(
            [(f"/{n}", "A", datetime(2024, 1, 2), f"<main>A long enough text on {n}</main>", NEWS + n)
             for n in ("one", "two", "three")], schemas.NEWS_PAGES)
        charts.write.parquet(str(folder / "charts"))
        news.write.parquet(str(folder / "news"))

    def ask(self, name, *jobs):
        lines = [json.dumps({"job_id": job, "data": ticker, "seq": seq}) for seq, job, ticker in jobs]
        (self.folder / "messages" / f"{name}.json").write_text("\n".join(lines))

    def charts(self, spark):
        return spark.read.schema(schemas.CHART_PAGES).parquet(str(self.folder / "charts"))

    def news(self, spark):
        return spark.read.schema(schemas.NEWS_PAGES).parquet(str(self.folder / "news"))

    def run(self):
        spark, root, checkpoint = self.spark, self.root, self.checkpoint
        for query in (
            lambda: stages.start_ingest(
                spark, self.messages, root, checkpoint, self.charts, self.news, clock=lambda: NOW),
            lambda: stages.start_summaries(
                spark, root, checkpoint, self.news, PROMPT, one_by_one(summary), clock=lambda: NOW),
            lambda: stages.start_insights(
                spark, root, checkpoint, PROMPT, one_by_one(insight), clock=lambda: NOW),
            lambda: stages.start_status(spark, root, checkpoint),
        ):
            query().awaitTermination()

    def rows(self, table):
        return read_table(self.spark, self.root, table).collect()


def test_requests_flow_through_all_stages(spark, tmp_path):
    site = Deployment(spark, tmp_path)
    site.ask("first", (1, "j1", "A"), (2, "j2", "A"), (3, "j3", "NOPAGE"))
    site.run()
    assert {r.url[len(NEWS):] for r in site.rows("articles")} == {"one", "two"}
    assert {(r.url[len(NEWS):], r.ticker) for r in site.rows("fragments")} == {
        ("one", "A"), ("two", "A"),
    }
    status = {r.job_id: r.status for r in stages.live_status(spark, site.root).collect()}
    assert status == {"j1": "news crops ready", "j2": "news crops ready"}

    # After a restart: a new ticker that shares an article, a known one, and a repeated job.
    site.ask("second", (4, "j4", "B"), (5, "j5", "A"), (1, "j1", "A"))
    site.run()
    assert sorted(r.url[len(NEWS):] for r in site.rows("articles")) == ["one", "three", "two"]
    assert sorted((r.url[len(NEWS):], r.ticker) for r in site.rows("fragments")) == [
        ("one", "A"), ("three", "B"), ("two", "A"), ("two", "B"),
    ]
    assert sorted(r.ticker for r in site.rows("snapshots")) == ["A", "B"]
    status = {r.job_id: r.status for r in stages.live_status(spark, site.root).collect()}
    assert status == {job: "news crops ready" for job in ("j1", "j2", "j4", "j5")}
    events = [(r.job_id, r.status) for r in site.rows("job_status")]
    assert len(events) == len(set(events)) == 12
    final = current_articles(
        read_table(spark, site.root, "articles"), read_table(spark, site.root, "article_updates"))
    assert {r.summary for r in final.collect()} == {"fine"}

    # A file older than all before it, without sequence numbers, is not lost.
    late = tmp_path / "messages" / "late.json"
    late.write_text('{"job_id": "j6", "data": "B"}')
    old = time.time() - 3 * 24 * 3600
    os.utime(late, (old, old))
    site.run()
    status = {r.job_id: r.status for r in stages.live_status(spark, site.root).collect()}
    assert status["j6"] == "news crops ready"

    # Nothing new: running once more changes nothing.
    before = {t: len(site.rows(t)) for t in ("articles", "article_updates", "fragments", "job_status")}
    site.run()
    assert before == {t: len(site.rows(t)) for t in before}


def test_live_status_equals_batch_after_restart(spark, tmp_path):
    root, checkpoint = str(tmp_path / "tables"), str(tmp_path / "checkpoints")
    kinds = ["news ready x", "sumaries ready", "news crops ready", "Job failed: x"]
    rows = [(seq, f"j{seq % 37}", kinds[(seq * 7) % 4 if seq % 5 else 0], datetime(2024, 1, 1, seq % 3))
            for seq in range(400)]
    halves = rows[::2], rows[1::2]
    for batch, half in enumerate(halves):
        write_batch(spark.createDataFrame(half, schemas.JOB_STATUS), root, "job_status", "crawl", batch)
        stages.start_status(spark, root, checkpoint).awaitTermination()
    batch = latest_status(spark.createDataFrame(rows, schemas.JOB_STATUS))
    assert sorted(map(tuple, stages.live_status(spark, root).collect())) == sorted(map(tuple, batch.collect()))


def test_failed_batch_marks_its_jobs(spark, tmp_path, monkeypatch):
    root, checkpoint = str(tmp_path / "tables"), str(tmp_path / "checkpoints")
    create_tables(spark, root)
    requests = spark.createDataFrame([(1, "j", ["u"], "T", None)], schemas.STAGE_REQUESTS)
    write_batch(requests, root, "crop_requests", "summary", 0)

    def broken(*args, **kwargs):
        raise ValueError("table is gone")

    monkeypatch.setattr(stages, "extract_insights", broken)
    with pytest.raises(Exception):
        stages.start_insights(
            spark, root, checkpoint, PROMPT, one_by_one(insight), clock=lambda: NOW
        ).awaitTermination()
    assert [r.status for r in read_table(spark, root, "job_status").collect()] == [
        "Job failed: table is gone",
    ]
    # The batch is repeated at the next start, and then the job ends ready.
    monkeypatch.undo()
    stages.start_insights(
        spark, root, checkpoint, PROMPT, one_by_one(insight), clock=lambda: NOW
    ).awaitTermination()
    status = latest_status(read_table(spark, root, "job_status")).collect()
    assert [(r.job_id, r.status) for r in status] == [("j", "news crops ready")]


def test_once_per_request_drops_repeats_within_the_window(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("a", 0), ("a", 1), ("b", 2)], [("a", 3), ("c", 4)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in rows:
        df = spark.createDataFrame(part, "job_id string, hour int").select(
            "job_id", F.timestamp_seconds(F.lit(1704067200) + F.col("hour") * 3600).alias("arrived"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(df.schema).parquet(str(folder))
        stages.once_per_request(stream, ["job_id"]).writeStream.format("parquet").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_one_job_may_ask_for_two_tickers(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    lines = ['{"job_id": "j", "data": "A"}', '{"job_id": "j", "data": "B"}'] * 2
    (folder / "a.json").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    stages.crawl_requests(spark, str(folder)).select("job_id", "ticker").writeStream.format(
        "parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(
        availableNow=True).start(out).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("j", "A"), ("j", "B")]
