"""Live states: timers, what leaves the state, folds, and the profile kept up to date."""

import sys
import time
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.status import status_class
from newsloom.operators.jobs import latest_status, stuck_jobs
from newsloom.operators.reports import reason_profile
from newsloom.session import STATE_SLOTS
from newsloom.sources.tables import create_tables, last_fold, read_table, write_batch
from newsloom.streaming import live, stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

T0 = datetime(2024, 1, 1)
READY, FAILED, RUNNING = "news crops ready", "Job failed: x", "sumaries ready"


@pytest.fixture
def site(spark, tmp_path):
    root = str(tmp_path / "tables")
    create_tables(spark, root)
    return root


def events(spark, root, batch, *rows):
    write_batch(spark.createDataFrame(list(rows), schemas.JOB_STATUS), root, "job_status", "crawl", batch)


def status(spark, root):
    return {r.job_id: r.status for r in stages.live_status(spark, root).collect()}


def test_ended_jobs_leave_the_state_and_may_come_back(spark, site, tmp_path):
    def run(expire=1):
        query = stages.start_status(spark, site, str(tmp_path / "c"), expire_seconds=expire, fold_every=2)
        query.awaitTermination()
        return query.lastProgress

    events(spark, site, 1, (1, "done", READY, T0), (2, "lost", FAILED, T0), (3, "busy", RUNNING, T0))
    assert run()["stateOperators"][0]["numRowsTotal"] == 3
    time.sleep(2)
    events(spark, site, 2, (4, "busy", "news ready busy", T0 - timedelta(hours=1)))
    # The timers of the two that ended go off after a restart, without rows of their own.
    progress = run()
    assert progress["stateOperators"][0]["numRowsTotal"] == 1
    assert status(spark, site) == {"done": READY, "lost": FAILED, "busy": RUNNING}
    assert last_fold(spark, site, "live_status") >= 1
    # Late events of jobs whose state is gone change what they would have changed.
    events(spark, site, 3, (5, "done", RUNNING, T0 + timedelta(hours=1)), (6, "lost", RUNNING, T0 - timedelta(hours=1)),
           (7, "lost", "news ready", T0 + timedelta(hours=2)))
    run(10_000)
    assert status(spark, site) == {"done": READY, "lost": "news ready", "busy": RUNNING}
    events(spark, site, 4, (8, "new", READY, T0))
    run(10_000)
    last = last_fold(spark, site, "live_status")
    folded = spark.read.parquet(f"{site}/live_status/stage=folded/batch={last}")
    assert last >= 5 and folded.count() == folded.select("job_id").distinct().count() == 4
    everything = read_table(spark, site, "job_status")
    assert status(spark, site) == {r.job_id: r.status for r in latest_status(everything).collect()}


def test_a_repeated_fold_is_left_alone(spark, site):
    from newsloom.sources.tables import fold, newest_events, since_fold

    row = [("j", RUNNING, False, 1, T0)]
    write_batch(spark.createDataFrame(row, schemas.LIVE_STATUS), site, "live_status", "status", 5)
    for _ in range(2):
        fold(newest_events(since_fold(spark, site, "live_status")), site, "live_status", 5)
    assert [tuple(r) for r in since_fold(spark, site, "live_status").drop("batch").collect()] == row


def test_state_class_equals_the_column_function(spark):
    texts = [READY, READY.upper(), FAILED, "an ERROR", RUNNING, "", None, "failing news crops ready"]
    df = spark.createDataFrame([(t,) for t in texts], "status string")
    got = [r[0] for r in df.select(F.coalesce(status_class(F.col("status")), F.lit("running"))).collect()]
    assert got == [live.state_of(False, t) for t in texts]


def test_stuck_jobs_show_up_by_timer_and_go(spark, site, tmp_path):
    def run():
        stages.start_stuck(spark, site, str(tmp_path / "c"), max_files=None).awaitTermination()
        return {(r.job_id, r.submitted_at, r.status) for r in stages.live_stuck(spark, site).collect()}

    def at(seconds):
        return T0 + timedelta(seconds=seconds)

    def submit(batch, *rows):
        write_batch(spark.createDataFrame(list(rows), schemas.SUBMISSIONS), site, "submissions", "web", batch)

    submit(1, ("slow", at(0)), ("fast", at(0)), ("silent", at(10)), ("edge", at(50)))
    events(spark, site, 1, (1, "slow", RUNNING, at(20)), (2, "fast", READY, at(30)))
    assert run() == set()
    # Time goes on by other jobs' rows alone. Exactly 100 seconds are not yet too long.
    submit(2, ("other", at(150)))
    events(spark, site, 2, (3, "other", RUNNING, at(150)))
    assert run() == {("slow", at(0), RUNNING), ("silent", at(10), "nothing")}
    submissions, log = read_table(spark, site, "submissions"), read_table(spark, site, "job_status")
    assert run() == {tuple(r) for r in stuck_jobs(submissions, log, at(150)).select(
        "job_id", "submitted_at", "status").collect()}
    submit(3, ("other", at(151)))
    events(spark, site, 3, (4, "slow", READY, at(151)), (5, "other", RUNNING, at(151)))
    assert run() == {("silent", at(10), "nothing"), ("edge", at(50), "nothing")}


def test_profile_reads_new_fragments_only(spark, site, tmp_path):
    def write(batch, *rows):
        kept = [(i, None, t, f"u{batch}{i}", T0, r, "s", p, "t", "up", "q") for i, (r, p, t) in enumerate(rows)]
        write_batch(spark.createDataFrame(kept, schemas.FRAGMENTS), site, "fragments", "crop", batch)

    def run():
        query = stages.start_profile(spark, site, str(tmp_path / "c"), fold_every=2)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    write(1, ("a", "positive", "T"), ("a", "positive", "U"), (None, None, None))
    assert run() == 3
    write(2, ("a", "positive", "T"), (None, None, "V"))
    assert run() == 2
    write(3, ("a", "negative", "T"), ("a", "positive", "W"))
    assert run() == 2
    want = reason_profile(read_table(spark, site, "fragments")).collect()
    assert sorted(map(str, stages.live_profile(spark, site).collect())) == sorted(map(str, want))


@pytest.fixture
def one_slot(spark):
    spark.conf.set(STATE_SLOTS, "1")
    yield
    spark.conf.unset(STATE_SLOTS)


def test_jobs_share_a_slot_and_leave_it_one_by_one(spark, site, tmp_path, one_slot):
    """Python is called per slot, not per job."""
    def run():
        query = stages.start_status(spark, site, str(tmp_path / "c"), expire_seconds=1)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    events(spark, site, 1, *[(i, f"j{i}", READY if i % 2 else RUNNING, T0) for i in range(20)],
           (None, "j0", FAILED, T0), (20, None, FAILED, None))
    assert run() == 1
    time.sleep(2)
    events(spark, site, 2, *[(30 + i, f"j{i}", FAILED, T0 + timedelta(hours=1)) for i in range(0, 20, 2)])
    assert run() == 1
    time.sleep(2)
    events(spark, site, 3, (50, "j1", RUNNING, T0 + timedelta(hours=2)))
    run()
    everything = read_table(spark, site, "job_status")
    assert status(spark, site) == {r.job_id: r.status for r in latest_status(everything).collect()}
    rows = spark.read.parquet(f"{site}/live_status").filter("stage = 'status'").groupBy("job_id").count()
    assert {r.job_id: r["count"] for r in rows.collect()} == {
        None: 1, **{f"j{i}": 1 if i % 2 and i != 1 else 2 for i in range(20)}}


def test_stuck_jobs_of_one_slot(spark, site, tmp_path, one_slot):
    def run():
        query = stages.start_stuck(spark, site, str(tmp_path / "c"), expire_seconds=60)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
        return {(r.job_id, r.status) for r in stages.live_stuck(spark, site).collect()}

    def at(seconds):
        return T0 + timedelta(seconds=seconds)

    write_batch(spark.createDataFrame([("slow", at(0)), ("fast", at(0)), ("silent", at(10)), ("now", at(300))],
                                      schemas.SUBMISSIONS), site, "submissions", "web", 1)
    events(spark, site, 1, (1, "slow", RUNNING, at(20)), (2, "fast", READY, at(30)), (3, "now", RUNNING, at(300)))
    assert run() == {("slow", RUNNING), ("silent", "nothing")}
    write_batch(spark.createDataFrame([("now", at(301))], schemas.SUBMISSIONS), site, "submissions", "web", 2)
    events(spark, site, 2, (4, "slow", FAILED, at(301)))
    assert run() == {("silent", "nothing")}
