"""Live job states as stateful operators: a job's state ends when the job does.

Both operators keep a few values per job and let timers drop them. What they emit is enough
to get the batch operators' results back, also for a job that is heard of again later.

Spark calls Python once per key of the state, which costs far more than a job's few values do. So
the key is a slot, and its state holds the jobs whose hash falls there (``session.state_slots``).
A slot with no jobs left leaves the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.constants import INSIGHTS_READY, NO_EVENTS, STUCK_AFTER_SECONDS
from newsloom.session import state_slots

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: A moment before all others, in microseconds.
LONG_AGO = -(1 << 61)
#: Stands for an absent ``seq``, which comes after all others.
NO_SEQ = 1 << 61
NEWEST = "ready:boolean,micros:bigint,seq:bigint,status:string"
CHANGED = "job_id string, status string, ready boolean, seq bigint, micros bigint"
STUCK = "job_id string, submitted bigint, status string, stuck boolean"


def micros_of(time: Column) -> Column:
    """A zone-free time as microseconds."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), time)


def time_of(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def state_of(ready: bool, status: str | None) -> str:
    """``functions.status.status_class`` of one job, inside a task."""
    text = (INSIGHTS_READY if ready else status or NO_EVENTS).lower()
    if INSIGHTS_READY in text:
        return "done"
    return "failed" if "fail" in text or "error" in text else "running"


def _merged(newest: tuple, micros: int, seq: int, status: str | None) -> tuple:
    """(ready, micros, seq, status) with one event more."""
    ready = newest[0] or status == INSIGHTS_READY
    if (micros, -seq) > (newest[1], -newest[2]):
        return ready, micros, seq, status
    return ready, *newest[1:]


NOTHING = (False, LONG_AGO - 1, 0, None)


def _rows(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[name].tolist() for name in names))


def _in_slots(rows: DataFrame) -> DataFrame:
    """Adds the slot of a job, and stands in for absent numbers, which pandas would make floats."""
    return rows.withColumns({
        "slot": F.pmod(F.xxhash64("job_id"), F.lit(state_slots(rows.sparkSession))),
        "micros": F.coalesce("micros", F.lit(LONG_AGO)),
        "seq": F.coalesce(F.col("seq").cast("bigint"), F.lit(NO_SEQ)),
    })


def _kept(state: GroupState, jobs: dict[str | None, tuple], timers: Callable[[tuple], int | None]) -> None:
    """Store the slot's jobs; the slot's timer is the earliest of theirs."""
    if not jobs:
        state.remove()
        return
    state.update(([(job, *values) for job, values in jobs.items()],))
    due = [timer for timer in map(timers, jobs.values()) if timer is not None]
    if due:
        state.setTimeoutTimestamp(max(min(due), state.getCurrentWatermarkMs() + 1))


def _stored(state: GroupState) -> dict[str | None, tuple]:
    return {job: tuple(values) for job, *values in state.get[0]} if state.exists else {}


def job_updates(events: DataFrame, expire_seconds: int) -> DataFrame:
    """Per job that has changed (job_id, status, ready, seq, micros): its newest event, and whether
    it ever was ready.

    A job that is done or has failed leaves the state once rows are seen ``expire_seconds`` after
    its last event was. If more follows, it starts anew; rows of both times together tell its
    status. Timers go by the time of processing, but as a watermark: timers by the clock would
    keep a run over what is available from ever ending.
    """
    names = ["job_id", "micros", "seq", "status", "seen"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, jobs, heard = state.getCurrentWatermarkMs(), _stored(state), {}
        for job, micros, seq, status, seen in () if state.hasTimedOut else _rows(batches, names):
            jobs[job] = (*_merged(jobs.get(job, NOTHING)[:4], micros, seq, status), None)
            heard[job] = max(seen, heard.get(job, 0))
        for job, seen in heard.items():
            ready, _, _, status, _ = jobs[job]
            if state_of(ready, status) != "running":
                jobs[job] = (*jobs[job][:4], max(watermark + 1, seen + expire_seconds * 1000))
        _kept(state, {job: values for job, values in jobs.items()
                      if job in heard or values[4] is None or values[4] >= watermark}, lambda values: values[4])
        if heard:
            changed = [(job, status, ready, seq, micros) for job in heard
                       for ready, micros, seq, status, _ in (jobs[job],)]
            yield pd.DataFrame(changed, columns=["job_id", "status", "ready", "seq", "micros"])

    rows = _in_slots(events.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds").select(
        "job_id", "seq", "status", micros_of(F.col("time")).alias("micros"), "arrived",
        F.unix_millis("arrived").alias("seen")))
    return rows.groupBy("slot").applyInPandasWithState(
        update, CHANGED, f"jobs array<struct<job_id:string,{NEWEST},due:bigint>>", "update",
        GroupStateTimeout.EventTimeTimeout,
    ).withColumn("seq", F.nullif(F.col("seq"), F.lit(NO_SEQ)))


def stuck_updates(
    submissions: DataFrame, events: DataFrame, lateness: str = "0 seconds",
    after_seconds: int = STUCK_AFTER_SECONDS, expire_seconds: int = 86_400,
) -> DataFrame:
    """Changes of the list of stuck jobs: (job_id, submitted, status, stuck).

    ``submissions`` (job_id, submitted_at) and ``events`` are streams. A job gets onto the list by a
    timer, with no input of its own, once event time has passed its submission by
    ``after_seconds`` and it is still running; it leaves the list when it is done or has failed.
    Rows more than ``lateness`` behind the newest are dropped. Jobs that ended leave the state
    ``expire_seconds`` later.
    """
    names = ["job_id", "micros", "seq", "status", "submitted"]
    unknown = (*NOTHING, None, False, None)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, jobs, heard = state.getCurrentWatermarkMs(), _stored(state), set()
        for job, micros, seq, status, asks in () if state.hasTimedOut else _rows(batches, names):
            *newest, submitted, listed, _ = jobs.get(job, unknown)
            if not asks:
                newest = _merged(tuple(newest), micros, seq, status)
            elif micros > LONG_AGO:
                submitted = micros if submitted is None else min(micros, submitted)
            jobs[job] = (*newest, submitted, listed, None)
            heard.add(job)
        changed = []
        for job, (ready, micros, seq, status, submitted, listed, timer) in list(jobs.items()):
            if job not in heard and (timer is None or timer >= watermark):
                continue
            running = state_of(ready, status) == "running"
            if job not in heard and not running:
                del jobs[job]
                continue
            due = None if submitted is None else submitted // 1000 + after_seconds * 1000
            stuck = running and due is not None and due < watermark
            timer = None
            if running and due is not None and not stuck:
                timer = max(due, watermark + 1)
            elif not running:
                timer = max(watermark + 1, micros // 1000 + expire_seconds * 1000)
            jobs[job] = (ready, micros, seq, status, submitted, stuck, timer)
            if stuck or listed:
                changed.append((job, submitted, INSIGHTS_READY if ready else status or NO_EVENTS, stuck))
        _kept(state, jobs, lambda values: values[6])
        if changed:
            yield pd.DataFrame(changed, columns=["job_id", "submitted", "status", "stuck"])

    def rows(stream: DataFrame, time: str, submitted: bool) -> DataFrame:
        seq, status = (F.col("seq"), F.col("status")) if not submitted else (F.lit(0), F.lit(None).cast("string"))
        return stream.select(
            "job_id", seq.cast("bigint").alias("seq"), status.alias("status"), F.lit(submitted).alias("submitted"),
            micros_of(F.col(time)).alias("micros"), F.col(time).cast("timestamp").alias("at"),
        ).withWatermark("at", lateness)

    both = _in_slots(rows(submissions, "submitted_at", True).unionByName(rows(events, "time", False)))
    return both.groupBy("slot").applyInPandasWithState(
        update, STUCK, f"jobs array<struct<job_id:string,{NEWEST},submitted:bigint,listed:boolean,due:bigint>>",
        "update", GroupStateTimeout.EventTimeTimeout)
