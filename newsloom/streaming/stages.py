"""The three stages and the job status as streaming queries.

Every stage runs its batch plan on each micro-batch and hands on through a table that
the next stage streams from. Delivery is at least once; each batch overwrites only its
own folders and reads the tables as they were before it, so repeats leave no trace.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.constants import SNAPSHOT_TTL_HOURS, STUCK_AFTER_SECONDS
from newsloom.functions.status import job_failed
from newsloom.functions.text import moment
from newsloom.operators.lookups import request_rows
from newsloom.operators.records import child_seq, new_status
from newsloom.operators.reports import KIND, merged_parts, profile_of, profile_parts
from newsloom.plans.annotate import Annotator
from newsloom.plans.ingest import ChartLayout, ingest
from newsloom.plans.insights import extract_insights
from newsloom.plans.summarise import summarise
from newsloom.session import for_small_files, materialise
from newsloom.sources.messages import decode_crawl, rejected
from newsloom.sources.pages import land_pages, with_path_fields
from newsloom.sources.tables import (
    TABLES, bounded, current_articles, current_status, current_stuck, fold, newest_events, read_table,
    since_fold, stream_table, write_batch,
)
from newsloom.streaming.live import job_updates, stuck_updates, time_of

DUPLICATE_WINDOW = "1 day"
COUNTED = ("wanted", "stored", "asked", "answered", "no_relation", "failed")
Clock = Callable[[], datetime]
Pages = Callable[[SparkSession], DataFrame]


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def once_per_request(
    requests: DataFrame, identity: Sequence[str], arrived: str = "arrived",
    within: str = DUPLICATE_WINDOW,
) -> DataFrame:
    """Drops a request whose ``identity`` columns repeat within the window; older ones leave
    the state. A job may ask for several things, so its id alone is not an identity.

    ``arrived`` should be the time of processing: rows behind the watermark are dropped, and
    a file may well be older than others that were read before it.
    """
    return requests.withWatermark(arrived, within).dropDuplicatesWithinWatermark(list(identity))


def message_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of the lines of JSON-lines files, with their file and when it was written."""
    return bounded(spark.readStream, max_files).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.unix_seconds("_metadata.file_modification_time").alias("second"),
    )


def crawl_requests(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of (seq, job_id, ticker, arrived) from JSON-lines files.

    Messages without a ``seq`` are ordered by the second their file was written in.
    """
    return _requests_of(message_lines(spark, folder, max_files))


def _requests_of(lines: DataFrame) -> DataFrame:
    requests = decode_crawl(lines.drop("file"))
    by_file = F.col("second") * 1000 + F.pmod(F.xxhash64("job_id", "ticker"), F.lit(1000))
    sent = requests.select(
        F.coalesce("seq", by_file).alias("seq"), "job_id", "ticker",
        F.current_timestamp().alias("arrived"), F.col("seq").alias("sent"),
    )
    # A message without seq is the same wherever it is repeated.
    return once_per_request(sent, ["job_id", "ticker", "sent"]).drop("sent")


def crawl_messages(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """``crawl_requests`` and, in the same batches, the messages that are none.

    The latter have their ``value``, ``file`` and ``reason`` and no request.
    """
    lines = message_lines(spark, folder, max_files)
    left_out = rejected(lines).select("value", "file", "reason", F.current_timestamp().alias("arrived"))
    return _requests_of(lines).unionByName(left_out, allowMissingColumns=True)


def stage_requests(
    spark: SparkSession, root: str, table: str, max_files: int | None = None
) -> DataFrame:
    """Stream of (seq, job_id, urls, ticker, org, arrived) that the stage before handed on."""
    rows = stream_table(spark, root, table, max_files).drop("stage", "batch")
    return once_per_request(
        rows.withColumn("arrived", F.current_timestamp()), ["job_id", "ticker", "seq"]
    )


def _start(
    stream: DataFrame, run: Callable[[DataFrame, int, int], None], checkpoint: str, name: str,
    trigger: dict,
) -> StreamingQuery:
    def run_kept(batch: DataFrame, batch_id: int) -> None:
        # The duplicate state is read and written once, however often the rows are used.
        taken = Observation()
        requests = materialise(batch.drop("arrived").observe(taken, F.count(F.lit(1)).alias("requests")))
        n_requests = taken.get["requests"]
        if n_requests:
            run(requests, batch_id, n_requests)

    return (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .foreachBatch(run_kept)
        .trigger(**trigger)
        .start()
    )


def start_ingest(
    spark: SparkSession, messages: str, root: str, checkpoint: str,
    chart_pages: Pages, news_pages: Pages, layout: ChartLayout = ChartLayout(),
    ttl_hours: int = SNAPSHOT_TTL_HOURS, clock: Clock = utc_now, trigger: dict | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Stage 1: crawl requests to articles, snapshots and summary requests.

    Messages that are no requests go to the table of rejected ones. ``max_files`` bounds how
    many message files one batch takes.
    """
    def run(messages: DataFrame, batch_id: int, n_messages: int) -> None:
        session = messages.sparkSession
        left_out = messages.filter("reason is not null").withColumn("time", moment(clock()))
        write_batch(left_out, root, "rejected", "crawl", batch_id)
        requests = messages.filter("reason is null").select("seq", "job_id", "ticker")
        if requests.isEmpty():
            return

        def table(name: str) -> DataFrame:
            return read_table(session, root, name, "crawl", batch_id, folders=True)

        done = ingest(
            requests, table("snapshots"), chart_pages(session),
            news_pages(session), table("articles"), clock(), ttl_hours, layout,
        )
        write_batch(done.articles, root, "articles", "crawl", batch_id)
        write_batch(done.snapshots, root, "snapshots", "crawl", batch_id)
        write_batch(done.status, root, "job_status", "crawl", batch_id)
        write_batch(done.requests, root, "summary_requests", "crawl", batch_id)

    return _start(
        crawl_messages(spark, messages, max_files), run, checkpoint, "ingest",
        trigger or {"availableNow": True},
    )


def start_summaries(
    spark: SparkSession, root: str, checkpoint: str, pages: Pages, system_prompt: str,
    annotator: Annotator, page_root: str = "main", tasks: int | None = None,
    pages_by_ticker: bool = False, clock: Clock = utc_now,
    trigger: dict | None = None, max_files: int | None = None, waves: int = 1,
) -> StreamingQuery:
    """Stage 2: summary requests to article updates and insight requests.

    Answers go to the ledger wave by wave, also those of a batch that fails later: what was
    asked once is not asked again when the batch is repeated.
    """
    def run(requests: DataFrame, batch_id: int, n_requests: int) -> None:
        session = requests.sparkSession
        articles = current_articles(
            read_table(session, root, "articles", folders=True),
            read_table(session, root, "article_updates", "summary", batch_id, folders=True),
            request_rows(requests), texts=False,
        )
        done = summarise(
            requests, articles, pages(session), system_prompt, annotator, clock(), page_root,
            tasks, pages_by_ticker, read_table(session, root, "answers", folders=True),
            waves=waves, store=lambda rows: write_batch(rows, root, "answers", "summary", batch_id, "append"),
        )
        logged = done.updates.withColumn("seq", F.lit(batch_id).cast("bigint"))
        write_batch(logged, root, "article_updates", "summary", batch_id)
        write_batch(done.status, root, "job_status", "summary", batch_id)
        write_batch(done.requests, root, "crop_requests", "summary", batch_id)

    return _start(
        stage_requests(spark, root, "summary_requests", max_files), run, checkpoint, "summaries",
        trigger or {"availableNow": True},
    )


def start_insights(
    spark: SparkSession, root: str, checkpoint: str, system_prompt: str, annotator: Annotator,
    tasks: int | None = None, max_chars: int | None = None, clock: Clock = utc_now,
    trigger: dict | None = None, max_files: int | None = None, waves: int = 1,
) -> StreamingQuery:
    """Stage 3: insight requests to fragments. A batch that fails marks its jobs as failed.

    The ledger is used as in stage 2; ``job_counts`` says what became of each job's pairs, and
    ``run_counts`` the same per batch.
    """
    def run(requests: DataFrame, batch_id: int, n_requests: int) -> None:
        session = requests.sparkSession
        try:
            articles = current_articles(
                read_table(session, root, "articles", folders=True),
                read_table(session, root, "article_updates", folders=True), request_rows(requests),
            )
            done = extract_insights(
                requests, articles, read_table(session, root, "fragments", "crop", batch_id, folders=True),
                system_prompt, annotator, clock(), tasks, max_chars,
                read_table(session, root, "answers", folders=True), waves=waves,
                store=lambda rows: write_batch(rows, root, "answers", "crop", batch_id, "append"),
            )
            # Spark counts what it writes while it writes it.
            saved, counted = Observation(), Observation()
            sums = [F.sum(name).alias(name) for name in COUNTED]
            write_batch(
                done.fragments.observe(saved, F.count(F.lit(1)).alias("saved")), root, "fragments", "crop", batch_id)
            write_batch(
                done.counts.observe(counted, *sums), root, "job_counts", "crop", batch_id)
            values = {"requests": n_requests, **counted.get, **saved.get}
            rows = [(name, value or 0) for name, value in values.items()]
            write_batch(session.createDataFrame(rows, TABLES["run_counts"]), root, "run_counts", "crop", batch_id)
            write_batch(done.status, root, "job_status", "crop", batch_id)
        except Exception as error:
            jobs = requests.select(child_seq(F.col("seq"), F.lit(3)).alias("seq"), "job_id")
            failed = new_status(jobs, job_failed(F.lit(str(error))), clock())
            write_batch(failed, root, "job_status", "crop-failed", batch_id)
            raise

    return _start(
        stage_requests(spark, root, "crop_requests", max_files), run, checkpoint, "insights",
        trigger or {"availableNow": True},
    )


def start_landing(
    spark: SparkSession, files: str, root: str, checkpoint: str,
    named: Callable[[DataFrame], DataFrame] = with_path_fields, max_files: int | None = None,
    trigger: dict | None = None, nested: bool = False,
) -> StreamingQuery:
    """Single page files, matched by the pattern ``files``, into the landed pages by ticker.

    With ``nested`` the pattern names folders, and all files below them are taken: executors list
    them then, while the driver alone works a pattern out. Every batch overwrites its own folder, and ``max_files`` bounds what it takes. ``named`` adds
    ticker, kind and download time to rows with a ``path``; files whose names say none of it are
    landed as rejected.
    """
    pages = bounded(for_small_files(spark).readStream, max_files).text(files, wholetext=True, recursiveFileLookup=nested).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))

    def run(batch: DataFrame, batch_id: int) -> None:
        land_pages(named(batch), root, batch_id)

    return (
        pages.writeStream.queryName("landing")
        .option("checkpointLocation", f"{checkpoint}/landing")
        .foreachBatch(run)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_status(
    spark: SparkSession, root: str, checkpoint: str, trigger: dict | None = None,
    max_files: int | None = None, expire_seconds: int = 86_400, fold_every: int = 100,
) -> StreamingQuery:
    """Live job status, each batch the jobs that changed.

    Jobs that ended leave the state ``expire_seconds`` later. Every ``fold_every`` batches the table
    is put together to one row per job.
    """
    events = stream_table(spark, root, "job_status", max_files).drop("stage", "batch")

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        write_batch(batch.withColumn("time", time_of(F.col("micros"))), root, "live_status", "status", batch_id)
        if batch_id % fold_every == fold_every - 1:
            fold(newest_events(since_fold(session, root, "live_status")), root, "live_status", batch_id)

    return (
        job_updates(events, expire_seconds)
        .writeStream.queryName("status")
        .option("checkpointLocation", f"{checkpoint}/status")
        .outputMode("update")
        .foreachBatch(run)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_status(spark: SparkSession, root: str) -> DataFrame:
    """Status per job as the status stream last saw it."""
    return current_status(since_fold(spark, root, "live_status"))


def start_stuck(
    spark: SparkSession, root: str, checkpoint: str, lateness: str = "0 seconds",
    after_seconds: int = STUCK_AFTER_SECONDS, expire_seconds: int = 86_400,
    trigger: dict | None = None, max_files: int | None = None,
) -> StreamingQuery:
    """Live list of stuck jobs, out of the tables of submissions and of status events."""
    submissions, events = (
        stream_table(spark, root, name, max_files).drop("stage", "batch") for name in ("submissions", "job_status"))

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("submitted_at", time_of(F.col("submitted")))
        write_batch(rows, root, "stuck_jobs", "stuck", batch_id)

    return (
        stuck_updates(submissions, events, lateness, after_seconds, expire_seconds)
        .writeStream.queryName("stuck")
        .option("checkpointLocation", f"{checkpoint}/stuck")
        .outputMode("update")
        .foreachBatch(run)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_stuck(spark: SparkSession, root: str) -> DataFrame:
    """The jobs that are stuck as the stream last saw them."""
    return current_stuck(since_fold(spark, root, "stuck_jobs"))


def start_profile(
    spark: SparkSession, root: str, checkpoint: str, trigger: dict | None = None,
    max_files: int | None = None, fold_every: int = 100,
) -> StreamingQuery:
    """The profile of each kind of insight, kept up to date from new fragments alone.

    Every batch adds its parts; every ``fold_every`` batches the parts are put together.
    """
    columns = [*KIND, "ticker"]
    fragments = stream_table(spark, root, "fragments", max_files).select(*columns)
    names = ("profile_counts", "profile_tickers")

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        for name, part in zip(names, profile_parts(materialise(batch))):
            write_batch(part, root, name, "profile", batch_id)
        if batch_id % fold_every == fold_every - 1:
            parts = merged_parts(*(since_fold(session, root, name) for name in names))
            for name, part in zip(names, parts):
                fold(part, root, name, batch_id)

    return (
        fragments.writeStream.queryName("profile")
        .option("checkpointLocation", f"{checkpoint}/profile")
        .foreachBatch(run)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_profile(spark: SparkSession, root: str) -> DataFrame:
    """``reason_profile`` of all fragments that the profile stream has seen."""
    return profile_of(*(since_fold(spark, root, name) for name in ("profile_counts", "profile_tickers")))
