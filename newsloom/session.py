"""Session settings the jobs rely on, and the one place where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keep the map-side limit of newest-N reports for every N that is still a report.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Job state of a long-running stream outgrows the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch stores what it changed, not a copy of the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Thousands of files are listed by some tasks, not by a task each.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # Pages vary from hundreds of characters to megabytes: bound Python batches by size too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}

ROWS_PER_TASK = "newsloom.rowsPerTask"
KEY_FOLDERS = "newsloom.keyFolders"
STATE_SLOTS = "newsloom.stateSlots"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What opening a file counts as, in bytes read, where each file is one page.
OPEN_COST, PAGE_OPEN_COST = "spark.sql.files.openCostInBytes", "262144"


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def rows_per_task(spark: SparkSession) -> int:
    """How many rows of one key a single task may take before the key is spread."""
    return int(spark.conf.get(ROWS_PER_TASK, "1000000"))


def key_folders(spark: SparkSession) -> int:
    """Into how many folders by a key's hash a deployment's tables are cut.

    Set it before the tables are created and leave it: rows are looked for where the same
    number has put them. A batch of n keys reads about n folders of each table.
    """
    return int(spark.conf.get(KEY_FOLDERS, "64"))


def state_slots(spark: SparkSession) -> int:
    """Into how many slots the live states of jobs are put by the hash of a job's id.

    Some hundred live jobs to a slot are well; far more make each batch store much that it did not
    change. Set it before a stream's first run and leave it.
    """
    return int(spark.conf.get(STATE_SLOTS, "16384"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsloom-"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, for tables that a run writes and reads."""
    return f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table next to the cluster's checkpoints and read that instead.

    Model answers and parsed pages go through here, so that a lost executor or a second
    use of the rows never repeats the work. As a table, later reads take only the columns
    they need and joins know its size.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``df`` materialised, and aggregates over its rows, taken while it is written."""
    seen, named = Observation(), [figure.alias(name) for name, figure in figures.items()]
    table = materialise(df.observe(seen, *named))
    # A plan that is found to be empty may lose what it was to observe.
    taken = seen.get
    return table, taken if figures.keys() <= taken.keys() else table.agg(*named).first().asDict()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    table, taken = observed(df, n=F.count(F.lit(1)))
    return table, taken["n"]


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Within, every query's shuffle files are deleted when it ends.

    For jobs that write their tables once and read those from then on. Otherwise the files stay
    until the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def for_small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` where a task reads some dozens or hundreds of files of
    a page each, not the few that Spark takes to fill it. Files read by streams follow the session
    they are read in, and a setting there would reach all other queries."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(OPEN_COST, PAGE_OPEN_COST)
    return own


def forget(spark: SparkSession) -> None:
    """Let the driver free what ended queries have left: plans, broadcast rows, task states.

    Jobs of hundreds of queries would else grow its heap to the limit before anything goes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
