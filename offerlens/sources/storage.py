"""Tables in folders that all executors share, versions of snapshots, and appended facts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_CLEAN, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Most rows that Spark hands to Python at a time while a table is written: whole texts, held by the JVM and by Python, for each task.
BATCH_ROWS = 1_000
_lock, _writers = threading.Lock(), {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one beside the warehouse, which must not be a local one, or of our own on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.startswith("local"):
            named = _own_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="offerlens-"))
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.offerlens"
            if named.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine, which executors elsewhere do not share")
    return named.rstrip("/")


@contextmanager
def _writing(spark: SparkSession):
    """Shuffle files of queries that start meanwhile go when their query ends, and Python gets rows in small batches; the settings are put back when the last writer is done."""
    with _lock:
        n, before = _writers.get(id(spark), (0, None))
        if not n:
            before = {key: spark.conf.get(key, None) for key in (_CLEAN, _BATCH)}
            spark.conf.set(_CLEAN, "true")
            rows = int(before[_BATCH] or 0)
            spark.conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        _writers[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(id(spark))
            if n > 1:
                _writers[id(spark)] = n - 1, before
            else:
                for key, value in before.items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/offerlens-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with_state(df: DataFrame, *columns: str) -> tuple[DataFrame, tuple]:
    """`written`, and the number of rows and a sum of hashes over `columns`, taken while writing."""
    seen = Observation()
    hashed = F.xxhash64(*columns).cast("decimal(20,0)")
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folders = {x.rsplit("/", 1)[0] for x in table.inputFiles()}
        for folder in folders:
            if folder.rsplit("/", 1)[-1].startswith("offerlens-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new version of a current-state table, in a folder of its own; the version being read is never overwritten."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")


def publish(spark: SparkSession, root: str, version: int) -> None:
    """Make a version the current one: the pointer table gets a row, whose greatest version counts; a version without a row is never read."""
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/pointer")


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version last published, None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("version long").parquet(path.toString()).agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return None if version is None else read_snapshot(spark, root, version)


def append_facts(df: DataFrame, path: str, run_col: str = "run_id") -> None:
    """History, results and run headers: appended, one folder for each run."""
    df.write.mode("append").partitionBy(run_col).parquet(path)
