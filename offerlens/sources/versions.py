"""Tables that change together: versions of a state, of which a commit rewrites only the buckets that it touches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_MANIFEST = "name string, bucket int, folder string, writer string, buckets int, version long"


class Conflict(Exception):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Layout:
    """A table of a state. Rows are in buckets by `key`, or in one bucket without; facts are only ever appended, one folder for each commit."""

    columns: str
    key: str | None = None
    facts: bool = False

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


class Versions:
    """Versions of the tables `layouts` below `root`, a folder that all executors share.

    A commit writes the buckets that changed to new folders and then a manifest: for each table and bucket the folder that holds its rows, and the folders of
    facts that it adds. Rows are dealt to files by bucket, large buckets to several. The manifest's folder gets its final name, version=N, by a rename that fails where that name exists, so of two writers of one version the
    second gets `Conflict` and what it wrote is never read. Files that a version names are never changed: readers of it, and retried tasks, see the same rows.
    """

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout], buckets: int = BUCKETS):
        self.spark, self.root, self.layouts = spark, root.rstrip("/"), layouts
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            self._publish([("", -1, "", "", buckets)], 0)
        self.buckets = self._manifest(0)[0]["buckets"]

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/commits")

    def _manifest(self, version: int) -> list:
        """A row for each bucket of each table, and for each fact table that the version added to."""
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/commits/version={version}").collect()

    def _publish(self, rows: list[tuple], version: int) -> None:
        jvm, pending = self.spark._jvm, f"{self.root}/pending/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, _MANIFEST.replace(", version long", "")).coalesce(1).write.parquet(pending)
        path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(pending).toUri(), self.spark._jsc.hadoopConfiguration())
        whole = files.makeQualified(path(f"{self.root}/commits"))
        files.mkdir(whole, jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(path(pending)), path(f"{whole}/version={version}"), none)
        except Exception as problem:
            if "FileAlreadyExists" in str(problem) or "not empty" in str(problem):
                raise Conflict(f"version {version} exists") from None
            raise

    def current(self) -> int:
        """The last version; 0 before the first commit."""
        return self._commits().agg(F.max("version")).first()[0]

    def bucket_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long") if isinstance(key, str) else key.cast("long")), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys in the one column of `keys`: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self.bucket_of(keys.columns[0])).distinct().collect())

    def read(self, name: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a version, by default the last; with `only`, its rows in these buckets, whose files alone are read."""
        layout, version = self.layouts[name], self.current() if version is None else version
        if layout.facts:
            added = self._commits().where((F.col("name") == name) & (F.col("version") <= version)).select("folder").distinct().collect()
            paths = [f"{self.root}/{r[0]}" for r in added]
        else:
            paths = [f"{self.root}/{r['folder']}/bucket={r['bucket']}" for r in self._manifest(version) if r["name"] == name and (only is None or layout.key is None or r["bucket"] in only)]
        return self.spark.read.schema(layout.schema).parquet(*paths) if paths else self.spark.createDataFrame([], layout.schema)

    def commit(self, base: int, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, only: list[int] | None = None) -> int:
        """Version `base` + 1: tables in `changed` have their rows of the buckets in `only` (by default all) replaced by the given ones, facts get those in `added`.

        Raises `Conflict` where that version exists, and ValueError for a row outside these buckets, which would hide another's.
        """
        writer = uuid.uuid4().hex
        old = self._manifest(base)
        rows = [(r["name"], r["bucket"], r["folder"], r["writer"], self.buckets) for r in old if r["name"] in self.layouts and not self.layouts[r["name"]].facts]
        for name, df in changed.items():
            layout, folder = self.layouts[name], f"{name}/{writer}"
            bucket = self.bucket_of(layout.key) if layout.key else F.lit(0)
            whole = df.select(*[F.col(f.name).cast(f.dataType) for f in layout.schema]).withColumn("bucket", bucket)
            whole.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            made = {r[0] for r in self.spark.read.schema(f"{layout.columns}, bucket int").parquet(f"{self.root}/{folder}").select("bucket").distinct().collect()}
            if only is not None and layout.key and made - set(only):
                raise ValueError(f"{name} has rows in buckets {sorted(made - set(only))} that were not read")
            replaced = (lambda b: True) if only is None or not layout.key else set(only).__contains__
            rows = [r for r in rows if r[0] != name or not replaced(r[1])] + [(name, b, folder, writer, self.buckets) for b in sorted(made)]
        for name, df in (added or {}).items():
            folder = f"{name}/{writer}"
            df.select(*[F.col(f.name).cast(f.dataType) for f in self.layouts[name].schema]).write.parquet(f"{self.root}/{folder}")
            rows.append((name, -1, folder, writer, self.buckets))
        self._publish(rows or [("", -1, "", writer, self.buckets)], base + 1)
        return base + 1

    def expire(self, keep: int) -> list[str]:
        """Delete folders of table rows that only versions before the last `keep` name, and return them. Facts stay, as do the manifests."""
        last = self.current()
        named = self._commits().where("bucket >= 0").groupBy("folder").agg(F.max("version").alias("last"))
        old = [r[0] for r in named.where(F.col("last") <= last - keep).collect()]
        for folder in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return old
