"""Scratch tables of one run under the folder that driver and executors share.

They cut the lineage, outlive lost executors, and hold still what a range partitioning has sampled.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which the files of a query's shuffles go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where the setting is absent, a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    kept = getattr(spark.sparkContext, "_loomline_shared", None)
    if kept is None:
        kept = spark.sparkContext._loomline_shared = tempfile.mkdtemp(prefix="spark-")
    return f"file://{kept}"


class Scratch:
    """Written tables of one run; as a context manager they go at its end, however it ends.

    ``settled`` writes what a run is for to a folder of its own.  Folders that are left, results
    among them, go with the session: frames that read them do not live longer.  A ``tidy`` one has
    what a write has shuffled deleted once it is written; else it stays until the driver happens to
    collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/loomline-{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        self.begun = False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def path(self, name: str) -> str:
        if not self.begun:  # from now on the folder goes with the session at the latest
            where, files = self._files(self.root)
            files.mkdirs(where)
            files.deleteOnExit(where)
            self.begun = True
        return f"{self.root}/{name}"

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        kept = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            if self.tidy:
                self.spark.conf.unset(TIDY) if kept is None else self.spark.conf.set(TIDY, kept)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table that joins on ``key`` read without a shuffle; it needs the right to make tables in the current catalogue."""
        held = f"loomline_{uuid.uuid4().hex}"
        self.tables.append(held)
        df.write.format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, key).saveAsTable(held)
        return self.spark.table(held)

    def remove(self, name: str = "") -> None:
        where, files = self._files(f"{self.root}/{name}" if name else self.root)
        files.delete(where, True)

    def settled(self, *results: DataFrame) -> list[DataFrame]:
        """The results as tables of their own, all other tables of this run deleted."""
        own = Scratch(self.spark, "result", self.tidy)
        try:
            return [own.write(df, str(i)) for i, df in enumerate(results)]
        except BaseException:
            own.drop()
            raise
        finally:
            self.drop()

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []
        self.remove()


class Given:
    """A scratch of the caller's as a context manager that leaves it to the caller, or one of our own that goes."""

    def __init__(self, scratch: Scratch | None, spark: SparkSession, name: str, tidy: bool = False):
        self.given, self.own = scratch, scratch or Scratch(spark, name, tidy)

    def __enter__(self) -> Scratch:
        return self.own

    def __exit__(self, *_) -> None:
        if self.given is None:
            self.own.drop()
