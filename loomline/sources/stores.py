"""Sources and sinks: tables, typed collections, attached files, small state tables, CSV export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File extensions that can be attached.
ATTACHABLE = (".pdf", ".doc", ".docx", ".csv")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collection(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small ordered collection: the schema is explicit and the stored order is the column ``ord``."""
    fields = T.StructType.fromDDL(schema).fields
    kind = T.StructType([T.StructField("ord", T.IntegerType(), False), *fields])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kind)


def attached(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ATTACHABLE) -> DataFrame:
    """Names of the files that can be attached; contents are never read."""
    pattern = "*{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path")


def setting(state: DataFrame, key: str, default: str) -> DataFrame:
    """One row: the stored value of a key, or the default."""
    return state.filter(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def with_setting(state: DataFrame, key: str, value: str) -> DataFrame:
    """The state with one key set."""
    new = state.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return state.filter(~F.col("key").eqNullSafe(key)).unionByName(new)


def write_state(state: DataFrame, folder: str) -> None:
    """Replace a small state table, as one file; ``state`` may be read from the very folder.

    The new table is written beside the old one first, which goes only when that is whole.  Where a
    crash comes between, ``read_state`` finds the old one beside the folder.
    """
    spark = state.sparkSession
    beside = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    state.coalesce(1).write.parquet(f"{beside}.new")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path(folder)):
        files.rename(path(folder), path(f"{beside}.old"))
    if not files.rename(path(f"{beside}.new"), path(folder)):
        raise OSError(f"{beside}.new could not be moved to {folder}")
    files.delete(path(f"{beside}.old"), True)


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """A state table that ``write_state`` wrote; after a crash in the middle of it, the one before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path(folder)):
        return spark.read.parquet(folder)
    left = sorted((s.getModificationTime(), s.getPath().toString()) for s in files.globStatus(path(f"{folder.rstrip('/')}.*.old")) or [])
    if not left:
        raise FileNotFoundError(folder)
    return spark.read.parquet(left[-1][1])


def export_csv(rows: DataFrame, folder: str, columns: dict[str, Column | str]) -> None:
    """Columns under their headings, as CSV."""
    named = [(F.col(c) if isinstance(c, str) else c).alias(title) for title, c in columns.items()]
    rows.select(*named).write.mode("overwrite").option("header", True).csv(folder)
