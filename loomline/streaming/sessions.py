"""Sessions of events, in batch and over a stream whose late rows are told apart.

Not in the prototype; an extension of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.ranges import Ranges, last_known, previous
from loomline.sources.scratch import Given, Scratch


def in_sessions(events: DataFrame, key: str, at: str, gap: int, name: str = "session_start", scratch: Scratch | None = None) -> DataFrame:
    """Events (``at`` in whole microseconds) with the time at which their session began: one ends where more than ``gap`` passes without an event.

    The event before, and then the session's beginning, are carried over ranges of (key, at), so a key of half the rows, or
    a session without an end, spreads.  A null key is a key; rows of a null time have no session.
    """
    with Given(scratch, events.sparkSession, "sessions") as run:
        r = Ranges(events.dropna(subset=[at]), [key], [F.col(at)], run)
        own, step = previous(r, F.col(at))
        known = r.carried(__before=step).withColumn("__before", F.coalesce(own, "__before"))
        begins = F.when(F.col("__before").isNull() | (F.col(at) - F.col("__before") > gap), F.col(at))
        again = r.again(known.withColumn("__begins", begins).drop("__before"), run)
        own, step = last_known(again, F.col("__begins"))
        started = again.carried(__start=step).withColumn(name, F.coalesce(own, "__start"))
        lost = events.filter(F.col(at).isNull()).withColumn(name, F.lit(None).cast("long"))
        out = r.plain(started, name).unionByName(lost)
        return out if scratch else run.settled(out)[0]


def sessions(events: DataFrame, key: str, at: str, gap: int, more: dict[str, Column] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """key, session_start, session_end, n and further aggregates of every session."""
    kept = in_sessions(events, key, at, gap, scratch=scratch).filter("session_start is not null")
    measures = [c.alias(n) for n, c in (more or {}).items()]
    return kept.groupBy(key, "session_start").agg(F.max(at).alias("session_end"), F.count(F.lit(1)).alias("n"), *measures)


class SessionStream:
    """Sessions over a stream, for ``foreachBatch``; everything it keeps is in ``folder``, by the number of the micro-batch.

    The watermark of a batch is the latest time of the batches before it less ``lateness``.  Rows below it are late: they are kept
    apart and change no session.  Sessions that ended more than ``gap`` before the watermark are closed, as no row can change them any more.
    A batch that is made again, after a crash or a restart from a checkpoint, replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, at: str, gap: int, lateness: int):
        self.spark, self.folder, self.key, self.at, self.gap, self.lateness = spark, folder.rstrip("/"), key, at, gap, lateness

    def _read(self, name: str, schema) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def watermark(self, batch: int | None = None) -> int | None:
        """That of a batch (default: of the next one)."""
        seen = self._read("seen", "latest long, batch long")
        latest = seen.filter(F.col("batch") < batch if batch is not None else F.lit(True)).agg(F.max("latest")).first()[0]
        return None if latest is None else latest - self.lateness

    def take(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch."""
        mark = self.watermark(batch)
        late = F.lit(False) if mark is None else F.coalesce(F.col(self.at) < mark, F.lit(False))
        told = rows.withColumn("late", late)
        told.write.mode("overwrite").partitionBy("late").parquet(f"{self.folder}/rows/batch={batch}")
        rows.agg(F.max(self.at).alias("latest")).write.mode("overwrite").parquet(f"{self.folder}/seen/batch={batch}")

    def _rows(self, late: bool) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows").filter(F.col("late") == late).drop("late", "batch")

    def late(self) -> DataFrame:
        return self._rows(True)

    def sessions(self, closed: bool = True) -> DataFrame:
        """The sessions of the rows that were not late: those that are closed, or all."""
        found = sessions(self._rows(False), self.key, self.at, self.gap)
        mark = self.watermark()
        return found.filter(F.col("session_end") + self.gap < F.lit(mark)) if closed else found
