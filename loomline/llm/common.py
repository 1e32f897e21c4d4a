"""Helpers that the corpus operators share: tables, scratch tables, hot-key joins, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.ranges import fresh
from loomline.sources.scratch import Given, Scratch, shared_dir

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "Given", "HOT_SHARE", "MASK64", "Scratch", "WordHashes", "fresh", "in_slices", "join_with_hot", "mix", "shared_dir", "table"]

MASK64 = (1 << 64) - 1


#: Rows and bytes of an Arrow batch on its way to Python, where the session names none.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder.

    Texts are long, so Arrow batches are made smaller than Spark's default; this setting of the session
    stays, as frames run later than they are made.  A session that names its own keeps it.
    """
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ARROW_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "268435456", ARROW_BYTES),
    ):
        if spark.conf.get(key, default) in (default, f"{default}b", "256m", "256MB"):
            spark.conf.set(key, str(value))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- joins

#: A key is hot with more than this share of the rows, so there are at most 1/share hot keys.
HOT_SHARE = 0.001


def join_with_hot(left: DataFrame, right: DataFrame, key: str, copies: Column, total: int) -> DataFrame:
    """Left join on ``key``, ``right`` having one row a key and knowing its ``copies`` in ``left``.

    Keys with over HOT_SHARE of the ``total`` left rows (so under 1000 rows of ``right``, however
    large the input) are broadcast; the others meet in a shuffled join.  Rows with a null key match
    nothing and are not shuffled.
    """
    hot = right.filter(copies > F.lit(HOT_SHARE) * total)
    cold = right.filter(~(copies > F.lit(HOT_SHARE) * total))
    keys = F.broadcast(hot.select(key))
    return (
        left.join(F.broadcast(hot), key)
        .unionByName(left.filter(F.col(key).isNotNull()).join(keys, key, "left_anti").join(cold, key, "left"))
        .unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
    )


# ---------------------------------------------------------------- in tasks

def in_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes of text each, and their texts as bytes (null: empty)."""
    texts = pc.fill_null(pc.cast(batch.column(column), pa.binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at), texts.slice(at, end - at).to_pylist()
        at = end



class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``most`` words and then begun anew."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
