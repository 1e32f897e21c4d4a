"""Sharding by Karmarkar-Karp differencing (law ``bytes``; groups of equal texts stay together).

Largest differencing method for k shards: every group begins as a partial partition
(its size and k-1 zeros); the two partial partitions of largest spread are combined,
oppositely ordered, until one is left.

One task differences at most BLOCK_GROUPS of them (or three times what a block becomes, for very many shards).  More are first made fewer, in rounds: they are
dealt by hash to blocks, and a task differences its block into bins of near equal size, which are the
next round's groups: its larger groups into BINS large ones for each shard, others into as many an
eighth of their size and as many an eighth of that.  So the next round has sizes to even out with, as
it has in the groups that stay as they are: those that are large against a shard (of which there are
few) and the DUST smallest of each block.  The last round is one differencing into the shards.

Defined cases: a null text counts as empty (size 1) and is in the group of empty texts; a very long
text is a group like others, which may be larger than a shard's share;
repeated rows each get a slot of their own; an empty table gives no rows; other columns of the
input are ignored; a null id is kept as a row.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import ranges

from .common import Given, Scratch, join_with_hot, table

#: Groups differenced in one task; for each shard, bins of one size that a block becomes, and its smallest groups that stay.
BLOCK_GROUPS, BINS, DUST = 50_000, 8, 32
#: Shares of a block's bytes in bins of each size.
SHARES = (64, 8, 1)


def difference(sizes: list[int], k: int) -> list[int]:
    """Karmarkar-Karp: the part, of k, of every size.  Ties: the earlier partition first."""
    if not sizes:
        return []
    # a partial partition: its k sums in rising order, and a bag for each: None, a place in ``sizes``, or a pair of bags
    heap = [(-s, i, [0] * (k - 1) + [s], [None] * (k - 1) + [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, bags_a = heapq.heappop(heap)
        _, _, b, bags_b = heapq.heappop(heap)
        joined = sorted(((x + y, j) for j, (x, y) in enumerate(zip(a, reversed(b)))), key=lambda x: x[0])
        sums, bags = [s for s, _ in joined], []
        for _, j in joined:
            x, y = bags_a[j], bags_b[k - 1 - j]
            bags.append(y if x is None else x if y is None else (x, y))
        heapq.heappush(heap, (sums[0] - sums[-1], serial, sums, bags))
        serial += 1
    out = [0] * len(sizes)
    for part, bag in enumerate(heap[0][3]):
        todo = [] if bag is None else [bag]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                out[x] = part
    return out


def _differenced(k: int, dust: int, shares: tuple[int, ...]):
    """Groups of a block (item, bytes) to bins, k for each of the shares; the ``dust`` smallest stay (part null)."""

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "item"], ascending=[False, True])
        sizes = groups["bytes"].to_numpy()[: max(0, len(groups) - dust)]
        ends = np.searchsorted(np.cumsum(sizes), np.cumsum(shares) / sum(shares) * sizes.sum()) if len(sizes) else [0]
        parts, at = [], 0
        for i, end in enumerate([*ends[:-1], len(sizes)]):
            parts += [i * k + p for p in difference(sizes[at:end].tolist(), k)]
            at = max(at, end)
        part = pd.array(parts + [None] * (len(groups) - len(parts)), dtype="Int32")
        return pd.DataFrame({"block": groups["block"], "item": groups["item"], "bytes": groups["bytes"], "part": part})

    return run


_PLACED = "block int, item string, bytes long, part int"


def place(items: DataFrame, n_shards: int, scratch: Scratch) -> DataFrame:
    """item, shard of groups (item, bytes)."""
    steps: list[DataFrame] = []
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # of a block at most a third stays as bins and dust, and under a seventh as large groups: every round leaves under half
    most = max(BLOCK_GROUPS, 3 * (BINS * len(SHARES) + DUST) * n_shards)
    while n > most:
        blocks = math.ceil(n / most)
        large = F.col("bytes") * (8 * n_shards * blocks) > total  # fewer than 8 * n_shards * blocks of them
        block = F.pmod(F.xxhash64("item", F.lit(len(steps))), F.lit(blocks)).cast("int")
        binned = _differenced(BINS * n_shards, DUST * n_shards, SHARES)
        placed = items.filter(~large).withColumn("block", block).groupBy("block").applyInPandas(binned, _PLACED)
        placed = scratch.write(placed, f"placed{len(steps)}")
        into = F.concat_ws("/", F.lit(len(steps)), "block", "part")
        steps.append(placed.filter("part is not null").select("item", into.alias("bin")))
        bins = placed.filter("part is not null").groupBy(into.alias("item")).agg(F.sum("bytes").alias("bytes"))
        items = items.filter(large).unionByName(placed.filter("part is null").select("item", "bytes")).unionByName(bins)
        items = scratch.write(items.select("item", "bytes"), f"items{len(steps)}")
        n = items.count()
    last = items.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_differenced(n_shards, 0, (1,)), _PLACED)
    shards = scratch.write(last.select("item", F.col("part").alias("shard")), "last")
    for placed in reversed(steps):
        inside = placed.join(shards.withColumnRenamed("item", "bin"), "bin").select("item", "shard")
        shards = shards.unionByName(inside)
    return shards


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, size, text_crc32, digest, shard and slot (gapless from 0 in each shard) of every row."""
    with Given(scratch, docs.sparkSession, "shards") as run:
        out = _sharded(docs, n_shards, id_col, text_col, run)
        return out if scratch else run.settled(out)[0]


def _sharded(docs: DataFrame, n_shards: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = scratch.write(
        docs.select(
            F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
        ),
        "sized",
    )
    groups = scratch.write(sized.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")), "groups")
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    placed = place(groups.select(F.col("digest").alias("item"), "bytes"), n_shards, scratch)
    shards = groups.select("digest", "copies").join(placed.withColumnRenamed("item", "digest"), "digest")
    with_shard = join_with_hot(sized, shards, "digest", F.col("copies"), total)
    # a shard's rows are numbered over ranges of ids, so a null id, or one that repeats, spreads as others do
    return ranges.numbered(with_shard.select(id_col, "size", "text_crc32", "digest", "shard"), [F.col(id_col)], "slot", ["shard"], scratch)


def op2_kk_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
