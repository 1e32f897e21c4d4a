"""Exact percentiles by group, by rounds of histograms that narrow the range; nothing is sorted.

Not in the prototype; an extension of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.scratch import Given, Scratch

#: Bins of one round; groups and shares whose ranges are broadcast, beyond which they are joined in a shuffle.
BINS, BROADCAST_RANGES = 1024, 100_000


def percentiles(rows: DataFrame, group: list[str], value: str, shares: list[float], scratch: Scratch | None = None) -> DataFrame:
    """group, share, value: the smallest value that at least that share of the group's values do not exceed.

    A range (low, high) for each group and share holds the value looked for.  A round counts the values
    of the range in BINS bins, with each bin's least and greatest value, and keeps the bin that the rank falls into.
    It ends when all ranges are one value.  Counts meet, never rows: at most BINS a range from a task.
    Rows outside all ranges are left behind each round.

    Defined cases: null and NaN values are not counted; a group without values has a null for each share; a null
    group is a group; ties need no order; an empty table gives no rows.
    """
    keys = [f"g{i}" for i in range(len(group))]
    kind = rows.schema[value].dataType.simpleString()
    plain = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(value).alias("v"))
    if kind in ("double", "float"):
        plain = plain.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    with Given(scratch, rows.sparkSession, "percentiles") as run:
        wanted = F.explode(F.array(*map(F.lit, shares))).alias("share")
        whole = plain.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        # the rank from 1; n - floor(n - n * share) rounds up as binary floating point has it
        rank = F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - F.col("n") * F.col("share"))).cast("long")
        ranges = run.write(whole.select(*keys, "n", "low", "high", wanted).select(*keys, "share", rank.alias("rank"), "low", "high"), "ranges-0")
        left, turn = plain, 0
        while (open_ranges := ranges.filter("low < high").count()) > 0:
            turn += 1
            some = ranges.filter("low < high").select(*[F.col(k).alias(f"r{k}") for k in keys], "share", "rank", "low", "high")
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"r{k}"))
            some = F.broadcast(some) if open_ranges <= BROADCAST_RANGES else some
            inside = left.join(some, same & F.col("v").between(F.col("low"), F.col("high")))
            low, high = F.col("low").cast("double"), F.col("high").cast("double")
            # both ends have bins of their own, so each round narrows the range whatever doubles tell apart; halves do not overflow
            width = high / 2 - low / 2
            place = F.least(F.lit(BINS - 3), F.floor((F.col("v").cast("double") / 2 - low / 2) / width * (BINS - 2))) + 1
            place = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), BINS - 1).when((width > 0) & (width < float("inf")), place).otherwise(1)
            bins = inside.groupBy(*keys, "share", "rank", place.cast("int").alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            line = Window.partitionBy(*keys, "share").orderBy("bin")  # at most BINS rows
            to = bins.withColumn("to", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
            chosen = to.filter((F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("n")))
            chosen = chosen.select(*keys, "share", (F.col("rank") - F.col("to") + F.col("n")).alias("rank"), "low", "high")
            done = ranges.filter("low is null or low >= high")
            ranges = run.write(done.unionByName(chosen), f"ranges-{turn}")
            # what no range holds any more is not read again; a row is kept once for all shares
            if turn == 1:
                spans = ranges.filter("low < high").groupBy(*[F.col(k).alias(f"r{k}") for k in keys]).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
                spans = F.broadcast(spans) if open_ranges <= BROADCAST_RANGES else spans
                within = F.exists("spans", lambda s: F.col("v").between(s["low"], s["high"]))
                left = run.write(left.join(spans, same).filter(within).select(*keys, "v"), "left")
        out = ranges.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], "share", F.col("low").alias(value))
        return out if scratch else run.settled(out)[0]
