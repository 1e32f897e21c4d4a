"""Mixing sources to target weights by entropy balancing; only DataFrame functions.

Sources share a total of words by weight, up to a multiple of what they have.  Of all document rates that
give a source its words, those nearest to one copy each (in relative entropy, none above ``cap``) are
exponentially tilted by size: rate = min(cap, exp(lambda * size)).  One lambda a source solves the
convex dual, whose gradient is the words taken less the target and whose Hessian is diagonal, as a
document has one source.  So one pass over the data is a Newton step of all sources.

1. A cell is a source and a size; all its documents have one rate.  Texts are read once, and steps pass over cells.
2. Newton iterations: sums of gradient and slope by source, a step, and a bracket that halves where a step leaves it.
   Sums are of decimals, so they do not depend on the order of rows and reruns agree.
3. Rounding.  Rates summed over the cells of a source in order of size are rounded, and a cell takes the difference
   of the rounded sums as copies: what is lost in one cell is made good in the next.  What is left of a source's target
   then changes single copies, of the size that comes nearest, until none brings it nearer.
4. A cell's copies go to its documents evenly, one more to the first ones by a hash of their ids.

Running sums and numbers are carried over ranges (``ranges``), so a source or a size of a third of all rows spreads.

Defined cases: a null text has size 0 and nothing is taken of it; null sources are one source, after all others;
a source without words has the target 0; repeated rows are documents of their own; rows of a null id are told apart by
their place; very long texts are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import ranges

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; words of the mix by words there are; copies of a document at most.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Relative error of a source's words at which its rates stand; rounds until then at most; rounds of single copies.
TOLERANCE, ROUNDS, SINGLES = 1e-9, 80, 6
#: Rates are summed in millionths.
UNIT = 1_000_000
SOURCE = ["lost", "src"]


# ---------------------------------------------------------------- targets

def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int, scratch: Scratch) -> DataFrame:
    """lost, src, source_size, target: ``sources`` (lost, src, source_size and others) in order of code points, null last.

    The level at which sources stop grows as the excess is shared again; each round is one sum over the sources.
    """
    placed = ranges.numbered(sources, [F.col("lost"), F.col("src")], "place", scratch=scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = scratch.write(placed.withColumn("weight", weight), "weighed")
    words, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    most, whole = F.lit(float(cap)) * F.col("source_size"), share * words
    level, full = whole / weight if weight else 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        n, held, rest = weighed.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if n == full or not rest:
            break
        full, level = n, (whole - held) / rest
    return weighed.drop("place").withColumn("target", F.least(F.col("weight") * F.lit(level), most))


# ---------------------------------------------------------------- rates

def balanced(cells: DataFrame, sources: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """lost, src, lam, scale: the tilt of every source; a document's rate is ``rate(cap)`` of them and its size.

    cells: lost, src, size, n; sources: lost, src, source_size, target, scale, least (its smallest size above 0).
    """
    far = F.lit(math.log(cap)) * F.col("scale") / F.col("least")  # from here on every rate is the cap
    more = F.col("target") > F.col("source_size")
    state = sources.filter("source_size > 0").select(
        *SOURCE, "target", "scale", F.lit(0.0).alias("lam"),
        F.when(more, 0.0).otherwise(float("-inf")).alias("lo"), F.when(more, far).otherwise(0.0).alias("hi"), F.lit(False).alias("done"),
    )
    full = F.col("target") >= F.lit(float(cap)) * sources["source_size"] * (1 - 1e-12)
    state = state.join(sources.filter(full).select(*SOURCE, F.lit(True).alias("full")), SOURCE, "left")
    state = state.withColumn("lam", F.when(F.col("full"), F.col("hi")).otherwise(F.col("lam"))).withColumn("done", F.coalesce("full", F.lit(False))).drop("full")
    state = scratch.write(state, "tilt-0")
    for turn in range(1, ROUNDS + 1):
        going = state.filter(~F.col("done"))
        tilt = F.exp(F.col("lam") * F.col("size") / F.col("scale"))
        words = F.col("n") * F.col("size") * F.least(F.lit(float(cap)), tilt)
        slope = F.when(tilt < cap, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * tilt).otherwise(0.0)
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        sums = cells.join(going.select(*SOURCE, "lam", "scale"), SOURCE).groupBy(*SOURCE).agg(exact(words).alias("words"), exact(slope).alias("slope"))
        met = state.join(sums, SOURCE, "left")
        gap = F.col("words") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        half = F.when(F.col("lo") > float("-inf"), (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("hi") * 2 - 1)
        met = met.withColumn("lo", F.coalesce(lo, "lo")).withColumn("hi", F.coalesce(hi, "hi"))
        stands = F.coalesce(F.abs(gap) <= TOLERANCE * F.col("target"), F.lit(True))
        moved = F.when(stands, F.col("lam")).when(inside, step).otherwise(half)
        stuck = ~stands & (moved == F.col("lam"))
        out = met.select(*SOURCE, "target", "scale", moved.alias("lam"), "lo", "hi", (stands | stuck).alias("done"))
        state = scratch.write(out, f"tilt-{turn}")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select(*SOURCE, "lam", "scale")


def rate(cap: int):
    """The rate of a document of ``size`` words; a source without words has none."""
    return F.coalesce(F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))), F.lit(0.0))


# ---------------------------------------------------------------- copies

def rounded(cells: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """The cells (lost, src, size, n, rate, target and others) with their copies."""
    units = F.round(F.col("n") * F.col("rate") * UNIT).cast("long")
    summed = ranges.running_sum(cells.withColumn("units", units), [F.col("size")], "units", "upto", SOURCE, scratch)
    copies = F.expr(f"(upto + {UNIT // 2}) div {UNIT} - (upto - units + {UNIT // 2}) div {UNIT}")
    cells = scratch.write(summed.withColumn("copies", F.greatest(F.lit(0), F.least(copies, F.col("n") * cap))).drop("units", "upto"), "copies-0")
    for turn in range(1, SINGLES + 1):
        # what a source lacks, and the size of which one copy more (or less) comes nearest to it
        rest = cells.groupBy(*SOURCE).agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
        near = F.abs(F.abs("rest") - F.col("size"))
        free = F.when(F.col("rest") > 0, F.col("copies") < F.col("n") * cap).otherwise(F.col("copies") > 0)
        some = cells.join(rest, SOURCE).filter(free & (F.col("size") > 0) & (near < F.abs("rest")))
        chosen = some.groupBy(*SOURCE).agg(F.min_by("size", F.struct(near, "size")).alias("chosen"), F.first("rest").alias("rest"))
        chosen = scratch.write(chosen, f"single-{turn}")
        if chosen.isEmpty():
            break
        one = F.when(F.col("size") == F.col("chosen"), F.signum("rest").cast("long")).otherwise(F.lit(0))
        changed = cells.join(chosen, SOURCE, "left").withColumn("copies", F.col("copies") + F.coalesce(one, F.lit(0))).drop("chosen", "rest")
        cells = scratch.write(changed, f"copies-{turn}")
    return cells


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """id_col, size, source_size, target, taken, source, rate and copies of every row."""
    run = scratch or Scratch(docs.sparkSession, "mix")
    text, source = docs[text_col].cast("string"), docs[source_col].cast("string")
    rows = run.write(
        docs.select(
            docs[id_col].alias("id"), source.isNull().alias("lost"), F.coalesce(source, F.lit("")).alias("src"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(docs[id_col]).alias("told"),
        ),
        "rows",
    )
    cells = run.write(rows.groupBy(*SOURCE, "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    wide = F.col("size").cast("decimal(20,0)")
    sums = cells.groupBy(*SOURCE).agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), (F.sum(wide * F.col("size") * F.col("n")).cast("double")).alias("squares"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    scale = F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size"))  # so that lambda is near 1, whatever the sizes
    sources = run.write(targets(sums.withColumn("scale", scale).drop("squares"), weights, share, cap, run), "sources")
    tilt = run.write(balanced(cells, sources, cap, run), "tilt")
    rated = cells.join(sources.select(*SOURCE, "source_size", "target"), SOURCE).join(tilt, SOURCE, "left")
    rated = run.write(rated.withColumn("rate", F.when(F.col("size") > 0, rate(cap)).otherwise(0.0)).drop("lam", "scale"), "rated")
    copied = rounded(rated, cap, run)
    placed = ranges.numbered(rows, [F.col("told"), F.col("id")], "place", [*SOURCE, "size"], run)
    held = placed.join(copied.hint("merge"), [*SOURCE, "size"], "left")  # cells grow with the corpus: never broadcast
    copies = F.expr("copies div n + if(place < copies % n, 1, 0)")
    out = held.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        F.when(~F.col("lost"), F.col("src")).alias("source"), "rate", copies.cast("int").alias("copies"),
    )
    return out if scratch else run.settled(out)[0]


def op12_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
