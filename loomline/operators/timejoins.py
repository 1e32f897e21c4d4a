"""Joins in time: the latest earlier row of a key, and intervals that overlap.

Neither is in the prototype; both are extensions of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.ranges import Ranges, last_known
from loomline.sources.scratch import Given, Scratch


def asof(
    left: DataFrame, right: DataFrame, by: list[tuple[str, str]], at: tuple[str, str], values: dict[str, str], ties: list[str] = (),
    strict: bool = False, scratch: Scratch | None = None,
) -> DataFrame:
    """Each left row with ``values`` (right column: new name) of the right row of its key that is latest at or (strict) before it.

    Both sides are dealt by ranges of (key, time) once; within a range the latest right row is a window's
    last value, and a range hands the last one of the key that goes on to those after it.  So a key of half the rows
    spreads over half the ranges.  Right rows of one time are taken by the largest ``ties``.

    Defined cases: a left row without an earlier right row, or of a null key or time, has nulls; right
    rows of a null key or time are not met; repeated left rows stay as often as they are; columns of any name stay.
    """
    keys, tied = [f"k{i}" for i in range(len(by))], [f"t{i}" for i in range(len(ties))]
    row = F.struct(*[left[c].alias(f"c{i}") for i, c in enumerate(left.columns)])
    found = F.struct(*[right[c].alias(f"v{i}") for i, c in enumerate(values)])
    a = left.select(row.alias("row"), *[left[c].alias(k) for (c, _), k in zip(by, keys)], left[at[0]].alias("at"), F.lit(0 if strict else 1).alias("side"))
    b = right.select(
        found.alias("found"), *[right[c].alias(k) for (_, c), k in zip(by, keys)], right[at[1]].alias("at"), F.lit(1 if strict else 0).alias("side"),
        *[right[c].alias(t) for c, t in zip(ties, tied)],
    )
    placed = [*keys, "at"]
    met = a.dropna(subset=placed).unionByName(b.dropna(subset=placed), allowMissingColumns=True)
    with Given(scratch, left.sparkSession, "asof") as run:
        r = Ranges(met, keys, [F.col(c) for c in ("at", "side", *tied)], run, "asof")
        own, step = last_known(r, F.col("found"))
        both = r.carried(before=step).withColumn("found", F.coalesce(own, "before")).filter("row is not null").select("row", "found")
        alone = a.filter(" or ".join(f"{c} is null" for c in placed)).select("row")
        whole = both.unionByName(alone, allowMissingColumns=True)
        out = whole.select("row.*", "found.*").toDF(*left.columns, *values.values())
        return out if scratch else run.settled(out)[0]


#: Widths of bins are powers of 2^WIDTH_BITS.
WIDTH_BITS = 2


def overlaps(
    left: DataFrame, right: DataFrame, by: list[tuple[str, str]], left_span: tuple[Column, Column], right_span: tuple[Column, Column],
    scratch: Scratch | None = None,
) -> DataFrame:
    """Pairs (left, right: structs of their columns) of one key whose spans [start, end], in whole numbers, share a point.

    A span's own level is the least whose bins are at least as wide as it is long, so it touches two bins there
    at most, however long; the levels that occur are read from the data.  A span also shows itself in the bins
    of all wider levels, and two spans meet at the wider of their own levels.  The pair belongs to the
    bin of the later start, so none is found twice.  It is an equi-join, whose hot keys Spark can split.

    Defined cases: a null key, start or end, or an end before the start, overlaps nothing; a span of one point
    is one; repeated rows pair as often as they are there; spans that only touch overlap.
    """
    keys = [f"k{i}" for i in range(len(by))]
    widths = F.array(*[F.lit(1 << WIDTH_BITS * i).cast("long") for i in range(62 // WIDTH_BITS + 1)])

    def spans(side: DataFrame, names: list[str], span: tuple[Column, Column]) -> DataFrame:
        row = F.struct(*[side[c] for c in side.columns])
        out = side.select(row.alias("row"), *[side[c].alias(k) for c, k in zip(names, keys)], span[0].cast("long").alias("s"), span[1].cast("long").alias("e"))
        own = F.size(F.filter(widths, lambda w: w < F.col("e") - F.col("s")))
        return out.dropna(subset=[*keys, "s", "e"]).filter("s <= e").withColumn("own", own)

    with Given(scratch, left.sparkSession, "overlaps") as run:
        a = run.write(spans(left, [c for c, _ in by], left_span), "spans-left")
        b = run.write(spans(right, [c for _, c in by], right_span), "spans-right")
        # at most as many as there are widths
        levels = sorted(r[0] for r in a.select("own").union(b.select("own")).distinct().collect())

        def binned(side: DataFrame, name: str) -> DataFrame:
            level = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("own"))) if levels else F.lit(0)
            shown = side.withColumn("level", level)
            bins = F.explode(F.sequence(F.expr(f"shiftright(s, level * {WIDTH_BITS})"), F.expr(f"shiftright(e, level * {WIDTH_BITS})")))
            names = {"row": name, "s": f"{name}_s", "e": f"{name}_e", "own": f"{name}_own"}
            return shown.withColumn("bin", bins).withColumnsRenamed(names)

        pairs = binned(a, "left").join(binned(b, "right"), [*keys, "level", "bin"]).filter(
            (F.greatest("left_own", "right_own") == F.col("level")) & (F.col("left_s") <= F.col("right_e")) & (F.col("right_s") <= F.col("left_e"))
            & (F.expr(f"shiftright(greatest(left_s, right_s), level * {WIDTH_BITS})") == F.col("bin"))
        )
        out = pairs.select("left", "right")
        return out if scratch else run.settled(out)[0]
