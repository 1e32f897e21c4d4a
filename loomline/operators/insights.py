"""Operators that the prototype only names in its texts.  The rules are proposals of this library;
they live in ``RULES`` or in parameters, never in a query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import ranges
from loomline.sources.scratch import Given, Scratch


@dataclass(frozen=True)
class Rules:
    """band_floors: for each source, the least score of Medium and of High."""

    # The floors of each source.
    band_floors: tuple[tuple[str, int, int], ...] = (("tender", 68, 79), ("planning", 55, 82))
    criterion: int = 45
    closing_days: int = 30
    high_value_eur: int = 5_000_000


RULES = Rules()


def closing_within(rows: DataFrame, deadline: Column, as_of: Column, days: int = RULES.closing_days) -> DataFrame:
    """Rows whose deadline lies from ``as_of`` to ``days`` later; no clock is read."""
    left = F.datediff(deadline, as_of)
    return rows.filter((left >= 0) & (left <= days))


#: The suggestions of the scans as predicates over opportunities with columns ``deadline``, ``band``, ``buyer``, ``architect``, ``status``,
#: ``value_eur`` and ``text``; each takes the day as of which it is asked.  Their rules are proposals, as are those of ``Rules``.
SUGGESTIONS = {
    "closing in the next 30 days": lambda as_of: F.datediff("deadline", as_of).between(0, RULES.closing_days),
    "strong fit": lambda as_of: F.col("band") == "High",
    "public sector": lambda as_of: F.lower("buyer").rlike(r"(^|\W)(council|authority|department|university|hospital|public)(\W|$)"),
    "planning, environmental noise or building acoustics": lambda as_of: mentions(F.col("text"), ["planning", "environmental noise", "building acoustics"]),
    "architect has been identified": lambda as_of: F.coalesce(F.trim("architect"), F.lit("")) != "",
    "granted with noise-related conditions": lambda as_of: (F.lower("status") == "granted") & mentions(F.col("text"), ["noise", "acoustic", "sound"]),
    "high value": lambda as_of: F.col("value_eur") >= RULES.high_value_eur,
}


def suggested(rows: DataFrame, suggestion: str, as_of: Column) -> DataFrame:
    """The rows that a suggestion asks for; a row without what it looks at is not among them; an unknown suggestion is an error."""
    return rows.filter(F.coalesce(SUGGESTIONS[suggestion](as_of), F.lit(False)))


def covering(rows: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """Relational division: the keys that have every item of ``wanted`` (one column), each once.

    Pairs are made distinct where they are before they are shuffled, and only those of wanted items are counted, so a
    key of many rows is a few counts.  Nothing wanted: every key.  Null keys and items are left out on both sides.
    """
    items = wanted.select(F.col(wanted.columns[0]).alias("item")).dropna().distinct()
    pairs = rows.select(F.col(key).alias("key"), F.col(item).alias("item")).dropna(subset=["key"])
    n = items.agg(F.count(F.lit(1)).alias("n"))  # one row
    held = pairs.dropna().distinct().join(items, "item").groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    none = pairs.select("key").distinct().select("key", F.lit(0).cast("long").alias("held"))
    most = held.unionByName(none).groupBy("key").agg(F.max("held").alias("held"))
    return most.join(F.broadcast(n), F.col("held") == F.col("n")).select(F.col("key").alias(key))


def ranked(rows: DataFrame, score: str, key: str, within: list[str], name: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """Rank by falling score within a group (null scores last), ties by key; a large group spreads over ranges."""
    out = ranges.numbered(rows, [F.desc(score), F.col(key)], name, within, scratch)
    return out.withColumn(name, (F.col(name) + 1).cast("int"))


def fit_band(source: Column, score: Column, rules: Rules = RULES) -> Column:
    """Low, Medium or High by the floors of the row's source; null for another source."""
    out = F.lit(None).cast("string")
    for name, medium, high in rules.band_floors:
        out = F.when(source == name, F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")).otherwise(out)
    return out


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Stages nest: each counts the rows that meet it and all stages before; rate: share of the stage before.

    One pass over the rows, then as many rows as stages.
    """
    met, counts = F.lit(True), []
    for _, condition in stages:
        met = met & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(met))
    one = rows.agg(F.array(*counts).alias("c"))
    labels = F.array(*[F.lit(label) for label, _ in stages])
    long = one.select(F.posexplode(F.arrays_zip(labels.alias("label"), F.col("c"))).alias("ord", "x"), "c").select(
        "ord", F.col("x.label").alias("label"), F.col("x.c").alias("value"), F.get("c", F.col("ord") - 1).alias("before")
    )
    return long.select("ord", "label", "value", F.when(F.col("before") > 0, F.col("value") / F.col("before")).alias("rate"))


def mentions(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs as a whole word, in either case."""
    return F.coalesce(F.lower(text).rlike(r"(^|\W)(" + "|".join(terms) + r")(\W|$)"), F.lit(False))


def verdict(method: Column, value: Column, rules: Rules = RULES) -> Column:
    """Pass only when measured and at the criterion; everything else is for review."""
    return F.when((method == "Measured") & (value >= rules.criterion), "Pass").otherwise("Review")


def fill_gaps(rows: DataFrame, value: str, group: list[str], order: str, name: str = "filled", scratch: Scratch | None = None) -> DataFrame:
    """A missing value is the mean of its nearest neighbours in order, or the one there is; a large group spreads over ranges."""
    with Given(scratch, rows.sparkSession, "gaps") as run:
        r = ranges.Ranges(rows, group, [F.col(order)], run, f"gaps-{name}")
        own_before, back = ranges.last_known(r, F.col(value))
        own_after, on = ranges.next_known(r, F.col(value))
        back_name, on_name = ranges.fresh(r.rows, "back"), ranges.fresh(r.rows, "on")
        out = r.carried(**{back_name: back, on_name: on})
        before, after = F.coalesce(own_before, back_name), F.coalesce(own_after, on_name)
        out = r.plain(out.withColumn(name, F.coalesce(F.col(value), (before + after) / 2, before, after)), name)
        return out if scratch else run.settled(out)[0]


def cost_rollup(rows: DataFrame, label: str, amount: str) -> DataFrame:
    """Sums by label, and the total under a null label."""
    return rows.rollup(label).agg(F.sum(amount).alias("amount"))


def per_unit(total: Column, units: Column) -> Column:
    """Total by units in decimal, to the cent; null for no units."""
    return F.when(units > 0, F.round(total.cast("decimal(18,2)") / units, 2).cast("decimal(18,2)"))


def linked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer link by name: key, in_left, in_right."""
    a, b = left.select(key, F.lit(True).alias("in_left")), right.select(key, F.lit(True).alias("in_right"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))
