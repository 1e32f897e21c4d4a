"""Golden values and edge cases on small collections."""

import functools
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import insights as I
from loomline.operators import relational as R
from loomline.sources import collections, stores
from loomline.streaming import transitions as T


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize("currency,text", [("EUR", "€26 900,00"), ("GBP", "£23,134.00"), ("USD", "$29,321.00")])
def test_golden_amounts(spark, currency, text):
    assert one(spark, S.format_money(F.lit(26900), currency)) == text


@pytest.mark.parametrize("amount,text", [("0.125", "€0,13"), ("2.675", "€2,68"), ("1.005", "€1,01"), ("-1234.5", "€-1 234,50")])
def test_cents(spark, amount, text):
    assert one(spark, S.format_money(F.round(F.lit(Decimal(amount)), 2), "EUR")) == text


def test_unknown_currency():
    with pytest.raises(ValueError):
        S.convert(F.lit(1), "XXX")


@pytest.mark.parametrize("text,value", [("€14 880", "14880.00"), ("€2 960,00", "2960.00"), ("€6.2m", "6200000.00"), ("€31.4m", "31400000.00"), ("–", None), ("Nov 2026", None), ("", None)])
def test_parse_amounts(spark, text, value):
    assert one(spark, S.parse_eur(F.lit(text))) == (None if value is None else Decimal(value))


def test_text_functions(spark):
    assert one(spark, S.trim_all(F.lit("\t  x y  \n"))) == "x y"
    assert one(spark, S.is_blank(F.lit(" \t ")))
    assert one(spark, S.default_if_blank(F.lit(None).cast("string"), "none")) == "none"
    assert one(spark, S.plain_spaces(F.lit("1 234 x y"))) == "1 234 x y"
    assert one(spark, S.split_first(F.lit("Scenario A · Recommended"), " · ")) == "Scenario A"
    assert one(spark, S.split_first(F.lit("whole"), " · ")) == "whole"
    assert one(spark, S.replace_first(F.lit("text-a text-b"), "text-", "bg-")) == "bg-a text-b"
    assert one(spark, S.replace_first(F.lit("none"), "text-", "bg-")) == "none"
    assert one(spark, S.joined(F.lit("a"), F.lit(None).cast("string"))) == "a · "


def test_lookups(spark):
    prefixes = [("/consult", "consult"), ("/build", "build")]
    assert one(spark, S.classify_prefix(F.lit("/consultx"), prefixes)) == "consult"
    assert one(spark, S.classify_prefix(F.lit("/"), prefixes)) is None
    assert one(spark, S.lookup(F.lit("z"), {"a": "A"})) is None
    assert one(spark, S.lookup(F.lit(None).cast("string"), {"a": "A"}, "?")) == "?"
    assert one(spark, S.open_flag(F.lit("open"), False)) and not one(spark, S.open_flag(F.lit("x"), False))


def test_lists(spark):
    held = F.array(F.lit("a"), F.lit(None).cast("string"))
    assert one(spark, S.contains(held, "b")) is False
    assert one(spark, S.append_distinct(held, "a")) == ["a", None]
    assert one(spark, S.append_distinct(F.array(F.lit("a")), "b")) == ["a", "b"]
    assert one(spark, S.remove_at(F.array(F.lit(1), F.lit(2)), 1)) == [1]
    assert one(spark, S.remove_at(F.array(F.lit(1)), 7)) == [1]
    rows = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, None)], "id int, items array<string>")
    assert R.explode_list(rows, ["id"], F.col("items")).count() == 2


def test_rows(spark):
    kinds = "name string, status string"
    rows = stores.collection(spark, [("a", "New"), ("b", None), ("c", "Review")], kinds)
    assert [r["ord"] for r in rows.orderBy("ord").collect()] == [0, 1, 2]
    changed = R.update_where(rows, F.col("status") == "New", "status", "Review")
    assert [r["status"] for r in changed.orderBy("ord").collect()] == ["Review", None, "Review"]
    assert R.non_empty(rows.filter("false")).first()[0] is False
    assert [r["is_last"] for r in R.mark_last(rows, "ord").orderBy("ord").collect()] == [False, False, True]
    assert R.mark_last(rows.filter("false"), "ord").count() == 0
    assert R.nth_row(rows, 9, "ord").count() == 0 and R.nth_row(rows, 1, "ord").first()["name"] == "b"
    extra = spark.createDataFrame([(7, "a", "x"), (8, "d", "x"), (9, "d", "x")], rows.schema)
    assert R.append_new(rows, extra, "name").count() == 4
    numbered = R.row_index(spark.range(1000).select((F.col("id") * 3).alias("k")), "k")
    assert [tuple(r) for r in numbered.orderBy("k").collect()] == [(3 * i, i) for i in range(1000)]


def test_proposals(spark):
    scores = [("tender", s, b) for s, b in ((91, "High"), (84, "High"), (76, "Medium"), (68, "Medium"), (58, "Low"), (72, "Medium"), (79, "High"))]
    scores += [("planning", s, b) for s, b in ((88, "High"), (82, "High"), (64, "Medium"), (55, "Medium"), (47, "Low"), (73, "Medium"))]
    rows = spark.createDataFrame(scores, "source string, score int, band string")
    assert rows.filter(~I.fit_band(F.col("source"), F.col("score")).eqNullSafe(F.col("band"))).count() == 0
    report = spark.createDataFrame([("Measured", 47, "Pass"), ("Measured", 45, "Pass"), ("Interpolated", 44, "Review")], "m string, v int, w string")
    assert report.filter(I.verdict(F.col("m"), F.col("v")) != F.col("w")).count() == 0
    gaps = spark.createDataFrame([(1, 1, 4.0), (1, 2, None), (1, 3, 8.0), (1, 4, None), (2, 1, None)], "g int, o int, v double")
    assert [r["filled"] for r in I.fill_gaps(gaps, "v", ["g"], "o").orderBy("g", "o").collect()] == [4.0, 6.0, 8.0, 8.0, None]
    assert one(spark, I.per_unit(F.lit(14880), F.lit(4))) == Decimal("3720.00")
    assert one(spark, I.per_unit(F.lit(14880), F.lit(7))) == Decimal("2125.71")
    costs = spark.createDataFrame([("a", 18400), ("b", 6500), ("c", 2000)], "label string, amount int")
    assert {tuple(r) for r in I.cost_rollup(costs, "label", "amount").collect()} == {("a", 18400), ("b", 6500), ("c", 2000), (None, 26900)}


def test_stores(spark, tmp_path):
    state = spark.createDataFrame([("theme", "dark")], "key string, value string")
    assert stores.setting(state, "currency", "EUR").first()[0] == "EUR"
    state = stores.with_setting(stores.with_setting(state, "currency", "GBP"), "currency", "USD")
    stores.write_state(state, str(tmp_path / "state"))
    assert stores.setting(spark.read.parquet(str(tmp_path / "state")), "currency", "EUR").first()[0] == "USD"
    # the one use of it: read, change, write back
    where = str(tmp_path / "state")
    stores.write_state(stores.with_setting(spark.read.parquet(where), "theme", "light"), where)
    assert {tuple(r) for r in spark.read.parquet(where).collect()} == {("theme", "light"), ("currency", "USD")}
    assert [p.name for p in tmp_path.iterdir()] == ["state"]
    stores.export_csv(spark.createDataFrame([("Panel", "4", "pcs")], "item string, qty string, unit string"), str(tmp_path / "csv"), {"Item": "item", "Qty": "qty", "Unit": "unit"})
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"Item": "Panel", "Qty": "4", "Unit": "pcs"}
    for name in ("a.pdf", "b.txt", "c.csv"):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_text("x")
    assert {r["name"] for r in stores.attached(spark, str(tmp_path / "files")).collect()} == {"a.pdf", "c.csv"}


EVENTS = [("k", 1, "ask"), ("k", 2, "approve"), ("k", 3, "answer"), ("k", 4, "approve"), ("k", 5, "choose"), ("m", 1, "answer")]


def test_transitions(spark):
    events = spark.createDataFrame(EVENTS, "key string, at int, event string")
    assert {tuple(r) for r in T.replay(events, T.LOGISTICS, "empty").collect()} == {("k", "scenarios"), ("m", "empty")}
    assert T.replay(events.filter("false"), T.LOGISTICS, "empty").count() == 0


@pytest.mark.parametrize("name", sorted(T.MACHINES))
def test_machines(spark, name):
    """Every move and every event that is none, in the order of time, also of a key with most of the events."""
    moves, start = T.MACHINES[name]
    rng = random.Random(name)
    events = sorted({e for _, e in moves}) + ["other"]
    rows = [(key, at, rng.choice(events)) for key, n in (("a", 2000), ("b", 3), ("c", 40)) for at in range(n)]
    want = {}
    for key, _, event in rows:
        want[key] = moves.get((want.get(key, start), event), want.get(key, start))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, event string").repartition(3)
    assert {tuple(r) for r in T.replay(df, moves, start).collect()} == set(want.items())
    assert all(moves[(s, e)] in {x for x, _ in moves} | set(moves.values()) for s, e in moves)


def test_machine_paths():
    follow = lambda name, *events: functools.reduce(lambda s, e: T.MACHINES[name][0].get((s, e), s), events, T.MACHINES[name][1])
    assert follow("consult", "send") == "start" and follow("consult", "choose", "send", "send") == "review"
    assert follow("build", "send", "send") == "complete"
    assert follow("marketing", "approve") == "not started" and follow("marketing", "send", "approve", "send") == "approved"
    assert follow("scan", "run") == "scanning" and follow("scan", "run", "finish", "run", "finish") == "results"
    assert follow("research", "finish") == "empty" and follow("research", "run") == "researching"


def test_collections(spark):
    sizes = {"tenders": 7, "planning_signals": 6, "priority_leads": 3, "funnel": 14, "cost_breakdown": 3, "bom_sheet": 6, "logistics_scenarios": 3, "engagements": 3, "travel_plans": 4, "report_rows": 4, "currency": 3}
    held = {name: collections.load(spark, name) for name in collections.LOADERS}
    assert {name: df.count() for name, df in held.items()} == sizes
    assert held["bom_sheet"].agg(F.sum("cost_eur")).first()[0] == 12380 and held["tenders"].filter("deadline_date is null").count() == 0
    signals = held["planning_signals"]
    assert R.explode_list(signals, ["id"], F.col("other_parties")).count() == 2
    assert [signals.filter(f"{c} is null").count() for c in ("architect", "planning_agent", "main_contractor")] == [1, 1, 4]
    assert signals.filter(I.fit_band(F.lit("planning"), F.col("fit_score")) != F.col("fit_band")).count() == 0
    assert held["report_rows"].filter(I.verdict(F.col("method"), F.col("dntw_db")) != F.col("verdict")).count() == 0
    scenarios = held["logistics_scenarios"].select(S.parse_eur(F.col("total")).alias("t"), S.parse_eur(F.col("per_traveller")).alias("p"), S.parse_eur(F.col("per_day")).alias("d"))
    assert scenarios.filter((I.per_unit(F.col("t"), F.lit(4)) != F.col("p")) | (F.abs(F.col("t") / 7 - F.col("d")) > 0.5)).count() == 0
    plans = I.linked(held["travel_plans"].withColumnRenamed("engagement", "name"), held["engagements"], "name")
    assert sorted(tuple(r)[1:] for r in plans.collect()) == [(False, True), (True, False), (True, False), (True, True), (True, True)]
    rates = held["funnel"].withColumn("before", F.lag("value").over(Window.partitionBy("funnel").orderBy("ord")))
    assert rates.filter("value > before").count() == 0


def test_transitions_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, "key string, at int, event string")
    for part in ("at <= 2", "at > 2"):  # two micro-batches
        events.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = T.StateStream(spark, f"file://{tmp_path}/kept", T.LOGISTICS, "empty")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(kept.take).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r)[:2] for r in kept.states().collect()} == {("k", "scenarios"), ("m", "empty")}
