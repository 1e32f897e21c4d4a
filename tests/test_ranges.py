"""Order over ranges, joins in time and percentiles, against plain restatements on odd tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import insights as I
from loomline.operators import ranges, selection, timejoins
from loomline.sources import stores
from loomline.sources.scratch import Scratch


@pytest.fixture
def many_ranges(spark):
    """So many ranges that groups go on in others."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _rows(n, seed=3):
    """A third of the rows in one group, a tenth in the null group; ties in order; null values; names that the operators use."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if rng.random() < 0.35 else None if rng.random() < 0.1 else f"g{rng.randrange(40)}"
        out.append((g, rng.randrange(n // 2), None if rng.random() < 0.5 else float(rng.randrange(100)), i, "x", "y"))
    return out


KIND = "g string, o int, v double, i int, part string, at string"


def test_numbered(spark, many_ranges):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = {r["i"]: r["idx"] for r in ranges.numbered(df, [F.col("o"), F.col("i")], "idx", ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r[3]: k for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3])))}
    assert got == want
    ranked = {r["i"]: r["rank"] for r in I.ranked(df, "v", "i", ["g"]).collect()}
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[3]))
        assert all(ranked[r[3]] == k for k, r in enumerate(order, 1))
    # one group of equal rows: any numbering, but whole, and over several tasks
    same = spark.range(1000).select(F.lit(1).alias("k"))
    with Scratch(spark, "t") as run:
        out = ranges.numbered(same, [F.col("k")], "idx", scratch=run)
        assert sorted(r["idx"] for r in out.collect()) == list(range(1000))
        assert ranges.Ranges(same, ["k"], [], run, "again").rows.select("part").distinct().count() > 3
    assert ranges.numbered(df.filter("false"), [F.col("o")], "idx", ["g"]).count() == 0


def test_running_sum(spark, many_ranges):
    rows = _rows(2000, 5)
    got = {r["i"]: r["s"] for r in ranges.running_sum(spark.createDataFrame(rows, KIND), [F.col("o"), F.col("i")], "v", "s", ["g"]).collect()}
    for g in {r[0] for r in rows}:
        total = 0.0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3])):
            total += r[2] or 0
            assert got[r[3]] == total


def test_fill_gaps_of_a_hot_group(spark, many_ranges):
    rows = [r for r in _rows(2500, 7)]
    rows = [(g, k, v if g != "g1" else None, i, p, a) for k, (g, _, v, i, p, a) in enumerate(rows)]
    got = {r["i"]: r["filled"] for r in I.fill_gaps(spark.createDataFrame(rows, KIND), "v", ["g"], "o").collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for k, r in enumerate(own):
            back = next((x[2] for x in reversed(own[: k + 1]) if x[2] is not None), None)
            on = next((x[2] for x in own[k:] if x[2] is not None), None)
            both = [x for x in (back, on) if x is not None]
            assert got[r[3]] == (sum(both) / len(both) if both else None)


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, many_ranges, strict):
    rng = random.Random(11)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(60)]), i, "x") for i in range(600)] + [("a", 5, 5000, "x")] * 3
    right = [(key(), rng.choice([None, *range(60)]), i, f"w{i % 5}") for i in range(90)]
    a, b = spark.createDataFrame(left, "k string, at int, i int, row string"), spark.createDataFrame(right, "k string, at int, i int, row string")
    got = timejoins.asof(a, b, [("k", "k")], ("at", "at"), {"row": "found", "i": "place"}, ["i"], strict)
    assert got.columns == ["k", "at", "i", "row", "found", "place"]
    rows = got.collect()
    assert len(rows) == len(left)
    for r in rows:
        before = [x for x in right if None not in (x[0], x[1], r["k"], r["at"]) and x[0] == r["k"] and (x[1] < r["at"] or x[1] == r["at"] and not strict)]
        best = max(before, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        assert (r["found"], r["place"]) == (best[3], best[2])
    assert timejoins.asof(a, b.filter("false"), [("k", "k")], ("at", "at"), {"row": "found"}).filter("found is null").count() == len(left)
    assert timejoins.asof(a.filter("false"), b, [("k", "k")], ("at", "at"), {"row": "found"}).count() == 0
    # no window over a whole key: the ranges are part of its keys
    text = got._jdf.queryExecution().toString()
    assert "Python" not in text


def test_overlaps(spark):
    rng = random.Random(13)
    spans = []
    for i in range(400):
        s = rng.randrange(-5000, 5000)
        spans.append((rng.choice(["hot", "hot", "a", None]), s, s + rng.choice([0, 1, 4, 16, 17, 300, rng.randrange(2000), -3]), i))
    spans += [("hot", -10**15, 10**15, 900), ("a", 3, None, 901), ("a", 7, 7, 902), ("a", 7, 7, 902)]
    df = spark.createDataFrame(spans, "k string, s long, e long, i int")
    span = (F.col("s"), F.col("e"))
    pairs = timejoins.overlaps(df, df, [("k", "k")], span, span)
    got = sorted((r["left"]["i"], r["right"]["i"]) for r in pairs.collect())
    fit = [x for x in spans if None not in x and x[1] <= x[2]]
    want = sorted((x[3], y[3]) for x in fit for y in fit if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert got == want
    with Scratch(spark, "t") as run:
        plan = timejoins.overlaps(df, df, [("k", "k")], span, span, run)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        # a span in the bins of its own level twice at most, whatever its length
        assert timejoins.overlaps(df.filter("i = 900"), df.filter("i = 900"), [("k", "k")], span, span, run := Scratch(spark, "t2")).count() == 1
        run.drop()
    assert timejoins.overlaps(df.filter("false"), df, [("k", "k")], span, span).count() == 0


def _rank(values, share):
    values = sorted(x for x in values if x is not None and not math.isnan(x))
    n = len(values)
    return values[max(1, n - math.floor(n - n * share)) - 1] if n else None


def test_percentiles(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 8)
    rng = random.Random(17)
    values = [0.0, 1e-300, 1e300, -1e308, 1e308, float("inf"), float("-inf"), float("nan"), None, 3.0, 3.0, 3.0]
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice(values) if rng.random() < 0.4 else rng.gauss(0, 1), "x") for _ in range(1500)]
    rows += [("empty", None, "x"), ("one", 7.0, "x")]
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = selection.percentiles(spark.createDataFrame(rows, "g string, v double, share string"), ["g"], "v", shares).collect()
    assert {(r["g"], r["share"]): r["v"] for r in got} == {(g, p): _rank([v for h, v, _ in rows if h == g], p) for g in {r[0] for r in rows} for p in shares}
    # whole numbers that doubles do not tell apart
    big = [(2**62 + rng.randrange(200),) for _ in range(300)]
    got = selection.percentiles(spark.createDataFrame(big, "v long"), [], "v", shares).collect()
    assert {r["share"]: r["v"] for r in got} == {p: _rank([v for v, in big], p) for p in shares}
    assert selection.percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", shares).count() == 0


def test_state_after_a_crash(spark, tmp_path):
    where = f"file://{tmp_path}/state"
    state = spark.createDataFrame([("a", "1"), (None, "kept")], "key string, value string")
    stores.write_state(state, where)
    stores.write_state(stores.with_setting(stores.read_state(spark, where), "a", "2"), where)
    assert sorted(map(tuple, stores.read_state(spark, where).collect()), key=repr) == [("a", "2"), (None, "kept")]
    (tmp_path / "state").rename(tmp_path / "state.0123.old")
    assert stores.read_state(spark, where).count() == 2
    with pytest.raises(FileNotFoundError):
        stores.read_state(spark, f"file://{tmp_path}/none")


def test_scratch_goes(spark):
    from pathlib import Path

    with pytest.raises(ZeroDivisionError), Scratch(spark, "gone") as run:
        run.write(spark.range(3), "a")
        held = run.write_bucketed(spark.range(3), "b", "id", 2)
        root = Path(run.root.removeprefix("file://"))
        assert held.count() == 3 and root.exists()
        raise ZeroDivisionError
    assert not root.exists() and not any(t.name.startswith("loomline_") for t in spark.catalog.listTables())
