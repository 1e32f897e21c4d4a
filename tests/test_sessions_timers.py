"""Sessions, timers, dates of a precision, suggestions and division, against plain restatements."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import dates
from loomline.operators import insights as I
from loomline.streaming import sessions
from loomline.streaming import transitions as T

from test_ranges import many_ranges  # noqa: F401

KIND = "key string, at long, event string, part string"


def _events(n, seed, span):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    return [(key(), rng.randrange(span), rng.choice(["run", "run", "stop", "other"]), "x") for _ in range(n)]


# ---------------------------------------------------------------- sessions

def plain_sessions(rows, gap):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == key and r[1] is not None)
        begin = last = None
        for t in own:
            if last is None or t - last > gap:
                begin = t
                out.append([key, begin, t, 0])
            last = t
            out[-1][2:] = [t, out[-1][3] + 1]
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("span", [100_000, 500])
def test_sessions(spark, many_ranges, span):  # noqa: F811
    """Also where nearly all rows are one session that goes on over ranges."""
    rows = [*_events(1500, 3, span), ("a", None, "run", "x")]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = sessions.sessions(df, "key", "at", 40).select("key", "session_start", "session_end", "n").collect()
    assert sorted(map(tuple, got), key=repr) == plain_sessions(rows, 40)
    whole = sessions.in_sessions(df, "key", "at", 40)
    assert whole.columns == [*df.columns, "session_start"] and whole.count() == len(rows)
    assert sessions.sessions(df.filter("false"), "key", "at", 40).count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    """Late rows are kept apart, batches that are made again change nothing, and the rest is what batch gives."""
    rng = random.Random(5)
    rows = sorted(_events(600, 7, 20_000), key=lambda r: r[1] + rng.randrange(400))
    rows.insert(500, ("a", 3, "run", "far too late"))
    parts = [rows[i : i + 120] for i in range(0, len(rows), 120)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    kept = sessions.SessionStream(spark, f"file://{tmp_path}/kept", "key", "at", 40, 150)

    def run(n):
        """Over the first n folders, from the checkpoint on."""
        for i in range(n):
            if not (tmp_path / f"all/{i}.parquet").exists():
                (tmp_path / "all").mkdir(exist_ok=True)
                (source,) = (tmp_path / f"in/{i}").glob("part-*.parquet")
                (tmp_path / f"all/{i}.parquet").write_bytes(source.read_bytes())
                os.utime(tmp_path / f"all/{i}.parquet", (10**9 + i, 10**9 + i))  # the order of the micro-batches
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
        query = stream.writeStream.foreachBatch(kept.take).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)

    run(2)
    run(len(parts))
    late, fine, latest = [], [], None
    for part in parts:
        for r in part:
            (late if latest is not None and r[1] < latest - 150 else fine).append(r)
        latest = max([latest or 0, *(r[1] for r in part)])
    assert ("a", 3, "run", "far too late") in late and kept.watermark() == latest - 150
    assert sorted(map(tuple, kept.late().select("key", "at", "event", "part").collect()), key=repr) == sorted(late, key=repr)
    told = lambda df: sorted(map(tuple, df.select("key", "session_start", "session_end", "n").collect()), key=repr)
    assert told(kept.sessions(closed=False)) == plain_sessions(fine, 40)
    assert told(kept.sessions()) == [s for s in plain_sessions(fine, 40) if s[2] + 40 < latest - 150]
    kept.take(spark.createDataFrame(parts[-1], KIND), len(parts) - 1)  # once more
    assert told(kept.sessions(closed=False)) == plain_sessions(fine, 40)


# ---------------------------------------------------------------- timers

MOVES = {("empty", "run"): "busy", ("done", "run"): "busy", ("busy", "stop"): "empty", ("kept", "stop"): "empty"}
TIMERS = {"busy": (60, "done"), "done": (200, "kept")}


def plain_timed(rows, start="empty", held=None):
    out = dict(held or {})
    for key, at, event, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        state, entered = out.get(key, (start, None))
        while state in TIMERS and entered is not None and entered + TIMERS[state][0] <= at:
            state, entered = TIMERS[state][1], entered + TIMERS[state][0]
        if (to := MOVES.get((state, event))) is not None:
            state, entered = to, at
        out[key] = (state, entered)
    return out


@pytest.mark.parametrize("span", [200_000, 20_000, 900])
def test_timers(spark, many_ranges, span):  # noqa: F811
    rows = _events(1500, 11, span)
    df = spark.createDataFrame(rows, KIND)
    got = T.replay_timed(df, MOVES, "empty", TIMERS)
    want = plain_timed(rows)
    assert {r["key"]: (r["state"], r["entered"]) for r in got.collect()} == want
    later = T.expired(got, TIMERS, F.lit(10**9))
    assert {r["key"]: r["state"] for r in later.collect()} == {k: "kept" if s in ("busy", "done") else s for k, (s, _) in want.items()}
    assert T.replay_timed(df.filter("false"), MOVES, "empty", TIMERS).count() == 0
    for bad in ({}, {"empty": (3, "busy")}, {"busy": (1, "done"), "done": (1, "busy")}):
        with pytest.raises(ValueError):
            T.replay_timed(df, MOVES, "empty", bad)


def test_timers_of_a_stream(spark, tmp_path, monkeypatch):
    """Batch by batch, with one made again and all states written together at times: what one replay gives."""
    monkeypatch.setattr(T.StateStream, "COMPACT", 3)
    rows = sorted(_events(500, 13, 20_000), key=lambda r: (r[1], r[2]))
    rows = [("old", 5, "run", "x"), *rows]
    parts = [rows[i : i + 100] for i in range(0, len(rows), 100)]
    for i, part in enumerate(parts):
        (tmp_path / "in").mkdir(exist_ok=True)
        spark.createDataFrame(part, KIND).toPandas().to_parquet(tmp_path / f"in/{i}.parquet")
        os.utime(tmp_path / f"in/{i}.parquet", (10**9 + i, 10**9 + i))
    kept = T.StateStream(spark, f"file://{tmp_path}/kept", MOVES, "empty", TIMERS)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select("key", "at", "event")
    stream.writeStream.foreachBatch(kept.take).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(240)
    told = lambda: {r["key"]: (r["state"], r["entered"]) for r in kept.states().collect()}
    assert told() == plain_timed(rows)
    kept.take(spark.createDataFrame(parts[-1], KIND).select("key", "at", "event"), len(parts) - 1)
    assert told() == plain_timed(rows) and kept.states(0) is None


# ---------------------------------------------------------------- dates, suggestions, division

def test_dates_of_a_precision(spark):
    d = datetime.date
    want = {
        "18 Sep 2026": (d(2026, 9, 18), d(2026, 9, 18)), " 1  september 2026 ": (d(2026, 9, 1), d(2026, 9, 1)), "29 Feb 2024": (d(2024, 2, 29),) * 2, "Nov 2026": (d(2026, 11, 1), d(2026, 11, 30)),
        "feb 2024": (d(2024, 2, 1), d(2024, 2, 29)), "Q1 2027": (d(2027, 1, 1), d(2027, 3, 31)), "h2 2026": (d(2026, 7, 1), d(2026, 12, 31)), "2026": (d(2026, 1, 1), d(2026, 12, 31)),
        "31 Feb 2026": None, "Before occupation": None, "4 years, call-off basis": None, "Q5 2026": None, "": None, None: None, "Yesterday": None, "0 Jan 2026": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").withColumn("s", dates.span_of(F.col("t")))
    assert {r["t"]: r["s"] and tuple(r["s"]) for r in df.collect()} == want
    pairs = [("Q1 2027", "Apr 2027", True, None), ("Apr 2027", "Q1 2027", False, None), ("Nov 2026", "Q4 2026", None, None), ("5 Nov 2026", "5 Nov 2026", False, None), ("2026", "soon", None, None)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean, x string")
    assert df.select(dates.before(dates.span_of(F.col("a")), dates.span_of(F.col("b"))).eqNullSafe(F.col("want")).alias("ok")).filter("not ok").count() == 0
    frame = dates.span_of(F.lit("Q4 2026"))
    got = [r[0] for r in spark.createDataFrame([("Nov 2026",), ("2026",), ("2027",), ("x",)], "a string").select(dates.within(dates.span_of(F.col("a")), frame)).collect()]
    assert got == [True, None, False, None]


def test_suggestions(spark):
    rows = spark.createDataFrame(
        [(1, "2026-09-10", "High", "City Council", " ", "Granted", 10.0, "noise survey"), (2, None, None, None, "An architect", None, None, None), (3, "2026-12-01", "Low", "A firm", None, "granted", 9e6, "building acoustics")],
        "id int, deadline string, band string, buyer string, architect string, status string, value_eur double, text string",
    )
    as_of = F.lit("2026-09-01").cast("date")
    found = {name: [r["id"] for r in I.suggested(rows, name, as_of).orderBy("id").collect()] for name in I.SUGGESTIONS}
    assert found == {
        "closing in the next 30 days": [1], "strong fit": [1], "public sector": [1], "planning, environmental noise or building acoustics": [3],
        "architect has been identified": [2], "granted with noise-related conditions": [1], "high value": [3],
    }
    with pytest.raises(KeyError):
        I.suggested(rows, "anything else", as_of)


def test_covering(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", None), (None, 1), (None, 2)], "k string, i int")
    keys = lambda wanted: sorted(r["k"] for r in I.covering(rows, "k", "i", spark.createDataFrame(wanted, "x int")).collect())
    assert keys([(1,), (2,), (2,), (None,)]) == ["a"] and keys([(1,)]) == ["a", "b"] and keys([]) == ["a", "b", "c"] and keys([(9,)]) == []
    assert I.covering(rows.filter("false"), "k", "i", spark.createDataFrame([(1,)], "x int")).count() == 0
