"""State machines as a table of transitions, replayed over events in batch or in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.ranges import Ranges, last_known, previous
from loomline.sources.scratch import Given, Scratch

# Fixed values: (state, event) -> state; an event that is not listed leaves the state.
LOGISTICS = {
    ("empty", "ask"): "missing",
    ("missing", "answer"): "scenarios",
    ("scenarios", "approve"): "approved",
    ("approved", "choose"): "scenarios",
    ("scenarios", "ask"): "missing",
    ("approved", "ask"): "missing",
}
CONSULT = {("start", "choose"): "criteria", ("criteria", "send"): "review"}
BUILD = {("incomplete", "send"): "complete"}
MARKETING = {("not started", "send"): "started", ("started", "approve"): "approved"}
SCAN = {("empty", "run"): "scanning", ("scanning", "finish"): "results", ("results", "run"): "scanning"}
RESEARCH = {("empty", "run"): "researching", ("researching", "finish"): "results", ("results", "run"): "researching"}
#: Every machine with the state that it begins in.
MACHINES = {
    "logistics": (LOGISTICS, "empty"), "consult": (CONSULT, "start"), "build": (BUILD, "incomplete"), "marketing": (MARKETING, "not started"),
    "scan": (SCAN, "empty"), "research": (RESEARCH, "empty"),
}


def replay(events: DataFrame, moves: dict[tuple[str, str], str], start: str, held: DataFrame | None = None) -> DataFrame:
    """key and its state after all its events (key, at, event) in order; no Python.

    The events are dealt by ranges of (key, at), so those of a frequent key spread over tasks.  What
    a key has in one range is folded to a map from state to state, and its few maps are applied in turn.
    ``held``: key and state from which keys go on (others: ``start``).
    """
    table = F.create_map(*[F.lit(x) for (state, event), to in moves.items() for x in (f"{state}\n{event}", to)])
    states = sorted({start, *(s for s, _ in moves), *moves.values()})
    start = F.lit(start)

    def step(state, event):
        return F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), event)), state)

    ranges = events.select("key", "at", "event").repartitionByRange("key", "at").withColumn("part", F.spark_partition_id())
    inner = F.transform(F.array_sort(F.collect_list(F.struct("at", "event"))), lambda e: e["event"])
    ends = F.array(*[F.aggregate("events", F.lit(s), step) for s in states])
    to = F.map_from_arrays(F.array(*map(F.lit, states)), ends).alias("to")
    folded = ranges.groupBy("key", "part").agg(inner.alias("events")).select("key", "part", to)
    in_order = F.array_sort(F.collect_list(F.struct("part", F.map_entries("to").alias("to"))))
    maps = F.transform(in_order, lambda x: F.map_from_entries(x["to"]))
    whole = folded.groupBy("key").agg(maps.alias("maps"))
    if held is not None:
        from_held = held.select(F.col("key").alias("held_key"), F.col("state").alias("held"))
        whole = whole.join(from_held, F.col("key").eqNullSafe(F.col("held_key")), "left")
        start = F.coalesce("held", start)
    end = F.aggregate("maps", start, lambda state, to: F.element_at(to, state))
    return whole.select("key", end.alias("state"))


# ---------------------------------------------------------------- timers

# How long a scan and a research take, in microseconds, and the state that they end in.
SCAN_TIMERS = {"scanning": (800_000, "results")}
RESEARCH_TIMERS = {"researching": (700_000, "results")}


def _cycle(timers: dict[str, tuple[int, str]]) -> bool:
    for state in timers:
        at = state
        for _ in timers:
            at = timers[at][1] if at in timers else at
        if at in timers:
            return True
    return False


def replay_timed(
    events: DataFrame, moves: dict[tuple[str, str], str], start: str, timers: dict[str, tuple[int, str]], held: DataFrame | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """key, state and entered (the time at which it was entered) after all events (key, at, event) of a key, ``at`` in whole microseconds.

    A state with a timer is left for the timer's state once that much time has passed since it was entered.  ``held``: key, state and
    entered from which keys go on (others: ``start``), whose events lie before these.  Timers of the last state do not run beyond the last event: see ``expired``.

    Where more time passes than all timers take together, no timer is left running, so what follows depends on the state alone.  Events
    are dealt by ranges of (key, at); an event belongs to the range in which the last such pause of its key ended, and what
    a key has there is folded to a map from state to state.  So a key of half the rows spreads; what meets in one fold
    are the events of a range, and of a rush without a pause that goes on beyond it.
    """
    if not timers or start in timers or _cycle(timers):
        raise ValueError("timers are wanted, none of the state that keys begin in, and none that lead back to their state")
    table = F.create_map(*[F.lit(x) for (state, event), to in moves.items() for x in (f"{state}\n{event}", to)])
    longest = sum(took for took, _ in timers.values())
    took = F.create_map(*[F.lit(x) for state, (n, _) in timers.items() for x in (state, n)]).cast("map<string,bigint>")
    ends = F.create_map(*[F.lit(x) for state, (_, to) in timers.items() for x in (state, to)])
    begun = lambda state, entered: F.struct(state.cast("string").alias("state"), entered.cast("long").alias("entered"))

    def fire(acc: Column, now: Column | None) -> Column:
        for _ in timers:
            due = acc["entered"] + F.try_element_at(took, acc["state"])
            fires = due.isNotNull() if now is None else F.coalesce(due <= now, F.lit(False))
            acc = F.when(fires, begun(F.try_element_at(ends, acc["state"]), due)).otherwise(acc)
        return acc

    def step(acc: Column, e: Column) -> Column:
        acc = fire(acc, e["at"])
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), e["event"]))
        return F.when(to.isNotNull(), begun(to, e["at"])).otherwise(acc)

    own = events.select("key", F.col("at").cast("long").alias("at"), "event", F.lit(None).cast("string").alias("state"))
    if held is not None:  # a held state is an event that sets the state, before all others of the key
        own = own.unionByName(held.select("key", F.col("entered").cast("long").alias("at"), F.lit(None).cast("string").alias("event"), "state"))
    with Given(scratch, events.sparkSession, "timed") as run:
        r = Ranges(own, ["key"], [F.col("at"), F.col("state").isNull(), F.col("event")], run)
        before, step_before = previous(r, F.col("at"))
        known = r.carried(before=step_before).withColumn("before", F.coalesce(before, "before"))
        pause = F.when(F.col("before").isNull() | (F.col("at") - F.col("before") >= longest), F.col(r.part))
        again = r.again(known.withColumn("home", pause).drop("before"), run)
        home, step_home = last_known(again, F.col("home"))
        at_home = again.carried(carried=step_home).withColumn("home", F.coalesce(home, "carried")).select("key", "home", "at", "event", "state", r.tie)
        states = sorted({start, *(s for s, _ in moves), *moves.values(), *timers, *(to for _, to in timers.values())})
        settled = [s for s in states if s not in timers]
        first = F.col("state").isNull()
        inner = F.array_sort(F.collect_list(F.struct("at", first.alias("later"), "event", "state", r.tie)))
        grouped = at_home.groupBy("key", "home").agg(inner.alias("events"))
        set_or_step = lambda acc, e: F.when(e["state"].isNotNull(), begun(e["state"], e["at"])).otherwise(step(acc, e))
        never = F.lit(None).cast("long")
        last = F.map_from_arrays(F.array(*map(F.lit, settled)), F.array(*[F.aggregate("events", begun(F.lit(s), never), set_or_step) for s in settled]))
        folded = run.write(grouped.select("key", "home", F.map_entries(last).alias("last")), "folded")
        in_order = F.array_sort(F.collect_list(F.struct("home", "last")))
        whole = folded.groupBy("key").agg(F.transform(in_order, lambda x: x["last"]).alias("maps"))

        def through(acc: Column, entries: Column) -> Column:
            # what a pause leaves running has ended by its end
            out = F.element_at(F.map_from_entries(entries), fire(acc, None)["state"])
            return F.when(out["entered"].isNull(), fire(acc, None)).otherwise(out)

        end = F.aggregate("maps", begun(F.lit(start), never), through)
        out = whole.select("key", end.alias("end")).select("key", "end.state", "end.entered")
        return out if scratch else run.settled(out)[0]


def expired(states: DataFrame, timers: dict[str, tuple[int, str]], now: Column) -> DataFrame:
    """key, state, entered as they are at ``now``: timers that have run out by then have moved their states."""
    for _ in timers:
        state, entered = F.col("state"), F.col("entered")
        for name, (n, to) in timers.items():
            due = (F.col("state") == name) & (F.col("entered") + n <= now)
            state, entered = F.when(due, to).otherwise(state), F.when(due, F.col("entered") + n).otherwise(entered)
        states = states.select("key", state.alias("state"), entered.alias("entered"))
    return states


class StateStream:
    """``replay`` (or, with timers, ``replay_timed``) over a stream, for ``foreachBatch``: the states of a micro-batch are written by its number under ``folder``.

    No Python sees a row, and a key's events of a batch need not fit in a task.  A batch reads the states before it, so made again it
    replaces what it wrote.  Every ``COMPACT`` batches all states are written together, and older ones are not read any more.
    Events are taken batch by batch: one that is earlier than what its key has already met counts from then.
    """

    COMPACT = 16

    def __init__(self, spark, folder: str, moves: dict[tuple[str, str], str], start: str, timers: dict[str, tuple[int, str]] | None = None):
        self.spark, self.folder, self.moves, self.start, self.timers = spark, folder.rstrip("/"), moves, start, timers or {}

    def states(self, before: int | None = None) -> DataFrame | None:
        """key, state, entered after all batches (or those before one); null: there are none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        batches = sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return None
        whole = max((b for b in batches if b % self.COMPACT == self.COMPACT - 1), default=0)
        rows = self.spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/batch={b}" for b in batches if b >= whole])
        return rows.groupBy("key").agg(F.max_by(F.struct("state", "entered"), "batch").alias("x")).select("key", "x.state", "x.entered")

    def take(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of (key, at, event)."""
        held = self.states(batch)
        touched = rows.select("key").distinct().withColumnRenamed("key", "k")
        same = F.col("key").eqNullSafe(F.col("k"))
        going = None if held is None else held.join(touched, same, "left_semi")
        with Scratch(self.spark, "state-batch") as run:
            if not self.timers:
                new = replay(rows, self.moves, self.start, going).withColumn("entered", F.lit(None).cast("long"))
            else:
                if going is not None:  # not before what the key has met
                    going = going.filter("entered is not null")
                    met = going.select(F.col("key").alias("k"), F.col("entered").alias("least"))
                    rows = rows.join(met, same, "left").withColumn("at", F.greatest("at", F.coalesce("least", "at"))).select("key", "at", "event")
                new = run.write(replay_timed(rows, self.moves, self.start, self.timers, going, run), "new")
            if batch % self.COMPACT == self.COMPACT - 1 and held is not None:
                new = new.unionByName(held.join(touched, same, "left_anti"))
            new.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
