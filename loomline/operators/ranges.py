"""Order within groups without a window over a whole group.

Rows are dealt by ranges of (group, order) and written once, with the number of their range.  A
window then runs within a range, and what a group's earlier (or later) ranges add is carried to it:
only the first and the last group of a range can go on in another, so at most two summaries a range
are carried, and broadcast.  A group of half the table spreads over half the tasks; rows that are
equal in group and order are told apart by a tie number, so they spread as well.

Defined cases: a null group is a group of its own; nulls come first in rising order; an empty table
gives no rows; columns of any name stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.scratch import Given, Scratch

#: (what a range says of a group, how the ranges before or after are put together, whether those after are meant)
Step = tuple[Column, Callable[[Column], Column], bool]


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Ranges:
    """``rows`` with columns ``part`` and ``tie``, written in ranges of (group, order)."""

    def __init__(self, rows: DataFrame, group: list[str], order: list[Column], scratch: Scratch, name: str = "ranges"):
        self.group, self.part, self.tie = group, fresh(rows, "part"), fresh(rows, "tie")
        self.order = [*order, F.col(self.tie)]
        told = rows.withColumn(self.tie, F.monotonically_increasing_id())
        dealt = told.repartitionByRange(*[F.col(g) for g in group], *self.order).withColumn(self.part, F.spark_partition_id())
        self.rows = scratch.write(dealt, f"{name}-{uuid.uuid4().hex[:8]}")
        self.columns = rows.columns

    def again(self, rows: DataFrame, scratch: Scratch, name: str = "again") -> Ranges:
        """The same ranges of rows that have been given further columns."""
        out = copy(self)
        out.rows = scratch.write(rows, f"{name}-{uuid.uuid4().hex[:8]}")
        return out

    def within(self) -> Window:
        """The window of a group's rows in one range, in order."""
        return Window.partitionBy(self.part, *self.group).orderBy(*self.order)

    def carried(self, **steps: Step) -> DataFrame:
        """The rows with, for each step, what the other ranges of the row's group say (null: there are none)."""
        at, lo, hi, *keys = (fresh(self.rows, c) for c in ("at", "lo", "hi", *(f"g{i}" for i in range(len(self.group)))))
        whole = F.struct(*self.group) if self.group else F.lit(0)
        ends = self.rows.groupBy(self.part).agg(F.min(whole).alias(lo), F.max(whole).alias(hi)).withColumnRenamed(self.part, at)
        edge = self.rows.join(F.broadcast(ends), F.col(self.part) == F.col(at))
        if self.group:
            edge = edge.filter(whole.eqNullSafe(F.col(lo)) | whole.eqNullSafe(F.col(hi)))
        said = edge.groupBy(at, *[F.col(g).alias(k) for g, k in zip(self.group, keys)]).agg(*[s.alias(n) for n, (s, _, _) in steps.items()])
        line = Window.partitionBy(*keys).orderBy(at)
        before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
        put = said.select(at, *keys, *[merge(F.col(n)).over(after if ahead else before).alias(n) for n, (_, merge, ahead) in steps.items()])
        where = F.col(self.part) == F.col(at)
        for g, k in zip(self.group, keys):
            where = where & F.col(g).eqNullSafe(F.col(k))
        # at most two rows a range
        return self.rows.join(F.broadcast(put), where, "left").drop(at, *keys)

    def plain(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select(*self.columns, *more)


def numbered(rows: DataFrame, order: list[Column], name: str = "idx", group: list[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """Rows numbered from 0 in order, within each group."""
    with Given(scratch, rows.sparkSession, "numbered") as run:
        r = Ranges(rows, list(group), order, run, f"numbered-{name}")
        before = fresh(r.rows, "before")
        own = F.row_number().over(r.within()) - 1
        out = r.carried(**{before: (F.count(F.lit(1)), F.sum, False)}).withColumn(name, F.coalesce(before, F.lit(0)) + own)
        return r.plain(out, name) if scratch else run.settled(r.plain(out, name))[0]


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str, group: list[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """The sum of ``value`` over the rows of the group up to and with this one; nulls count as nothing."""
    with Given(scratch, rows.sparkSession, "sums") as run:
        r = Ranges(rows, list(group), order, run, f"sum-{name}")
        before = fresh(r.rows, "before")
        own = F.sum(value).over(r.within().rowsBetween(Window.unboundedPreceding, 0))
        out = r.carried(**{before: (F.sum(value), F.sum, False)}).withColumn(name, F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)))
        return r.plain(out, name) if scratch else run.settled(r.plain(out, name))[0]


def previous(r: Ranges, value: Column) -> tuple[Column, Step]:
    """The value of the row before: in its range, and of the ranges before; it must not be null."""
    return F.lag(value).over(r.within()), (F.max_by(value, F.struct(*r.order)), lambda c: F.last(c, True), False)


def last_known(r: Ranges, value: Column) -> tuple[Column, Step]:
    """The last value that is not null up to this row: in its range, and of the ranges before."""
    own = F.last(value, True).over(r.within().rowsBetween(Window.unboundedPreceding, 0))
    return own, (F.max_by(value, F.when(value.isNotNull(), F.struct(*r.order))), lambda c: F.last(c, True), False)


def next_known(r: Ranges, value: Column) -> tuple[Column, Step]:
    """The first value that is not null from this row on: in its range, and of the ranges after."""
    own = F.first(value, True).over(r.within().rowsBetween(0, Window.unboundedFollowing))
    return own, (F.min_by(value, F.when(value.isNotNull(), F.struct(*r.order))), lambda c: F.first(c, True), True)
