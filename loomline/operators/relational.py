"""DataFrame operators over stored collections: selection, counting, order as data, updates, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import ranges
from loomline.sources.scratch import Scratch


def count_where(rows: DataFrame, condition: Column, name: str = "n") -> DataFrame:
    """One row: how many rows meet the condition."""
    return rows.filter(condition).agg(F.count(F.lit(1)).alias(name))


def count_all(rows: DataFrame, name: str = "n") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def non_empty(rows: DataFrame, name: str = "any_rows") -> DataFrame:
    """One row: whether there is any row; at most one row a partition is read on."""
    return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))


def present_only(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull())


def unpivot_fields(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """Fixed fields as (keys, label, value) rows."""
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f).cast("string").alias("value")) for f, label in fields.items()])
    return rows.select(*keys, F.inline(pairs))


def first_n(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an order that is data."""
    return rows.orderBy(*order).limit(n)


def nth_row(rows: DataFrame, place: int, *order: str | Column) -> DataFrame:
    """The row at a place (from 0), or none."""
    return rows.orderBy(*order).offset(place).limit(1)


def row_index(rows: DataFrame, key: str, name: str = "idx", scratch: Scratch | None = None) -> DataFrame:
    """Number the rows from 0 by a key of any type that sorts; no task sorts a large table, see ``ranges``."""
    return ranges.numbered(rows, [F.col(key)], name, scratch=scratch)


def mark_last(rows: DataFrame, order: str, name: str = "is_last") -> DataFrame:
    """Flag the row of the largest order value; its maximum is one row, so it is broadcast."""
    top = rows.agg(F.max(order).alias("_top"))
    return rows.join(F.broadcast(top), F.col(order) <= F.col("_top"), "left").withColumn(name, F.col(order) == F.col("_top")).drop("_top")


def cyclic_next(place: Column, n: int) -> Column:
    return F.pmod(place + 1, F.lit(n))


def update_where(rows: DataFrame, condition: Column, column: str, value) -> DataFrame:
    """A copy with the column replaced in the rows that meet the condition; null conditions do not."""
    new = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(F.col(column))
    return rows.withColumn(column, new)


def update_first(rows: DataFrame, order: str, column: str, value) -> DataFrame:
    """A copy with the column replaced in the row of the smallest order value, which is one broadcast row."""
    least = rows.agg(F.min(order).alias("_least"))
    return update_where(rows.join(F.broadcast(least)), F.col(order) == F.col("_least"), column, value).drop("_least")


def append_if(rows: DataFrame, extra: DataFrame, flag: bool) -> DataFrame:
    """The rows and, under the flag, the extra ones."""
    return rows.unionByName(extra) if flag else rows


def append_new(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The rows and those extra ones whose key is not there yet."""
    return rows.unionByName(extra.dropDuplicates([key]).join(rows.select(key), key, "left_anti").select(*rows.columns))


def explode_list(rows: DataFrame, keys: list[str], items: Column, name: str = "item") -> DataFrame:
    """Each element with its place (from 0); an empty or null list gives no rows."""
    return rows.select(*keys, F.posexplode(items).alias("pos", name))


def explode_structs(rows: DataFrame, keys: list[str], items: Column) -> DataFrame:
    return rows.select(*keys, F.inline(items))
