"""Dates of a stated precision: a text names a day, a month, a quarter, a half or a year, and stands for the days from its first to its last.

The prototype keeps such texts and never reads them; reading them is an extension of this library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month names of the texts.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def span_of(text: Column) -> Column:
    """first, last: the days that the text stands for; null for a text that names no date (or a day that its month lacks).

    "18 Sep 2026", "Nov 2026", "Q1 2027", "H2 2026" and "2026", in either case, months by their name or its first three letters.
    """
    plain = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    found = lambda pattern, i: F.nullif(F.regexp_extract(plain, pattern, i), F.lit(""))
    month_name = "(" + "|".join(MONTHS) + ")[a-z]*"
    number = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    day_of, month_of, quarter_of, half_of, year_of = rf"^(\d{{1,2}}) {month_name} (\d{{4}})$", rf"^{month_name} (\d{{4}})$", r"^q([1-4]) (\d{4})$", r"^h([12]) (\d{4})$", r"^(\d{4})$"
    first_of = lambda year, month: F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    as_int = lambda c: c.cast("int")

    def whole(year: Column, month: Column, months: int) -> Column:
        first = first_of(year, month)
        return F.struct(first.alias("first"), F.date_sub(F.add_months(first, months), 1).alias("last"))

    day = F.try_to_timestamp(F.concat_ws("-", found(day_of, 3), F.lpad(number[found(day_of, 2)].cast("string"), 2, "0"), F.lpad(found(day_of, 1), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(found(day_of, 3).isNotNull() & day.isNotNull(), F.struct(day.alias("first"), day.alias("last")))
        .when(found(month_of, 2).isNotNull(), whole(as_int(found(month_of, 2)), number[found(month_of, 1)], 1))
        .when(found(quarter_of, 2).isNotNull(), whole(as_int(found(quarter_of, 2)), as_int(found(quarter_of, 1)) * 3 - 2, 3))
        .when(found(half_of, 2).isNotNull(), whole(as_int(found(half_of, 2)), as_int(found(half_of, 1)) * 6 - 5, 6))
        .when(found(year_of, 1).isNotNull(), whole(as_int(found(year_of, 1)), F.lit(1), 12))
    )


def before(span: Column, other: Column) -> Column:
    """Whether all days of one span lie before those of the other: true, false, or null where that depends on the days."""
    return F.when(span["last"] < other["first"], True).when(span["first"] >= other["last"], False)


def within(span: Column, frame: Column) -> Column:
    """Whether the span lies in the frame: true if all its days do, false if none does, null if some do."""
    inside = (span["first"] >= frame["first"]) & (span["last"] <= frame["last"])
    apart = (span["last"] < frame["first"]) | (span["first"] > frame["last"])
    return F.when(inside, True).when(apart, False)
