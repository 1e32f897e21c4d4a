"""Column functions: text, lookups and money.  All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rate against EUR and symbol of each currency.
RATES = {"EUR": Decimal("1.00"), "GBP": Decimal("0.86"), "USD": Decimal("1.09")}
SYMBOLS = {"EUR": "€", "GBP": "£", "USD": "$"}

MONEY = T.DecimalType(18, 2)


# ------------------------------------------------------------------ text

def trim_all(text: Column) -> Column:
    """Trim every Unicode white space, not only U+0020."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def is_blank(text: Column) -> Column:
    return trim_all(text) == ""


def default_if_blank(text: Column, default: str) -> Column:
    """The trimmed text, or the default where nothing is left or there was none."""
    return F.when(F.coalesce(trim_all(text), F.lit("")) == "", F.lit(default)).otherwise(trim_all(text))


def plain_spaces(text: Column) -> Column:
    """No-break, thin and narrow no-break spaces become U+0020."""
    return F.translate(text, "\u00a0\u2009\u202f", "   ")


def split_first(text: Column, separator: str) -> Column:
    """What stands before the separator, or the whole text."""
    return F.substring_index(text, separator, 1)


def replace_first(text: Column, old: str, new: str) -> Column:
    """Replace the first occurrence of a literal."""
    at = F.instr(text, old)
    changed = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), text.substr(at + len(old), F.length(text)))
    return F.when(at > 0, changed).otherwise(text)


def joined(*parts: Column, separator: str = " · ") -> Column:
    """All parts with the separator between; a null part is empty but keeps its separator."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit(separator)] * bool(out) + [F.coalesce(p.cast("string"), F.lit(""))]
    return F.concat(*out)


# ------------------------------------------------------------------ lookups and conditions

def lookup(key: Column, entries: dict[str, str], default: str | None = None) -> Column:
    """The entry of a small constant table; null or the default for a key that is not in it."""
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    found = F.try_element_at(table, F.coalesce(key, F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def classify_prefix(text: Column, prefixes: list[tuple[str, str]]) -> Column:
    """Label of the first prefix that the text starts with, else null; no boundary is asked for."""
    out = F.lit(None).cast("string")
    for prefix, label in reversed(prefixes):
        out = F.when(text.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def open_flag(value: Column, fallback: bool) -> Column:
    """``open`` is true, ``closed`` is false, anything else the fallback."""
    return F.when(value == "open", True).when(value == "closed", False).otherwise(F.lit(fallback))


def toggled(flag: Column) -> Column:
    """The other of true and false; null stays."""
    return ~flag


def contains(items: Column, item) -> Column:
    """Two-valued membership: false where the array is null or only holds nulls besides."""
    return F.coalesce(F.array_contains(items, item), F.lit(False))


def append_distinct(items: Column, item) -> Column:
    """Append unless present; order stays."""
    return F.when(contains(items, item), items).otherwise(F.array_append(items, item))


def remove_at(items: Column, place: int) -> Column:
    """The array without the element at a place (from 0)."""
    return F.filter(items, lambda x, i: i != place)


# ------------------------------------------------------------------ money

def convert(amount_eur: Column, currency: str) -> Column:
    """EUR to a currency in decimal, rounded half up to cents.  An unknown currency is an error."""
    if currency not in RATES:
        raise ValueError(f"unknown currency: {currency}")
    return F.round(amount_eur.cast(MONEY) * F.lit(RATES[currency]), 2).cast(MONEY)


def format_money(amount_eur: Column, currency: str) -> Column:
    """``€26 900,00``, ``£23,134.00`` or ``$29,321.00``."""
    text = F.format_number(convert(amount_eur, currency), 2)
    if currency == "EUR":
        text = F.translate(text, ",.", " ,")
    return F.concat(F.lit(SYMBOLS[currency]), text)


def parse_eur(text: Column) -> Column:
    """``€14 880``, ``€2 960,00`` and ``€6.2m`` as a decimal; null for other texts."""
    bare = F.regexp_replace(plain_spaces(text), r"[€ ]", "")
    millions = F.regexp_extract(bare, r"^([0-9.]+)m$", 1)
    plain = F.when(bare.rlike(r"^-?[0-9]+(,[0-9]+)?$"), F.translate(bare, ",", "."))
    scaled = F.when(millions != "", millions.try_cast("decimal(18,6)") * F.lit(1_000_000))
    return F.coalesce(scaled.cast(MONEY), plain.try_cast(MONEY))
