"""Filter interaction audit: what each filter removes in every order of a chain, and its Shapley share.

Each document becomes a mask of the filters that it fails, and each part of the corpus the counts of
its masks (at most 2^filters).  Those counts are one polynomial a part, the multilinear extension of
"removed by a set of filters": a document of mask M contributes 1 - prod over i in M of (1 - x_i).
Its value at a corner of the cube is what that set of filters removes, so corners give the survivors
of every prefix of every order.  A filter's Shapley value is the integral of its partial derivative
along the diagonal, in exact rationals; times the number of orders it is the sum over all of them.
The same polynomial over the documents of an outcome (good, toxic) gives what is lost of them.

Texts are read once, natively; Python sees only the masks' counts, one row a part.

Defined cases: a null text is empty (it fails the filter for short texts, and may repeat another);
very long texts are rows like others; a null part is the part of the empty string; a row with a null
id repeats no text and is repeated by none; rows that repeat an id are documents of their own and do
not repeat each other; an id labelled several times has an outcome if one label says so; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_with_hot, table

WORD = r"[^\x20\x09-\x0D]+"
#: Failure conditions over ``text``, in the order of their letters from A; the one after them is E, a repeated text.
FILTERS = ("few words", "repeated words", "capitals", "marks")


def failures(text: Column) -> list[Column]:
    """Of each of FILTERS, whether the text fails it."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    return [n < 100, 100 * kinds < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


# ---------------------------------------------------------------- the polynomial of a part

def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients, by set of variables, of the sum over masks M of count * (1 - prod over M of (1 - x_i))."""
    over = list(counts)  # of each set: the documents whose mask holds it
    for bit in _bits(len(counts)):
        for s in range(len(over)):
            if not s & bit:
                over[s] += over[s | bit]
    return [0, *(n if s.bit_count() % 2 else -n for s, n in enumerate(over[1:], 1))]


def corners(polynomial: list[int]) -> list[int]:
    """Its value at every corner: the documents that each set of filters removes."""
    out = list(polynomial)
    for bit in _bits(len(out)):
        for s in range(len(out)):
            if s & bit:
                out[s] += out[s ^ bit]
    return out


def shapley(polynomial: list[int], which: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative for variable ``which`` on the diagonal (t, ..., t)."""
    along: dict[int, int] = {}  # power of t: coefficient
    for s, c in enumerate(polynomial):
        if s >> which & 1:
            along[s.bit_count() - 1] = along.get(s.bit_count() - 1, 0) + c
    return sum((Fraction(c, power + 1) for power, c in along.items()), Fraction(0))


def _bits(size: int) -> list[int]:
    return [1 << i for i in range(size.bit_length() - 1)]


def orders_of(letters: str, total: list[int], outcomes: list[list[int]]):
    """A tuple for every order and step: order, step, filter, kept, removed, redundant, unique, lost of each outcome, Shapley sum.

    total and outcomes: documents, and those of each outcome, by mask.
    """
    k, everything = len(letters), sum(total)
    polynomial = removal_polynomial(total)
    removed, *lost = map(corners, (polynomial, *map(removal_polynomial, outcomes)))
    every = (1 << k) - 1
    unique = [removed[every] - removed[every ^ 1 << i] for i in range(k)]
    shares = [shapley(polynomial, i) * factorial(k) for i in range(k)]
    assert all(x.denominator == 1 for x in shares)
    for order in permutations(range(k)):
        before, name = 0, "".join(letters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            yield (
                name, step, letters[i], everything - removed[after], here, removed[1 << i] - here, unique[i],
                *(x[after] - x[before] for x in lost), int(shares[i]),
            )
            before = after


# ---------------------------------------------------------------- the audit

def audit(masks: DataFrame, letters: str, outcomes: list[str]) -> DataFrame:
    """All orders of the filters for each part, from counts (part, mask, n and a count for each of the outcomes).

    At most 2^filters rows of a part meet, whatever the size of the corpus.
    """
    sums = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(o).alias(o) for o in outcomes])
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *outcomes)).alias("held"))
    kinds = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, "
    kinds += "".join(f"{o}_lost long, " for o in outcomes) + "shapley long"

    def run(batches):
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by = [[0] * (1 << len(letters)) for _ in ("n", *outcomes)]
                for row in held:
                    for counts, name in zip(by, ("n", *outcomes)):
                        counts[row["mask"]] += row[name]
                rows = list(orders_of(letters, by[0], by[1:]))
                types = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * (len(rows[0]) - 3)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *columns], names=names)

    names = [x.split()[0] for x in kinds.split(", ")]
    return parts.mapInArrow(run, kinds)


def masks_of(docs: DataFrame, labels: DataFrame, outcomes: dict[str, Column], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n and counts of the outcomes (conditions over ``labels``), for the five filters A to E."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col("text")))), F.lit(0))
    rows = scratch.write(own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("told"), mask.alias("mask")), "masks")
    # texts that occur once repeat none
    texts = rows.groupBy("told").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).filter("copies > 1")
    repeats = F.when(F.col("id") > F.col("least"), 1 << len(FILTERS)).otherwise(0)
    whole = join_with_hot(rows, texts, "told", F.col("copies"), rows.count()).select("id", "part", (F.col("mask") + repeats).alias("mask"))
    # rows that share an id, null included, are counted before they meet their labels
    counted = whole.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy(labels[id_col].alias("id")).agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in outcomes.items()])
    joined = counted.join(said, "id", "left")
    return joined.select("part", "mask", "n", *[(F.col("n") * F.coalesce(name, F.lit(0))).alias(name) for name in outcomes])


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "audit")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    masks = masks_of(docs, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, scratch)
    return scratch.settled(audit(masks, "ABCDE", ["good", "toxic"]))[0]
