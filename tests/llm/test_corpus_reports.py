"""Filter audit, source mixing and lexical search on odd tables, against plain restatements."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import filter_audit, lexical_search, source_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, part string, size long"


def odd_rows(n=120, seed=1):
    """Null and repeated ids, texts, parts and sources; one text a third of all rows; long texts; one hot source."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "l'été", "x", "d#", "naïve", "e"]) + str(rng.randrange(60))
    out = []
    for i in range(n):
        kind = rng.random()
        text = "the same text " * 40 if kind < 0.33 else None if kind < 0.4 else "" if kind < 0.43 else " ".join(word() for _ in range(rng.choice([1, 5, 99, 100, 101, 300])))
        out.append((rng.choice([None, i, i, i, i // 2]), text, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "é", "S", None, ""]), 0, 1, "p", 2))
    return [*out, (10**6, "word " * 50_000 + "end", "en", "s1", 0, 1, "p", 2)]


# ---------------------------------------------------------------- 11

def failing(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]
        out.append({letter for letter, x in zip("ABCDE", [*fails, d is not None and d > least[t]]) if x})
    return out


def test_audit(spark):
    rows = odd_rows()
    labels = [(d, q, t) for d in range(0, 120, 2) for q, t in ((d % 3 % 2, d % 5 == 0),)] + [(4, 1, True), (None, 1, True), (6, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    with filter_audit.Scratch(spark, "t") as run:
        masks = filter_audit.masks_of(docs, told, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, run)
        got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(masks, "ABCDE", ["good", "toxic"]).collect()}
        assert filter_audit.audit(masks.filter("false"), "ABCDE", ["good", "toxic"]).count() == 0
    fails = failing(rows)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t}
    parts = {r[2] or "" for r in rows}
    assert len(got) == len(parts) * 600
    for part in parts:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                shapley[letter] += sum(letter in f and not f & set(order[: step - 1]) for _, f in own)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                r, before = got[(part, "".join(order), step)], set(order[: step - 1])
                here = [(d, f) for d, f in own if letter in f and not f & before]
                assert (r["filter"], r["removed"], r["shapley"]) == (letter, len(here), shapley[letter])
                assert r["kept"] == sum(not f & (before | {letter}) for _, f in own)
                assert r["redundant"] == sum(letter in f and bool(f & before) for _, f in own) and r["unique_fails"] == sum(f == {letter} for _, f in own)
                assert r["good_lost"] == sum(d is not None and d in good for d, _ in here) and r["toxic_lost"] == sum(d is not None and d in toxic for d, _ in here)


def test_removal_polynomial():
    """Corners, and the integral of a partial derivative, against sums over all orders, for any number of filters."""
    rng = random.Random(4)
    for k in (1, 2, 3, 4):
        counts = [rng.randrange(9) for _ in range(1 << k)]
        p = filter_audit.removal_polynomial(counts)
        removed = [sum(c for m, c in enumerate(counts) if m & s) for s in range(1 << k)]
        assert filter_audit.corners(p) == removed
        for i in range(k):
            orders = list(permutations(range(k)))
            total = sum(removed[b | 1 << i] - removed[b] for o in orders for b in [sum(1 << j for j in o[: o.index(i)])])
            assert filter_audit.shapley(p, i) == Fraction(total, len(orders))


# ---------------------------------------------------------------- 12

def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Shares by weight, the excess over the cap shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        rest = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        out = {s: cap * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if out[s] > cap * sizes[s]}
        if not above:
            return out
        full |= above


@pytest.mark.parametrize("seed,weights,share", [(1, (3, 1, 2), 1.5), (2, (1, 50), 0.3), (3, (1,), 2.0)])
def test_mixing(spark, seed, weights, share):
    rows = odd_rows(400, seed)
    docs = spark.createDataFrame(rows, DOCS)
    got = source_mixing.mix(docs.repartition(5), weights, share).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = plain_targets(sizes, weights, share)
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    assert Counter((repr(r["doc_id"]), r["size"], r["source"]) for r in got) == Counter((repr(r[0]), words(r[1]), r[3]) for r in rows)
    for source, own in by_source.items():
        # the rates give the target, and are those of one tilt: the optimum of the dual
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(want[source], rel=1e-7)
        free = [r for r in own if r["size"] and 1e-12 < r["rate"] < 2 - 1e-9]
        tilts = [math.log(r["rate"]) / r["size"] for r in free]
        assert not tilts or max(tilts) - min(tilts) < 1e-6
        if tilts:
            assert all(min(2, math.exp(np.mean(tilts) * r["size"])) == pytest.approx(r["rate"], abs=1e-6) for r in own if r["size"])
        # whole copies come as near as the smallest document that could be added or taken
        rest = want[source] - sum(r["taken"] for r in own)
        can = [r["size"] for r in own if r["size"] and (r["copies"] < 2 if rest > 0 else r["copies"] > 0)]
        assert abs(rest) <= max(can, default=0) / 2 + 1e-6 or abs(rest) <= min(abs(abs(rest) - s) for s in can) + 1e-6
    again = source_mixing.mix(docs.repartition(2).orderBy(F.rand(3)), weights, share).collect()
    told = lambda rows_: Counter((repr(r["doc_id"]), r["size"], r["source"], r["taken"], r["rate"]) for r in rows_)
    assert told(got) == told(again)


def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    assert source_mixing.mix(docs.filter("false")).count() == 0
    got = source_mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(got) == 121 and {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}


def test_mixing_is_native(spark):
    df = source_mixing.mix(spark.createDataFrame(odd_rows(), DOCS), scratch=source_mixing.Scratch(spark, "native"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- 13

def plain_search(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank, None if lost else d, -s) for rank, (s, lost, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("leaf,fanout,shard,terms,rows,block", [(32, 8, 16384, 4096, 2048, 2 << 20), (2, 2, 24, 10, 5, 2 << 20), (1, 3, 7, 1, 3, 60)])
def test_search(spark, monkeypatch, leaf, fanout, shard, terms, rows, block):
    for name, value in (("LEAF", leaf), ("FANOUT", fanout), ("SHARD", shard), ("TERMS", terms), ("ROW_DOCS", rows), ("ITEM_BYTES", block)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = [(r[0], r[1]) for r in odd_rows(300, 6)] + [(2000 + i, "tie tie tie") for i in range(70)] + [(None, "tie tie tie"), (None, "Alpha1 beta2")]
    items = [(1, "alpha1 ALPHA2 beta3-x4, naïve5"), (2, "tie"), (3, None), (4, " .. "), (5, "nowhere"), (6, "end the SAME text"), (7, "alpha1"), (None, "beta7 d3"), (8, "tie")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("item", F.lit(1)).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    for k in (50, 3):
        got = [tuple(r) for r in lexical_search.search(df, asked, k).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, plain_search(docs, items, k)))


def test_search_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(df.filter("false"), items).count() == 0
    assert lexical_search.search(df.filter("text is null"), items).count() == 0
    assert lexical_search.search(df, items.filter("false")).count() == 0


def test_search_prunes():
    """The bounds leave most leaves closed where few documents score high; ties are opened."""
    rng = np.random.default_rng(5)
    n = 4096
    entries = np.full(n, 2, np.int32)
    terms = np.stack([np.zeros(n, np.int32), rng.integers(1, 200, n).astype(np.int32)], 1)
    impact = np.stack([rng.integers(1, 1000, n), rng.integers(1, 1000, n)], 1)
    impact[[7, 3000, 4000], 0] = 900_000
    tree = lexical_search.Tree(entries, terms.ravel(), impact.ravel(), np.arange(200))
    opened = []
    tree.first = tree.first.view(_Counted)
    tree.first.opened = opened
    best = []
    tree.search(np.array([0]), np.array([10.0]), best, 3, list(range(n)))
    assert sorted(-x[2] for x in best) == [7, 3000, 4000] and {x[0] for x in best} == {9_000_000}
    assert len({int(x) for x in opened}) <= 8


class _Counted(np.ndarray):
    def __getitem__(self, i):
        self.opened.append(i)
        return super().__getitem__(i)


def test_long_norms():
    lengths = np.array([1, 10**6, 3 * 10**9], np.int64)
    n_docs, n_terms = 10**12, 5 * 10**14
    assert lexical_search.norm(lengths, n_docs, n_terms).tolist() == [50 + 50 * int(x) * n_docs // n_terms for x in lengths.tolist()]
