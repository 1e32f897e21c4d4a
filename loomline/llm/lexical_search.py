"""Ranked lexical search: a hierarchical max tree over document ranges for each term, searched best first.

1. Index.  A task turns its documents into rows of the index: document lengths, and for each document
   the item terms in it with their occurrences.  The row also counts what the corpus statistics need
   (documents, terms, documents of each term); they are summed before anything is scored.
2. Trees.  A task joins index rows to ranges of SHARD documents.  What a term adds to a document's
   score without its weight is an integer, its impact; a range of LEAF documents holds for each term
   the largest impact in it, FANOUT ranges make one of the next level, and so on up to the shard.
3. Search.  For an item, a node's bound is the sum over its terms of weight times largest impact.  The
   node of the highest bound is opened first: into its children, or at a leaf into its documents with
   their exact scores.  It ends when no bound reaches the k-th best score so far; nodes whose bound
   equals it are opened, as a smaller id in them would win the tie.  The best of earlier shards of
   the task stay the standard for the later ones.
4. The k best of each task meet in two rounds of ranks, the first by item and a salt.

Scores are sums of integers below 2^53, so the float64 products that give them are exact.

Bounds: item texts are taken ITEM_BYTES at a time (each pass reads the documents once), so terms and
items that a task holds are bounded; a shard's tree is built for TERMS terms at a time.

Defined cases: null, empty or termless documents are not counted and never found; a null or termless
item finds nothing; very long texts are split into pieces of CHUNK_BYTES as they are read; rows that
repeat an item are items of their own, rows that repeat a document are documents of their own; equal
scores rank by rising id, a null id last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_slices, table

#: Documents of a leaf, children of a node, documents of a shard; terms that a shard's tree holds at a time.
LEAF, FANOUT, SHARD, TERMS = 32, 8, 16384, 4096
#: Documents and entries of one row of the index.
ROW_DOCS, ROW_ENTRIES = 2048, 262_144
#: Bytes of item texts whose terms are looked for in one pass; bytes of text that are split into words at a time.
ITEM_BYTES, CHUNK_BYTES = 2 << 20, 1 << 20
#: Parts into which the first round of ranks deals an item's candidates.
SALTS = 64

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes):
    """Lists of the terms of a text, of about CHUNK_BYTES each."""
    text = text.translate(_NORMAL)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of an item, in order."""
    return sorted({w for p in pieces((text or "").encode()) for w in p})


# ---------------------------------------------------------------- index

_INDEX = "ids binary, known binary, lengths binary, entries binary, terms binary, counts binary, n_docs long, n_terms long, df array<struct<term:int,docs:long>>"


def _index(numbers: dict[bytes, int]):
    """(id, text) rows to rows of the index."""

    def run(batches):
        held, n_entries, n_docs, n_terms = [], 0, 0, 0  # held: (id, length, terms, counts)

        def row():
            ids = [h[0] for h in held]
            terms = np.concatenate([h[2] for h in held]) if held else np.zeros(0, np.int32)
            found, docs = np.unique(terms, return_counts=True)
            columns = [
                np.array([0 if x is None else x for x in ids], np.int64), np.array([x is not None for x in ids]),
                np.array([h[1] for h in held], np.int64), np.array([len(h[2]) for h in held], np.int32), terms,
                np.concatenate([h[3] for h in held]) if held else np.zeros(0, np.int64),
            ]
            df = pa.array([[{"term": t, "docs": d} for t, d in zip(found.tolist(), docs.tolist())]], pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.int64())])))
            return pa.RecordBatch.from_arrays(
                [*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([n_docs]), pa.array([n_terms]), df],
                names=["ids", "known", "lengths", "entries", "terms", "counts", "n_docs", "n_terms", "df"],
            )

        for batch in batches:
            for part, texts in in_slices(batch, 1, CHUNK_BYTES):
                for doc, text in zip(part.column(0).to_pylist(), texts):
                    n, found = 0, []
                    for words in pieces(text):
                        n += len(words)
                        found.append(np.fromiter((x for x in map(numbers.get, words) if x is not None), np.int32))
                    if not n:
                        continue
                    n_docs, n_terms = n_docs + 1, n_terms + n
                    terms, counts = np.unique(np.concatenate(found), return_counts=True)
                    if len(terms):
                        held.append((doc, n, terms, counts.astype(np.int64)))
                        n_entries += len(terms)
                    if len(held) >= ROW_DOCS or n_entries >= ROW_ENTRIES:
                        yield row()
                        held, n_entries, n_docs, n_terms = [], 0, 0, 0
        if n_docs:
            yield row()

    return run


# ---------------------------------------------------------------- trees and search

class Items:
    """A block of items: for each its terms and their weights, and groups of items of at most ``most`` terms (an item of more is a group)."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray, most: int = TERMS):
        self.terms, self.weights = terms, weights
        self.groups, held, own = [], set(), []
        for i, t in enumerate(terms):
            if not len(t):
                continue
            more = held | set(t.tolist())
            if own and len(more) > most:
                self.groups.append((np.array(sorted(held), np.int64), own))
                more, own = set(t.tolist()), []
            held = more
            own.append(i)
        if own:
            self.groups.append((np.array(sorted(held), np.int64), own))


def norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length part of a document's score, in whole numbers."""
    wide = lengths.astype(object) if 50 * int(lengths.max(initial=0)) * n_docs >= 1 << 62 else lengths
    return 50 + ((50 * wide * n_docs) // n_terms).astype(np.int64)


class Tree:
    """A shard's documents (entries: each one's number of terms) and, level by level, the largest impacts of the terms."""

    def __init__(self, entries: np.ndarray, terms: np.ndarray, impact: np.ndarray, wanted: np.ndarray):
        place = np.searchsorted(wanted, terms)
        here = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == terms)
        doc = np.repeat(np.arange(len(entries)), entries)[here]
        self.term, self.impact, self.doc = place[here], impact[here].astype(np.float64), doc
        self.first = np.searchsorted(doc, np.arange(0, len(entries) + LEAF, LEAF))
        level = np.zeros((-(-len(entries) // LEAF), len(wanted)))
        np.maximum.at(level, (doc // LEAF, self.term), self.impact)
        self.levels = [level]
        while len(level) > FANOUT:
            level = np.maximum.reduceat(level, np.arange(0, len(level), FANOUT), axis=0)
            self.levels.append(level)

    def search(self, columns: np.ndarray, weights: np.ndarray, best: list, k: int, ids: list) -> None:
        """Let the documents into ``best``, a heap of the k best (score, id is known, -id)."""
        dense = np.zeros(self.levels[0].shape[1])
        dense[columns] = weights
        least = best[0][0] if len(best) == k else 1
        top = len(self.levels) - 1
        bounds = self.levels[top][:, columns] @ weights
        queue = [(-b, top, node) for node, b in enumerate(bounds.tolist()) if b >= least]
        heapq.heapify(queue)
        while queue and -queue[0][0] >= least:
            _, level, node = heapq.heappop(queue)
            if level:
                children = slice(node * FANOUT, (node + 1) * FANOUT)
                bounds = self.levels[level - 1][children][:, columns] @ weights
                for i, b in enumerate(bounds.tolist()):
                    if b >= least:
                        heapq.heappush(queue, (-b, level - 1, node * FANOUT + i))
                continue
            a, b = self.first[node], self.first[node + 1]
            scores = np.bincount(self.doc[a:b] - node * LEAF, dense[self.term[a:b]] * self.impact[a:b], LEAF)
            for i in np.flatnonzero(scores >= least).tolist():
                doc = ids[node * LEAF + i]
                one = (int(scores[i]), doc is not None, -(doc or 0))
                if len(best) < k:
                    heapq.heappush(best, one)
                else:
                    heapq.heappushpop(best, one)
            if len(best) == k:
                least = best[0][0]


def _shards(batches):
    """Rows of the index joined to shards: ids, lengths, entries, terms, counts."""
    kinds = (np.int64, np.bool_, np.int64, np.int32, np.int32, np.int64)
    held, docs = [], 0

    def shard():
        ids, known, *rest = (np.concatenate(c) for c in zip(*held))
        return [x if k else None for x, k in zip(ids.tolist(), known.tolist())], *rest

    for batch in batches:
        for i in range(batch.num_rows):
            row = [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in enumerate(kinds)]
            held.append([x.copy() for x in row])
            docs += len(row[0])
            if docs >= SHARD:
                yield shard()
                held, docs = [], 0
    if docs:
        yield shard()


def _best(shared, n_docs: int, n_terms: int, k: int):
    def run(batches):
        items: Items = shared.value
        best: list[list] = [[] for _ in items.terms]
        for ids, lengths, entries, terms, counts in _shards(batches):
            m = np.repeat(norm(lengths, n_docs, n_terms), entries)
            impact = (1_000_000_000 * counts) // (1000 * counts + 20 * m)
            for wanted, own in items.groups:
                tree = Tree(entries, terms, impact, wanted)
                for i in own:
                    columns = np.searchsorted(wanted, items.terms[i])
                    tree.search(columns, items.weights[items.terms[i]], best[i], k, ids)
        for lo in range(0, len(best), 1000):
            found = [(i, -x[2] if x[1] else None, x[0]) for i, own in enumerate(best[lo : lo + 1000], lo) for x in own]
            if found:
                columns = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, items: list[list[bytes]], k: int, scratch: Scratch, name: str) -> DataFrame:
    """item (its place in ``items``), doc_id, score of the k best documents of every task."""
    spark = docs.sparkSession
    words = sorted({w for own in items for w in own})
    numbers = {w: i for i, w in enumerate(words)}
    shared_numbers = spark.sparkContext.broadcast(numbers)
    index = scratch.write(docs.mapInArrow(lambda batches: _index(shared_numbers.value)(batches), _INDEX), f"index{name}")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    # at most a row for each term of the block of items
    for term, n in index.select(F.inline("df")).groupBy("term").agg(F.sum("docs")).collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.float64)
    terms = [np.array([numbers[w] for w in own], np.int64) for own in items]
    shared = spark.sparkContext.broadcast(Items(terms, weights))
    rows = index.select("ids", "known", "lengths", "entries", "terms", "counts")
    found = rows.mapInArrow(_best(shared, n_docs, n_terms, k), "item long, doc_id long, score long")
    found = scratch.write(found, f"found{name}")
    scratch.remove(f"index{name}")
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """item_col, rank (from 1), id_col and score of the k documents that score highest for each item, above 0."""
    run = scratch or Scratch(docs.sparkSession, "search")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    own = items.select(items[item_col].alias("item_id"), F.coalesce(items[item_text].cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    if blocks > 1:
        own = run.write(own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    kind = own.schema["item_id"].dataType.simpleString()
    parts = []
    for b in range(blocks):
        block = [tuple(r) for r in (own.filter(F.col("block") == b) if blocks > 1 else own).select("item_id", "text").collect()]
        found = _search_block(texts, [terms_of(t) for _, t in block], k, run, str(b))
        named = docs.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item long, item_id {kind}")
        parts.append(found.withColumn("block", F.lit(b)).join(F.broadcast(named), "item"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    one = ("block", "item")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    for keys in ((*one, "salt"), one):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    out = salted.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")
    return out if scratch else run.settled(out)[0]


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
