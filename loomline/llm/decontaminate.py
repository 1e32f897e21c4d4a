"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the test items (13 words; a shorter item is one window) become hashes in a set
that every task holds; the words of the training texts pass by as rolling window hashes; each
hit is verified word by word; hit documents or spans are removed.  Words are runs of letters and
digits after lower-casing A-Z.  The set is flat arrays, at most SET_BYTES for each byte of item
text and a megabyte besides, and is built from at most ITEM_BYTES of item texts at a time: beyond that the items are dealt
to groups (long ones in pieces that overlap by a window less a word); the texts are written once and read
once a group, and what the groups find in a row is put together by the row's number.

Defined cases: a null text has no words and is clean; a very long one is scanned whole, its words in memory; an item that is null or has no words never
hits; repeated rows are judged one by one; empty tables give no hits; other columns stay, whatever
their names: a kept column named as one of the results gets an underscore before it in ``scan``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, fresh, in_slices, table

WIDTH = 13
#: Bytes of item texts whose windows are broadcast at a time, and bytes of the set for one of them at most.
ITEM_BYTES, SET_BYTES = 8 << 20, 20
#: Item words whose hashes a task keeps.
FEW_WORDS = 200_000
#: Bytes of training texts whose words are held in memory at a time.
CHUNK_BYTES = 1 << 20

_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_IS_WORD = np.array([x != 32 for x in _NORMAL])
_BASE = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` values, by doubling (modulo 2**64)."""
    if len(h) < width:
        return h[:0]
    power, done, acc, step = 1, 0, None, h
    while True:
        if width & power:
            if acc is None:
                acc, done = step, power
            else:
                n = len(h) - (done + power) + 1
                acc = acc[:n] * np.uint64(pow(_BASE, power, 1 << 64)) + step[done : done + n]
                done += power
        power *= 2
        if power > width:
            return acc[: len(h) - width + 1]
        half = power // 2
        n = len(h) - power + 1
        step = step[:n] * np.uint64(pow(_BASE, half, 1 << 64)) + step[half : half + n]


class WindowSet:
    """The windows of the items, by hash; built on the driver from a bounded group of items.

    blob: the items' words, one space apart; begins: where each word begins in it (and its end).  For
    each length of windows: a filter by leading bits, the sorted hashes, and first words and items of the windows.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        texts = [(item, words_of((text or "").encode())) for item, text in items]
        texts = [(item, words) for item, words in texts if item is not None and words]
        self.items = [str(item) for item, _ in texts]
        flat = [w for _, words in texts for w in words]
        self.blob = b" ".join(flat)
        self.begins = np.cumsum([0, *(len(w) + 1 for w in flat)]).astype(np.int32)
        values = WordHashes().of(flat)
        counts = np.array([len(words) for _, words in texts], np.int64)
        starts = np.cumsum(counts) - counts
        self.by_length = {}
        for n in sorted({min(width, c) for c in counts.tolist()}):
            own = np.flatnonzero(np.minimum(counts, width) == n)
            first = np.concatenate([np.arange(starts[i], starts[i] + counts[i] - n + 1) for i in own])
            item = np.repeat(own, counts[own] - n + 1)
            h = _rolling(values, n)[first]
            order = np.lexsort((item, h))
            h, first, item = h[order], first[order].astype(np.int32), item[order].astype(np.int32)
            bits = max(16, math.ceil(math.log2(len(h) * 8 + 1)))
            mask = np.zeros(1 << bits, dtype=bool)
            mask[h >> np.uint64(64 - bits)] = True
            self.by_length[n] = (bits, mask, h, first, item)

    @property
    def nbytes(self) -> int:
        return len(self.blob) + self.begins.nbytes + sum(a.nbytes for held in self.by_length.values() for a in held[1:])

    def hits(self, words: list[bytes], values: np.ndarray) -> list[tuple[int, int, list]]:
        """(start, length, items) of every window of the items that occurs among the words (with their hashes)."""
        out = []
        for n, (bits, mask, exact, first, item) in self.by_length.items():
            h = _rolling(values, n)
            at = np.flatnonzero(mask[h >> np.uint64(64 - bits)])
            lo, hi = (np.searchsorted(exact, h[at], side=s) for s in ("left", "right"))
            some = np.flatnonzero(lo < hi)
            for i, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                text = b" ".join(words[i : i + n])
                found = {
                    self.items[k] for w, k in zip(first[a:b].tolist(), item[a:b].tolist())
                    if self.blob[self.begins[w] : self.begins[w + n] - 1] == text
                }
                if found:
                    out.append((i, n, found))
        return out


    def hashes(self) -> WordHashes:
        """Hashes of words for ``hits``: of few item words just theirs, else of all words as they come."""
        words = set(self.blob.split())
        return ItemWords(words) if len(words) <= FEW_WORDS else WordHashes()


class ItemWords(WordHashes):
    """The hashes of the items' words; other words, of which no window is, count as 0."""

    def __init__(self, words: set[bytes]):
        super().__init__()
        for w in words:
            self[w] = super().__missing__(w)

    def __missing__(self, word: bytes) -> int:
        return 0


def scan_texts(found_by: WindowSet, hashes: WordHashes, texts: list[bytes]):
    """n_words, hit word spans (merged, end exclusive) and sorted item ids as text, for each text of a slice."""
    counts, flat = [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        flat += w
        flat.append(b" ")  # no word: a window never spans two texts
    starts = np.cumsum([0, *(c + 1 for c in counts)])
    by_text: dict[int, list] = {}
    for i, n, items in found_by.hits(flat, hashes.of(flat)):
        by_text.setdefault(int(np.searchsorted(starts, i, side="right")) - 1, []).append((i, n, items))
    for k, c in enumerate(counts):
        own = by_text.get(k, ())
        begin = int(starts[k])
        yield c, _merge([(i - begin, i - begin + n) for i, n, _ in own]), sorted(set().union(*(items for _, _, items in own)))


_FOUND = ("n_words", "spans", "items")
_KINDS = "n_words long, spans array<array<long>>, items array<string>"


def _scan_group(rows: DataFrame, n_keep: int, at: int, items: list, width: int) -> DataFrame:
    """The first ``n_keep`` columns of the rows with n_words, spans and items."""
    held = WindowSet(items, width)
    shared = rows.sparkSession.sparkContext.broadcast(held)
    names = rows.columns[:n_keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_keep])

    def run(batches):
        hashes = shared.value.hashes()
        for batch in batches:
            for part, texts in in_slices(batch, at, CHUNK_BYTES):
                found = list(scan_texts(shared.value, hashes, texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:n_keep], pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int64()))), pa.array([f[2] for f in found], pa.list_(pa.string())),
                    ],
                    names=[*names, *_FOUND],
                )

    return rows.mapInArrow(run, f"{ddl}, {_KINDS}")


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(list, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def pieces_of(text: bytes, most: int, width: int) -> list[bytes]:
    """Texts of about ``most`` bytes whose windows together are those of ``text``."""
    words, out, begin = words_of(text), [], 0
    ends = np.cumsum([len(w) + 1 for w in words])
    while True:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 2 * width, int(np.searchsorted(ends, before + most, side="right")))
        out.append(b" ".join(words[begin:end]))
        if end >= len(words):
            return out
        begin = end - (width - 1)


def _split_long(items: DataFrame, most: int, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode()
                texts = [text] if len(raw) <= most else [p.decode() for p in pieces_of(raw, most, width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * len(texts))), pa.array(texts, pa.string())], names=["item", "text"]
                )

    return items.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, text string")


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``keep`` columns, n_words, hit word spans and items with occurring windows, for each row."""
    # by place, so that no name clashes
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].cast("string").alias("t"))
    found = _scan(plain, benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")), width)
    return found.select(*[F.col(f"c{i}").alias(f"_{c}" if c.lower() in _FOUND else c) for i, c in enumerate(keep)], *_FOUND)


def _scan(rows: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Rows whose last column is the text, with what is found in it."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / ITEM_BYTES))
    n = len(rows.columns)
    if groups == 1:
        return _scan_group(rows, n, n - 1, [tuple(r) for r in items.collect()], width)
    # texts are written once with a number for each row; a group reads them and writes the rows that it hits (the first one
    # all rows, without texts), and what the groups found is put together by number
    with Scratch(rows.sparkSession, "decontaminate") as scratch:
        items = scratch.write(_split_long(items, ITEM_BYTES // 8, width).withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(groups))), "items")
        number = fresh(rows, "row")
        told = scratch.write(rows.withColumn(number, F.monotonically_increasing_id()), "rows")
        found = None
        for g in range(groups):
            own = [tuple(r) for r in items.filter(F.col("part") == g).select("item", "text").collect()]
            hits = _scan_group(told.select(number, rows.columns[-1]), 1, 1, own, width)
            hits = scratch.write(hits.filter(F.size("spans") > 0) if g else hits, f"group{g}")
            found = hits if found is None else found.unionByName(hits)
        spans = F.array_sort(F.flatten(F.collect_list("spans")))  # by start, then by end
        whole = found.groupBy(number).agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        none = F.array().cast("array<array<bigint>>")

        def put(done, s):
            last = F.try_element_at(done, F.lit(-1))
            joins = (F.size(done) > 0) & (s[0] <= F.try_element_at(last, F.lit(2)))
            longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
            return F.when(joins, longer).otherwise(F.concat(done, F.array(s)))

        whole = whole.withColumn("spans", F.aggregate("spans", none, put)).withColumn("items", F.array_sort(F.array_distinct("items")))
        return scratch.settled(told.join(whole, number).select(*rows.columns, *_FOUND))[0]


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def contaminated():
    """The rule of the registered query: at least one word in twenty is hit."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))


def _by_place(docs: DataFrame, benchmark: DataFrame, text_col: str) -> tuple[DataFrame, list[str], str]:
    """All columns of ``docs`` by place with what is found in the text, their names, and the text's."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    return scan(docs.toDF(*names), benchmark, names, text), names, text


def drop_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The clean rows of ``docs``, all columns as they are."""
    found, names, _ = _by_place(docs, benchmark, text_col)
    return found.filter(~contaminated()).select(*names).toDF(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows of ``docs``; the hit words, and what stands between them, are cut from the text."""

    def cut(text: str | None, spans: list[list[int]]) -> str | None:
        if text is None or not len(spans):
            return text
        raw = text.encode()
        word = np.concatenate([[False], _IS_WORD[np.frombuffer(raw, dtype=np.uint8)], [False]]).astype(np.int8)
        edge = np.diff(word)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out, at = [], 0
        for a, b in spans:
            out.append(raw[at : begins[a]])
            at = ends[b - 1]
        return b"".join([*out, raw[at:]]).decode()

    def cut_all(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, s) for t, s in zip(texts, spans)], dtype=object)

    found, names, text = _by_place(docs, benchmark, text_col)
    return found.withColumn(text, F.pandas_udf(cut_all, "string")(text, "spans")).select(*names).toDF(*docs.columns)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return scan(docs, items, ["doc_id"]).select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )

