"""Byte-level BPE encoding in padded matrices, and decoding.

Pre-tokens not met before are put in matrices of rows of like length, one id a byte, padded.  Each
round looks up the rank of every adjacent pair in a hashed table, merges the leftmost pair of
minimum rank in every row, and closes the gap; rows without a ranked pair leave the matrix.  Only
the two pairs that a merge changes are looked up again.

Rounds grow with a row's length, so a pre-token of more than WIDE bytes is cut into rows of SEGMENT
bytes.  Ids side by side are those of the whole exactly if each two neighbours are what their own
bytes are encoded to: the first merge across a border would be one of these two as well.  So the
neighbours at each cut are encoded as a row; where that gives other ids, a window around the cut is,
wider each round, until all its neighbours agree.

Defined cases: a null or empty text has no ids and decodes to no bytes; very long texts and very long
pre-tokens are encoded whole; repeated rows are encoded each; an empty table gives no rows; other columns stay (but for those named as the results).
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_slices, table

#: Bytes beyond which a pre-token is cut into rows, and the bytes of these.
WIDE, SEGMENT = 256, 64
#: Pre-tokens remembered by a worker, and characters of text encoded at a time.
REMEMBERED = 200_000
CHUNK_CHARS = 1 << 20
_NONE = np.int32(0x7FFFFFFF)


class PairTable:
    """(left id, right id) -> id of their concatenation (which is its rank), in an open hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (a, b, r) for t, r in ranks.items() for i in range(1, len(t))
            if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None
        ]
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        keys = left << 32 | right
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] < 0
            slots, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.values[slots] = keys[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = at[todo] + 1 & size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], _NONE)
        miss = np.flatnonzero((held != keys) & (held >= 0) & (right >= 0) & (left >= 0))
        for _ in range(self.probes - 1):
            if not len(miss):
                break
            at[miss] = at[miss] + 1 & len(self.keys) - 1
            held = self.keys[at[miss]]
            same = held == keys[miss]
            out[miss[same]] = self.values[at[miss[same]]]
            miss = miss[~same & (held >= 0)]
        return out


class Encoder(dict):
    """pre-token -> its ids (int32 bytes), for a file of ranks in tiktoken's format."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: b"%d" % r for r in self.bytes_of}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = PairTable(self.ranks)
        self.split = regex.compile(pattern).findall
        self.remembered = remembered

    def learn(self, words: set[str]) -> None:
        """Encode pre-tokens and remember them."""
        raw = {w: w.encode() for w in words}
        ids = self.rows({r for r in raw.values() if len(r) <= WIDE}) | self.segmented({r for r in raw.values() if len(r) > WIDE})
        for w, r in raw.items():
            self[w] = ids[r].tobytes()

    def rows(self, texts: set[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of each text, matrix by matrix."""
        by_width: dict[int, list] = {}
        for raw in texts:
            by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(raw)
        out: dict[bytes, np.ndarray] = {}
        for width, held in by_width.items():
            step = max(1, (1 << 18) // width)
            for i in range(0, len(held), step):
                self._matrix(held[i : i + step], width, out)
        return out

    def segmented(self, texts: set[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of long texts, encoded in segments and mended at the cuts."""
        cut = {t: [t[i : i + SEGMENT] for i in range(0, len(t), SEGMENT)] for t in texts}
        known = self.rows({p for parts in cut.values() for p in parts})
        ids = {t: np.concatenate([known[p] for p in parts]) for t, parts in cut.items()}
        open_cuts = {t: np.cumsum([len(known[p]) for p in parts])[:-1].tolist() for t, parts in cut.items()}
        agreed: set[tuple[int, int]] = set()
        reach = 1
        while any(open_cuts.values()):
            met = {(int(ids[t][c - 1]), int(ids[t][c])) for t, cuts in open_cuts.items() for c in cuts} - agreed
            told = self.rows({self.bytes_of[a] + self.bytes_of[b] for a, b in met})
            agreed |= {(a, b) for a, b in met if told[self.bytes_of[a] + self.bytes_of[b]].tolist() == [a, b]}
            windows: dict[bytes, list[tuple[int, int]]] = {}
            for t, cuts in open_cuts.items():
                now, end, rest = ids[t], 0, []
                own = windows[t] = []
                for c in cuts:
                    if (int(now[c - 1]), int(now[c])) in agreed:
                        continue
                    lo, hi = max(0, c - reach), min(len(now), c + reach)
                    if lo < end:  # in the window before, or overlapping it: the next round sees
                        rest += [c] if c >= end else []
                        continue
                    own.append((lo, hi))
                    end = hi
                open_cuts[t] = rest
            raw = lambda t, lo, hi: b"".join(map(self.bytes_of.__getitem__, ids[t][lo:hi].tolist()))
            again = {t: [raw(t, lo, hi) for lo, hi in own] for t, own in windows.items()}
            known = self.rows({r for own in again.values() for r in own})
            for t, own in windows.items():
                parts, cuts, at, n, rest = [], [], 0, 0, iter([*open_cuts[t], len(ids[t]) + 1])
                later = next(rest)
                for (lo, hi), r in zip([*own, (len(ids[t]), len(ids[t]))], [*again[t], b""]):
                    while later < lo:
                        cuts.append(n + later - at)
                        later = next(rest)
                    while later < hi:
                        later = next(rest)
                    n += lo - at
                    parts.append(ids[t][at:lo])
                    if r:
                        cuts += [n] if lo else []
                        parts.append(known[r])
                        n += len(known[r])
                        cuts += [n] if hi < len(ids[t]) else []
                    at = hi
                ids[t], open_cuts[t] = np.concatenate(parts), sorted(set(cuts))
            reach *= 2
        return ids

    def _matrix(self, held: list[bytes], width: int, out: dict[bytes, np.ndarray]) -> None:
        lengths = np.array([len(raw) for raw in held])
        flat = self.byte_ids[np.frombuffer(b"".join(held), dtype=np.uint8)]
        ids = np.full((len(held), width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        rank = np.full((len(held), width), _NONE, dtype=np.int32)
        r = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(held), width - 1)
        rank[:, :-1] = np.where(ids[:, 1:] >= 0, r, _NONE)
        rows = np.arange(len(held))
        columns = np.arange(width)
        while len(rows):
            at = rank.argmin(axis=1)  # the first of the least: the leftmost
            live = rank[np.arange(len(rows)), at] < _NONE
            if not live.all():
                for r, row, n in zip(rows[~live].tolist(), ids[~live], lengths[~live].tolist()):
                    out[held[r]] = row[:n].copy()
                rows, ids, rank, lengths, at = rows[live], ids[live], rank[live], lengths[live], at[live]
                if not len(rows):
                    break
                most = max(2, int(lengths.max()))
                if most <= ids.shape[1] // 2 or most < ids.shape[1] - 8:
                    ids, rank, columns = ids[:, :most], rank[:, :most], columns[:most]
            n = np.arange(len(rows))
            merged = rank[n, at]
            take = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[n, at] = merged
            lengths = lengths - 1
            ids[n, lengths] = -1
            rank[n, np.maximum(lengths - 1, 0)] = _NONE
            # the pairs to the right and to the left of the merged one
            has = at + 1 < lengths
            rank[n[has], at[has]] = self.pairs.rank(merged[has], ids[n[has], at[has] + 1])
            has = at > 0
            rank[n[has], at[has] - 1] = self.pairs.rank(ids[n[has], at[has] - 1], merged[has])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts are taken in chunks so that matrices are filled well."""
        out: list[np.ndarray] = []
        pending, size = [], 0
        for i, t in enumerate(texts):
            pending.append(self.split(t))
            size += len(t)
            if size >= CHUNK_CHARS or i == len(texts) - 1:
                if len(self) > self.remembered:
                    self.clear()
                new = {w for words in pending for w in words if w not in self}
                if new:
                    self.learn(new)
                out += [np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.int32) for words in pending]
                pending, size = [], 0
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _in_tasks(docs: DataFrame, text_col: str, path: str, pattern: str, ddl: str, make) -> DataFrame:
    """``docs`` without the text, with the columns that ``make(encoder, texts)`` gives."""
    names = [x.split()[0] for x in ddl.split(",")]
    keep = [c for c in docs.columns if c not in (text_col, *names)]
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        for batch in batches:
            for part, raw in in_slices(batch, len(keep), 4 * CHUNK_CHARS):
                made = make(encoder(path, pattern), [t.decode() for t in raw])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *names])

    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "_text"))).mapInArrow(run, own + ddl)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` in place of the text."""

    return _in_tasks(docs, text_col, path, pattern, "ids array<int>", lambda enc, texts: [_id_lists(enc.encode(texts))])


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """n_tokens, the digest of the ids, and the digest of the bytes that the ids decode to (and the ids)."""

    def make(enc, texts):
        n, a, b = [], [], []
        for ids in (encoded := enc.encode(texts)):
            n.append(len(ids))
            a.append(hashlib.sha256(b",".join(map(enc.decimal.__getitem__, ids.tolist()))).hexdigest())
            b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *([_id_lists(encoded)] if with_ids else [])]

    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _in_tasks(docs, text_col, path, pattern, ddl, make)


def op6_bpe_matrix(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
