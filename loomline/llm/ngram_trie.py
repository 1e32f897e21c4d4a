"""N-gram language model scoring on Elias-Fano tries.

The model interpolates orders (Witten and Bell): p_k(w | h) = alpha(h w) + gamma(h) p_{k-1}(w | h'), with
alpha = c(hw) / (c(h) + T(h)) and gamma = T(h) / (c(h) + T(h)), T(h) being the number of different words
after h, down to add-one unigrams.  A history that training never met leaves p to the lower order.
Counts cover every training text and every history.

The model grows with the corpus, so it is never broadcast: it is dealt by the first word of the n-gram
into shards.  A first word of more than HOT_COUNT occurrences is dealt further by the second, so no shard
holds a whole frequent word.  Texts are kept as blocks of tokens in a bucketed table.

1. Words: a block asks for its distinct words; shards sum their training counts and number them, frequent
   words first.
2. N-grams: a block sends each shard its distinct n-grams there, as a tree of word numbers, with their
   counts in its training texts (0 in the others).  A shard sums the counts, builds its trie in one
   memory-mapped buffer, and looks all asked n-grams up in it.  The answers go back to the blocks.
   Where shards are many, asks go by way of regions of blocks that merge them.
3. Every token of a block gets its probability from the answers; texts get their sums.

A trie has a level for each order: the successors of each n-gram of the level above as a sequence made
monotone by the place of the n-gram before them (Elias-Fano), monotone pointers to where each n-gram's
successors begin (Elias-Fano), and quantised smoothed probabilities: alpha of the n-gram, gamma of it as a
history.  A lookup walks down the levels and searches for the word between two pointers, relative to the
history.  ``Trie.save`` and ``Trie.open`` keep a trie in a file that is mapped, not read.

``score`` learns and scores one table at once and keeps nothing.  ``learn`` keeps the shards' words and tries as
tables in a folder; its ``Model`` scores any table from them, in any later session, whatever executors are lost.
There a shard answers from what it keeps, and no n-gram is counted again.

Defined cases: a null or empty text is one end token; a very long one is scored whole, in a block of its own,
whose tokens (eight bytes each and a few arrays of as many) a task holds; with no training texts every count is 0;
repeated rows count again; a null id trains; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import mmap
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Given, Scratch, WordHashes, mix, table

#: A first word is dealt further beyond so many occurrences, or beyond this share of all tokens.
HOT_COUNT, HOT_SHARE = 500_000, 1e-6
#: Tokens in a block, and n-grams that a shard is meant to get.  A task holds up to 200 bytes for each: for those
#: of a block, or of a shard and a first word of just under HOT_COUNT occurrences.
BLOCK_TOKENS, SHARD_GRAMS = 600_000, 600_000
#: Buckets of the table of blocks (Spark allows 100,000); a bucket may hold many blocks, which are scored one by one.
MOST_BUCKETS = 50_000
#: Shards that a block asks directly.
FAN_OUT = 1024
#: Numbers below it are marks: the starts before a text, and what stands after it or for an unknown word.
FIRST_WORD = 16
#: The word that ends a text; no word of a text holds it.
END = b"\n"


# ---------------------------------------------------------------- Elias-Fano

class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, in one array of 64-bit words.

    words: n, bits of a low part, words of low parts, words of high parts; then these, and for
    every word of high parts the ones before it (two to a word).
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.n, self.low_bits, n_low, n_high = (int(x) for x in words[:4])
        self.low, self.high = words[4 : 4 + n_low], words[4 + n_low : 4 + n_low + n_high]
        self.ones = words[4 + n_low + n_high :].view(np.uint32)[: n_high + 1]
        self.mask = np.uint64((1 << self.low_bits) - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, int(math.floor(math.log2((top + 1) / n)))) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        n_high = (int(high[-1]) >> 6) + 1 if n else 0
        packed_high = _put(high, np.ones(n, np.uint64), n_high)
        low = values & np.uint64((1 << low_bits) - 1)
        n_low = (n * low_bits + 63) // 64 + 1
        packed_low = np.zeros(n_low, np.uint64)
        if low_bits and n:
            at = np.arange(n) * low_bits
            packed_low |= _put(at, low, n_low)
            over = (at & 63) + low_bits > 64
            packed_low |= _put((at[over] >> 6) + 1 << 6, low[over] >> (np.uint64(64) - (at[over] & 63).astype(np.uint64)), n_low)
        ones = np.zeros((n_high + 2) // 2 * 2, np.uint32)
        ones[1 : n_high + 1] = np.cumsum(np.bitwise_count(packed_high), dtype=np.uint32)
        return cls(np.concatenate([np.array([n, low_bits, n_low, n_high], np.uint64), packed_low, packed_high, ones.view(np.uint64)]))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        if 8 * len(i) > self.n:  # many: the high parts are unpacked in one go
            at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[i]
        else:
            word = np.searchsorted(self.ones, i, side="right") - 1
            at = (word << 6) + _select(self.high[word], (i - self.ones[word]).astype(np.uint64))
        out = (at - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = i * self.low_bits
            w, s = bit >> 6, (bit & 63).astype(np.uint64)
            low = self.low[w] >> s
            over = s + np.uint64(self.low_bits) > 64
            low[over] |= self.low[w[over] + 1] << (np.uint64(64) - s[over])
            out |= low & self.mask
        return out


def _put(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Words with ``values`` shifted to the bit places ``at`` (sorted; they do not overlap)."""
    out = np.zeros(n, np.uint64)
    if len(at):
        word = at >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(values << (at & 63).astype(np.uint64), first)
    return out


def _sorted_once(values: np.ndarray) -> np.ndarray:
    """The different values in order (``np.unique`` without places hashes them, which takes longer)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


#: Place of the k-th one of a byte.
_IN_BYTE = np.array([[*np.flatnonzero(b >> np.arange(8) & 1), *[0] * 8][:8] for b in range(256)], dtype=np.uint8)


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word: its byte by counting, then its place there."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.uint8)
    byte = (upto <= k[:, None].astype(np.uint8)).sum(axis=1)
    rows = np.arange(len(words))
    before = np.where(byte > 0, upto[rows, byte - 1], 0)
    return byte * 8 + _IN_BYTE[parts[rows, byte], k.astype(np.int64) - before]


# ---------------------------------------------------------------- probabilities

#: Probabilities are kept as 1 + their place on an even scale of log10 from LEAST to 0; 0: none.
LEVELS, LEAST = 65534, -12.0


def quantise(p: np.ndarray) -> np.ndarray:
    return (1 + np.rint((np.maximum(np.log10(p), LEAST) - LEAST) / -LEAST * LEVELS)).astype(np.uint16)


#: What each code stands for.
_RESTORED = np.concatenate([[0.0], 10 ** (LEAST - LEAST * np.arange(LEVELS + 1) / LEVELS)])


def restore(code: np.ndarray) -> np.ndarray:
    return _RESTORED[code]


# ---------------------------------------------------------------- a shard's trie

#: Words of 64 bits in a row of a stored trie.
PIECE_WORDS = 4 << 20


def _mapped(size: int) -> np.ndarray:
    """So many words of 64 bits of mapped memory."""
    return np.frombuffer(mmap.mmap(-1, max(8, 8 * size)), np.uint64)[:size]


class Level:
    """Nodes of one order: where the successors of each node above begin, the nodes, alpha and gamma codes."""

    def __init__(self, pointers: EliasFano, successors: EliasFano, alpha: np.ndarray, gamma: np.ndarray):
        self.pointers, self.successors, self.alpha, self.gamma = pointers, successors, alpha, gamma


class Trie:
    """Words (sorted numbers) and levels, all views of one array of 64-bit words."""

    def __init__(self, buffer: np.ndarray):
        """From such an array, which may be mapped memory or a mapped file."""
        self.buffer = buffer
        sizes = buffer[2 : 2 + int(buffer[0])].astype(np.int64)
        ends = np.cumsum(np.concatenate([[2 + len(sizes)], sizes]))
        parts = [buffer[a:b] for a, b in zip(ends[:-1], ends[1:])]
        words = EliasFano(parts[0])
        self.words, self.n_words = words.get(np.arange(words.n)).astype(np.int64), words.n  # one list for all levels
        self.levels = []
        for i in range(1, len(parts), 4):
            successors = EliasFano(parts[i + 1])
            self.levels.append(Level(EliasFano(parts[i]), successors, *(p.view(np.uint16)[: successors.n] for p in parts[i + 2 : i + 4])))

    @classmethod
    def build(cls, grams: list[np.ndarray], counts: np.ndarray, hot: np.ndarray) -> Trie:
        """From sorted different n-grams (a column of word numbers for each place) and their counts.

        Below the first words ``hot``, whose counts other shards hold too, alpha is the count in units of 10**LEAST.
        """
        words = _sorted_once(np.concatenate([_sorted_once(g) for g in grams]))
        parts = [EliasFano.of(words).words]
        n = len(counts)
        new = np.zeros(n, bool)
        above, n_above, above_counts = np.zeros(n, np.int64), 1, counts.sum(keepdims=True)
        alphas, gammas = [], []
        for k, column in enumerate(grams):
            rank = np.searchsorted(words, column)
            new = new | np.concatenate([[True], rank[1:] != rank[:-1]])[:n]
            node = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            parent, own = above[first], np.add.reduceat(counts, first) if n else counts
            kids = np.bincount(parent, minlength=n_above)
            if k:
                gammas[-1] = quantise(kids / (kids + above_counts)) if n_above and n else np.zeros(n_above, np.uint16)
                total = (above_counts + kids)[parent].astype(np.float64)
                if k == 1 and n:
                    total[np.isin(grams[0][first], hot)] = 10**-LEAST
                alphas.append(quantise(own / total) if n else np.zeros(0, np.uint16))
            else:
                alphas.append(np.zeros(len(first), np.uint16))
            pointers = np.concatenate([[0], np.cumsum(kids)])
            successors = parent.astype(np.uint64) * np.uint64(max(1, len(words))) + rank[first].astype(np.uint64)
            parts += [EliasFano.of(pointers).words, EliasFano.of(successors).words, None, None]
            gammas.append(np.zeros(len(first), np.uint16))
            above, n_above, above_counts = node, len(first), own
        for k, codes in enumerate(zip(alphas, gammas)):
            for j, c in enumerate(codes):
                padded = np.zeros((len(c) + 3) // 4 * 4, np.uint16)
                padded[: len(c)] = c
                parts[1 + 4 * k + 2 + j] = padded.view(np.uint64)
        head = np.array([len(parts), len(grams), *(len(p) for p in parts)], np.uint64)
        size = len(head) + sum(map(len, parts))
        buffer = _mapped(size)
        np.concatenate([head, *parts], out=buffer)
        return cls(buffer)

    def pieces(self) -> list[bytes]:
        """The trie as pieces that fit into rows of a table."""
        return [self.buffer[i : i + PIECE_WORDS].tobytes() for i in range(0, len(self.buffer), PIECE_WORDS)]

    @classmethod
    def of_pieces(cls, pieces: list[bytes]) -> Trie:
        buffer, at = _mapped(sum(map(len, pieces)) // 8), 0
        for piece in pieces:
            buffer[at : at + len(piece) // 8] = np.frombuffer(piece, np.uint64)
            at += len(piece) // 8
        return cls(buffer)

    @classmethod
    def without_grams(cls, order: int) -> Trie:
        return cls.build([np.zeros(0, np.int64)] * order, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def save(self, path: str) -> None:
        self.buffer.tofile(path)

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls(np.memmap(path, dtype=np.uint64, mode="r"))

    def ranks(self, numbers: np.ndarray) -> np.ndarray:
        """Places of word numbers among the trie's words; -1: not there."""
        if not self.n_words:
            return np.full(len(numbers), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, numbers), self.n_words - 1)
        return np.where(self.words[at] == numbers, at, -1)

    def children(self, k: int, parents: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Nodes of level k: the successors ``ranks`` of the nodes ``parents`` above; -1: none, as for -1 of either."""
        out = np.full(len(parents), -1, np.int64)
        at = np.flatnonzero((parents >= 0) & (ranks >= 0))
        level = self.levels[k]
        lo, hi = (level.pointers.get(parents[at] + i).astype(np.int64) for i in (0, 1))
        out[at] = self._search(level.successors, lo, hi, parents[at].astype(np.uint64) * np.uint64(self.n_words) + ranks[at].astype(np.uint64))
        return out

    @staticmethod
    def _search(held: EliasFano, lo: np.ndarray, hi: np.ndarray, sought: np.ndarray) -> np.ndarray:
        """Places of the values between lo and hi of the sequence; -1: not there."""
        many = 8 * len(sought) > held.n  # unpacked once, not at every step
        value = held.get(np.arange(held.n)).__getitem__ if many else held.get
        lo, hi, there = lo.copy(), hi.copy(), np.flatnonzero(lo < hi)
        live = there[hi[there] - lo[there] > 1]
        while len(live):  # lo: the last value that is not larger, once they stand side by side
            mid = (lo[live] + hi[live]) // 2
            more = value(mid) > sought[live]
            hi[live[more]] = mid[more]
            lo[live[~more]] = mid[~more]
            live = live[hi[live] - lo[live] > 1]
        out = np.full(len(lo), -1, np.int64)
        found = there[value(lo[there]) == sought[there]]
        out[found] = lo[found]
        return out


# ---------------------------------------------------------------- packed arrays

def _pack(a: np.ndarray) -> bytes:
    """An array of integers as planes of bytes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def _unpack(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_numbers(a: np.ndarray) -> bytes:
    """Numbers of any size: in four bytes each where that holds them all, else in eight."""
    kind = np.uint32 if not len(a) or a.max() <= 0xFFFFFFFF else np.uint64
    return bytes([np.dtype(kind).itemsize]) + _pack(a.astype(kind))


def _unpack_numbers(raw: bytes) -> np.ndarray:
    return _unpack(raw[1:], np.uint64 if raw[:1] == b"\x08" else np.uint32).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the place of each given one, in four bytes: what a task holds is under 2^31."""
    nodes, of = np.unique(keys, return_inverse=True)
    return nodes, of.astype(np.int32)


def _below(above: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (above, word) pairs in order, and the place of each given pair; ``above`` has under 2^31 values."""
    own, local = None, words
    if len(words) and int(words.max()) >> 32:  # too large to stand beside the other in a key: by rank
        own, local = np.unique(words, return_inverse=True)
    nodes, of = _distinct(above.astype(np.int64) << 32 | local)
    word = nodes & 0xFFFFFFFF
    return nodes >> 32, word if own is None else own[word], of


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of keys, so sorting by key sorts by shard."""
    return ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


# ---------------------------------------------------------------- blocks of tokens

_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def _table(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of the columns that ``ddl`` names."""
    names, kinds = zip(*(x.split() for x in ddl.split(", ")))
    kinds = [pa.list_(_KINDS[k[6:-1]]) if k.startswith("array<") else _KINDS[k] for k in kinds]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


_BLOCK = "block long, ids array<long>, held array<boolean>, lengths array<int>, vocabulary binary, tokens binary"


def _blocks(most: int):
    def run(batches):
        from pyspark import TaskContext

        hashes = WordHashes()
        serial, ids, held, lengths, tokens, n = TaskContext.get().partitionId() << 32, [], [], [], [], 0
        seen = defaultdict(count().__next__)  # the block's words in the order in which they came

        def block():
            number, vocabulary = np.concatenate(tokens), hashes.of(list(seen))
            order = np.lexsort((vocabulary, -np.bincount(number)))  # small numbers for frequent words pack well
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            return _table(_BLOCK, [(serial, ids, held, lengths, _pack(vocabulary[order]), _pack(place[number]))])

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.cast(batch.column(2), pa.binary())):
                raw = text.as_py() or b""
                own = [*raw.lower().split(), END]
                ids.append(doc), held.append(bool(out)), lengths.append(len(own))
                tokens.append(np.fromiter(map(seen.__getitem__, own), np.uint32, len(own)))
                n += len(own)
                if n >= most:
                    yield block()
                    serial, ids, held, lengths, tokens, n = serial + 1, [], [], [], [], 0
                    seen = defaultdict(count().__next__)
        if ids:
            yield block()

    return run


class Block:
    """A block's arrays by position: token numbers, text lengths, whether its texts train."""

    def __init__(self, row: dict):
        self.block, self.ids, self.held_out = row["block"], row["ids"], np.array(row["held"], bool)
        self.vocabulary, self.tokens = _unpack(row["vocabulary"], np.uint64), _unpack(row["tokens"], np.uint32)
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trains = np.repeat(~self.held_out, self.lengths)

    def unigrams(self):
        """Keys sorted, and their training counts."""
        order = np.argsort(self.vocabulary)
        counts = np.bincount(self.tokens[self.trains], minlength=len(self.vocabulary))
        return self.vocabulary[order], counts[order]

    def by_token(self, of_sorted: np.ndarray) -> np.ndarray:
        """What is known of the sorted vocabulary, at every position."""
        out = np.empty(len(self.vocabulary), np.int64)
        out[np.argsort(self.vocabulary)] = of_sorted
        return out[self.tokens]


# ---------------------------------------------------------------- words

_WORDS_ASKED = "part int, block long, keys binary, counts binary"
_WORDS = "block long, part int, counts binary, numbers binary, n_tokens long, n_words long"
_WORD_COLUMNS = [x.split()[0] for x in _WORDS.split(", ")]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _word_asks(block: int, keys: np.ndarray, counts: np.ndarray, shards: int, parts: int) -> pa.RecordBatch:
    """Rows of sorted words for each of the parts, which are equal ranges of shards."""
    ends = np.searchsorted(_shard_of(keys, shards).astype(np.int64) * parts // shards, np.arange(parts + 1))
    some = [(p, slice(ends[p], ends[p + 1])) for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist()]
    return _table(_WORDS_ASKED, [(p, block, keys[at].tobytes(), _pack(counts[at].astype(np.uint64))) for p, at in some])


def _ask_words(shards: int):
    def by_part(parts: int):
        def run(batches):
            for row in _rows(batches):
                b = Block(row)
                yield _word_asks(b.block, *b.unigrams(), shards, parts)

        return run

    return by_part


def _merged_words(asked: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The places of each ask's words among all of them, these, and their counts."""
    keys = [np.frombuffer(x, np.uint64) for x in asked["keys"]]
    words, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, at, np.concatenate([_unpack(x, np.uint64) for x in asked["counts"]]).astype(np.int64))
    return np.split(at, np.cumsum([len(k) for k in keys])[:-1]), words, counts


def _numbers(words: np.ndarray, counts: np.ndarray, shard: int, shards: int, least: int) -> np.ndarray:
    """Of a shard's words, frequent ones first, from ``least`` on; 0: not in training."""
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, -counts))] = np.arange(len(words))
    return np.where(counts > 0, rank * shards + shard + least, 0)


def _answer_words(shards: int):
    """The training count and number (0: not in training) of every word; block -1 carries the shard's tokens and words."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        shard = int(asked["part"].iloc[0])
        places, words, total = _merged_words(asked)
        number = _numbers(words, total, shard, shards, FIRST_WORD)
        out = [(b, shard, _pack(total[at].astype(np.uint64)), _pack_numbers(number[at]), 0, 0) for b, at in zip(asked["block"], places)]
        out.append((-1, shard, b"", b"", int(total.sum()), int((total > 0).sum())))
        return pd.DataFrame(out, columns=_WORD_COLUMNS)

    return run


_KEPT_WORDS = "part int, words binary, counts binary, numbers binary, n_tokens long, n_words long"
_KEPT_WORD_COLUMNS = [x.split()[0] for x in _KEPT_WORDS.split(", ")]


def _keep_words(shards: int):
    """The words of a shard in order, with their counts and numbers."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        shard = int(asked["part"].iloc[0])
        _, words, total = _merged_words(asked)
        packed = _pack(total.astype(np.uint64)), _pack_numbers(_numbers(words, total, shard, shards, FIRST_WORD))
        return pd.DataFrame([(shard, words.tobytes(), *packed, int(total.sum()), int((total > 0).sum()))], columns=_KEPT_WORD_COLUMNS)

    return run


def _look_up_words(asked: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """The answers of a shard that keeps its words; 0 for others."""
    if asked.empty:
        return pd.DataFrame(columns=_WORD_COLUMNS)
    places, words, _ = _merged_words(asked)
    counts, numbers = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for row in kept.to_dict("records"):
        own = np.frombuffer(row["words"], np.uint64)
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        there = own[at] == words
        counts[there] = _unpack(row["counts"], np.uint64)[at[there]]
        numbers[there] = _unpack_numbers(row["numbers"])[at[there]]
    part = int(asked["part"].iloc[0])
    rows = [(b, part, _pack(counts[at].astype(np.uint64)), _pack_numbers(numbers[at]), 0, 0) for b, at in zip(asked["block"], places)]
    return pd.DataFrame(rows, columns=_WORD_COLUMNS)


def _merge_words(shards: int):
    def run(asked: pd.DataFrame) -> pd.DataFrame:
        _, words, counts = _merged_words(asked)
        return _word_asks(int(asked["region"].iloc[0]), words, counts, shards, shards).to_pandas()

    return run


def _deal_words(asked: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
    answered, part = answered.sort_values("part"), int(asked["part"].iloc[0])
    places, _, _ = _merged_words(asked)
    counts, numbers = np.concatenate([_unpack(x, np.uint64) for x in answered["counts"]]), np.concatenate([_unpack_numbers(x) for x in answered["numbers"]])
    return pd.DataFrame([(b, part, _pack(counts[at]), _pack_numbers(numbers[at]), 0, 0) for b, at in zip(asked["block"], places)], columns=_WORD_COLUMNS)


# ---------------------------------------------------------------- n-grams

class Grams:
    """The distinct n-grams of a block with its words' counts and numbers: a tree sorted by shard and word numbers."""

    def __init__(self, row: dict, order: int, shards: int, hot_from: int, n_texts: int):
        self.block, self.order, self.shards = Block(row), order, shards
        answers = sorted(row["words"], key=lambda a: a["part"])
        self.counts = self.block.by_token(np.concatenate([_unpack(a["counts"], np.uint64) for a in answers]).astype(np.int64))
        self.numbers = self.block.by_token(np.concatenate([_unpack_numbers(a["numbers"]) for a in answers]))
        b, pad = self.block, order
        # order - 1 starts before each text, order - 2 pads after it; every n-gram up to ``order`` begins a window
        padded = b.lengths + 2 * order - 3
        begin = np.cumsum(padded) - padded
        flat, seen = np.full(int(padded.sum()), pad, np.int64), np.full(int(padded.sum()), n_texts, np.int64)
        for i in range(order - 1):
            flat[begin + i] = order - 1 - i
        at = np.arange(len(b.tokens)) + np.repeat(begin + order - 1 - b.starts, b.lengths)
        flat[at], seen[at] = self.numbers, self.counts
        n = b.lengths + order - 2
        self.first_window = np.cumsum(n) - n
        windows = np.arange(int(n.sum())) + np.repeat(begin - self.first_window, n)
        first = flat[windows]
        self.asked = first > 0
        columns, lost = [first[self.asked]], np.zeros(len(windows), bool)
        for i in range(1, order):  # from an unknown word on there is nothing to find
            w = flat[windows + i]
            lost |= w == 0
            columns.append(np.where(lost, pad, w)[self.asked])
        first = seen[windows[self.asked]]
        del flat, seen, at, windows, w, lost  # a task holds many such arrays, so each goes when it has been used
        self.hot_first = first // hot_from > 0
        salts = (first // hot_from + 1).astype(np.uint64)
        dealt = mix(columns[0].astype(np.uint64) + mix(mix(columns[1].astype(np.uint64)) % salts))
        keys = _shard_of(dealt, shards).astype(np.int64) << 40 | columns[0]
        columns = columns[:0:-1]
        del first, salts, dealt
        # nodes of each level, sorted; of: the node of each asked window
        nodes, of = _distinct(keys)
        del keys
        self.shard, self.levels, self.of = nodes >> 40, [(nodes & (1 << 40) - 1, np.ones(len(nodes), np.int64))], [of]
        while columns:
            above, nodes, of = _below(of, columns.pop())
            self.levels.append((nodes, np.bincount(above, minlength=len(self.levels[-1][0]))))
            self.of.append(of)
        self.gram_counts = np.bincount(of[np.repeat(~b.held_out, n)[self.asked]], minlength=len(nodes))
        self.hot = np.zeros(len(self.levels[0][0]), bool)
        self.hot[self.of[0][self.hot_first]] = True

    def asks(self, parts: int) -> pa.RecordBatch:
        words = [w for w, _ in self.levels]
        kids = [k for _, k in self.levels[1:]]
        return _asks(self.block.block, self.shard, self.shards, parts, words, kids, self.gram_counts, self.hot)


_ASKED = "part int, block long, shard binary, words array<binary>, kids array<binary>, counts binary, hot binary"


def _asks(block: int, shard: np.ndarray, shards: int, parts: int, words: list, kids: list, counts: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Rows of a tree of n-grams for each of the parts (equal ranges of shards): its nodes level by level, sorted by shard."""
    ends = np.searchsorted(shard * parts // shards, np.arange(parts + 1))
    cuts, out = [ends], []
    for k in kids:
        cuts.append(np.concatenate([[0], np.cumsum(k)])[cuts[-1]])
    for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        at = [slice(c[p], c[p + 1]) for c in cuts]
        out.append(
            (
                p, block, _pack(shard[at[0]].astype(np.uint32)), [_pack_numbers(w[i]) for w, i in zip(words, at)],
                [_pack(k[i].astype(np.uint32)) for k, i in zip(kids, at)], _pack_numbers(counts[at[-1]]), _pack(hot[at[0]].astype(np.uint8)),
            )
        )
    return _table(_ASKED, out)


class Merged:
    """The n-grams that several asks hold, once each: nodes of each level (above, word), and what they were asked as."""

    def __init__(self, asked: pd.DataFrame, order: int):
        #: where each ask's nodes begin on each level; of: the merged node of each of them
        self.ends = []

        def words(k: int) -> np.ndarray:
            own = [_unpack_numbers(w[k]) for w in asked["words"]]
            self.ends.append(np.cumsum([0, *map(len, own)]))
            return np.concatenate(own)

        nodes, of = _distinct(np.concatenate([_unpack(x, np.uint32) for x in asked["shard"]]).astype(np.int64) << 40 | words(0))
        self.shard, self.levels, self.of = nodes >> 40, [(np.zeros(len(nodes), np.int64), nodes & (1 << 40) - 1)], [of]
        self.hot = np.zeros(len(nodes), bool)
        self.hot[of[np.concatenate([_unpack(h, np.uint8) for h in asked["hot"]]) > 0]] = True
        for k in range(1, order):
            above = np.repeat(of, np.concatenate([_unpack(x[k - 1], np.uint32) for x in asked["kids"]]))
            above, nodes, of = _below(above, words(k))
            self.levels.append((above, nodes))
            self.of.append(of)
        self.counts = np.bincount(of, weights=np.concatenate([_unpack_numbers(x) for x in asked["counts"]]), minlength=len(nodes)).astype(np.int64)

    def each(self, codes: list[np.ndarray], levels: range) -> list[list[bytes]]:
        """For each ask, the codes of its nodes on these levels."""
        own = [c[self.of[k]] for c, k in zip(codes, levels)]
        return [[_pack(c[self.ends[k][i] : self.ends[k][i + 1]]) for c, k in zip(own, levels)] for i in range(len(self.ends[0]) - 1)]


_ANSWERED = "block long, part int, alpha array<binary>, gamma array<binary>, hot_words binary, hot_kinds binary"
_ANSWER_COLUMNS = [x.split()[0] for x in _ANSWERED.split(", ")]


def _trained(m: Merged) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of the training n-grams; its first words that are dealt further, and how many different ones follow them here."""
    trained = np.flatnonzero(m.counts)
    grams, at = [], trained
    for above, numbers in reversed(m.levels):
        grams.insert(0, numbers[at])
        at = above[at]
    hot = m.levels[0][1][m.hot]
    trie = Trie.build(grams, m.counts[trained], hot)
    root = trie.children(0, np.zeros(len(hot), np.int64), trie.ranks(hot))
    hot, root = hot[root >= 0], root[root >= 0]
    kinds = trie.levels[1].pointers.get(root + 1) - trie.levels[1].pointers.get(root) if len(hot) else np.zeros(0, np.uint64)
    return trie, hot.astype(np.int64), kinds.astype(np.int64)


def _look_up(trie: Trie, m: Merged, asked: pd.DataFrame, order: int) -> list[tuple]:
    """The trie's codes of all asked n-grams, for each ask."""
    part, alpha, gamma, found = int(asked["part"].iloc[0]), [], [], np.zeros(1, np.int64)
    for k, (above, numbers) in enumerate(m.levels):
        found = trie.children(k, found[above], trie.ranks(numbers))
        held = trie.levels[k]
        alpha.append(np.append(held.alpha, np.uint16(0))[found])  # -1: the last, 0
        gamma.append(np.append(held.gamma, np.uint16(0))[found])
    return [(b, part, a, g, b"", b"") for b, a, g in zip(asked["block"], m.each(alpha[1:], range(1, order)), m.each(gamma[:-1], range(order - 1)))]


def _answer_grams(order: int):
    """Builds the shard's trie of the training n-grams and looks all asked ones up in it."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        m = Merged(asked, order)
        trie, hot, kinds = _trained(m)
        out = _look_up(trie, m, asked, order)
        out.append((-1, int(asked["part"].iloc[0]), [], [], hot.tobytes(), kinds.tobytes()))
        return pd.DataFrame(out, columns=_ANSWER_COLUMNS)

    return run


_KEPT_TRIE = "part int, piece int, trie binary, hot_words binary, hot_kinds binary"
_KEPT_TRIE_COLUMNS = [x.split()[0] for x in _KEPT_TRIE.split(", ")]


def _keep_grams(order: int):
    """The shard's trie in pieces; what is told of hot words stands beside the first."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        trie, hot, kinds = _trained(Merged(asked, order))
        part, told = int(asked["part"].iloc[0]), (hot.tobytes(), kinds.tobytes())
        return pd.DataFrame([(part, i, x, *(told if i == 0 else (b"", b""))) for i, x in enumerate(trie.pieces())], columns=_KEPT_TRIE_COLUMNS)

    return run


def _look_up_grams(order: int):
    """The answers of a shard that keeps its trie, or that has none."""

    def run(asked: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame(columns=_ANSWER_COLUMNS)
        trie = Trie.without_grams(order) if kept.empty else Trie.of_pieces(kept.sort_values("piece")["trie"].tolist())
        return pd.DataFrame(_look_up(trie, Merged(asked, order), asked, order), columns=_ANSWER_COLUMNS)

    return run


def _merge_asks(order: int, shards: int):
    """The asks of a region's blocks for some shards, as one ask of the region for each shard."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        m = Merged(asked.sort_values("block"), order)
        kids = [np.bincount(above, minlength=len(before[1])) for before, (above, _) in zip(m.levels, m.levels[1:])]
        return _asks(int(asked["region"].iloc[0]), m.shard, shards, shards, [w for _, w in m.levels], kids, m.counts, m.hot).to_pandas()

    return run


def _deal_answers(order: int):
    """The answers to a region's asks, dealt to the blocks that asked."""

    def run(asked: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        asked, answered = asked.sort_values("block"), answered.sort_values("part")
        m, part = Merged(asked, order), int(asked["part"].iloc[0])
        whole = lambda f, k: np.concatenate([_unpack(x[k], np.uint16) for x in answered[f]])
        alpha = m.each([whole("alpha", k) for k in range(order - 1)], range(1, order))
        gamma = m.each([whole("gamma", k) for k in range(order - 1)], range(order - 1))
        return pd.DataFrame([(b, part, a, g, b"", b"") for b, a, g in zip(asked["block"], alpha, gamma)], columns=_ANSWER_COLUMNS)

    return run


def _ask_grams(*args):
    def by_part(parts: int):
        def run(batches):
            for row in _rows(batches):
                yield Grams(row, *args).asks(parts)

        return run

    return by_part


_SCORE = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(hot_kinds, n_tokens: int, n_words: int, order: int, shards: int, hot_from: int, n_texts: int):
    def probabilities(g: Grams, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        answers = sorted(answers, key=lambda a: a["part"])
        codes = lambda f, k: np.concatenate([_unpack(a[f][k], np.uint16) for a in answers]) if answers else np.zeros(0, np.uint16)
        base = np.log10((g.counts + 1) / (n_tokens + n_words + 1))
        p = 10**base
        of = np.full((g.order, len(g.asked)), -1, np.int32)
        of[:, g.asked] = g.of
        hot = np.zeros(len(g.asked), bool)
        hot[g.asked] = g.hot_first
        local = np.arange(len(p)) + np.repeat(g.first_window - g.block.starts, g.block.lengths)
        for k in range(2, g.order + 1):
            window = local + g.order - k  # the one that begins with the token's k-gram
            there = of[0][window] >= 0
            alpha, gamma = np.zeros(len(p)), np.zeros(len(p))
            alpha[there] = restore(codes("alpha", k - 2)[of[k - 1][window[there]]])
            gamma[there] = restore(codes("gamma", k - 2)[of[k - 2][window[there]]])
            if k == 2 and hot.any():
                some = np.flatnonzero(hot[window])
                first = g.levels[0][0][of[0][window[some]]]
                kinds = np.array([hot_kinds.value.get(w, 0) for w in first.tolist()], np.float64)
                seen = np.where(first < FIRST_WORD, n_texts, np.concatenate([[0], g.counts])[some])
                alpha[some] *= 10**-LEAST / (seen + kinds)
                gamma[some] = kinds / (seen + kinds)
            known = g.numbers > 0
            p = np.where(known, alpha, 0.0) + np.where(gamma > 0, gamma, 1.0) * p
        return base, p

    def run(batches):
        for row in _rows(batches):
            g = Grams(row, order, shards, hot_from, n_texts)
            base, p = probabilities(g, row["answers"] or [])
            sums = [np.add.reduceat(x, g.block.starts) for x in ((g.counts > 0).astype(np.int64), base, np.log10(p))]
            columns = [pa.array(g.block.ids, pa.int64()), *map(pa.array, (g.block.held_out, g.block.lengths, *sums))]
            del row, g, base, p  # not beside the next block's
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


# ---------------------------------------------------------------- the operator

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", out: Column | None = None,
          scratch: Scratch | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    ``order`` is 2 or more.  ``out`` tells the texts that are only scored (default: by a hash of the id); the others train.
    """
    with Given(scratch, docs.sparkSession, "trie") as run:
        found = _scored(docs, order, id_col, text_col, out, run)
        return found if scratch else run.settled(found)[0]


def learn(docs: DataFrame, folder: str, order: int = 3, text_col: str = "text", scratch: Scratch | None = None) -> Model:
    """A model of all texts, kept in ``folder``, which must not be there yet and must be one that all executors share.

    Its totals are written last, so a folder that was left half written is no model.
    """
    spark = docs.sparkSession
    with Given(scratch, spark, "trie") as run:
        texts = docs.select(F.lit(None).cast("long").alias("id"), F.lit(False).alias("held"), F.col(text_col).cast("string").alias("text"))
        blocks, shards, buckets, n_texts = _in_blocks(texts, run)
        word_shards = max(1, shards // 4)
        asks, _ = _asks_to_shards(blocks, _ask_words(word_shards), _merge_words(word_shards), _WORDS_ASKED, word_shards, buckets, run, "words")
        asks.groupBy("part").applyInPandas(_keep_words(word_shards), _KEPT_WORDS).write.parquet(f"{folder}/words")
        words = spark.read.schema(_KEPT_WORDS).parquet(f"{folder}/words")
        n_tokens, n_words = words.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
        numbered = _numbered(blocks, buckets, word_shards, words, run)
        hot_from = _hot_from(n_tokens)
        asks, _ = _asks_to_shards(numbered, _ask_grams(order, shards, hot_from, n_texts), _merge_asks(order, shards), _ASKED, shards, buckets, run, "grams")
        asks.groupBy("part").applyInPandas(_keep_grams(order), _KEPT_TRIE).write.parquet(f"{folder}/tries")
        totals = (order, shards, word_shards, n_texts, n_tokens, n_words, hot_from)
        spark.createDataFrame([totals], _TOTALS).coalesce(1).write.parquet(f"{folder}/totals")
    return Model(spark, folder)


_TOTALS = "order int, shards int, word_shards int, n_texts long, n_tokens long, n_words long, hot_from long"
#: HOT_COUNT of models whose totals do not tell it.
FORMER_HOT_COUNT = 2_000_000


class Model:
    """What ``learn`` kept in a folder: words by shard, tries by shard, totals."""

    def __init__(self, spark: SparkSession, folder: str):
        self.words = spark.read.schema(_KEPT_WORDS).parquet(f"{folder}/words")
        self.tries = spark.read.schema(_KEPT_TRIE).parquet(f"{folder}/tries")
        totals = spark.read.schema(_TOTALS).parquet(f"{folder}/totals").first()
        self.order, self.shards, self.word_shards, self.n_texts, self.n_tokens, self.n_words, hot_from = totals
        self.hot_from = hot_from or _hot_from(self.n_tokens, FORMER_HOT_COUNT)  # the shards were dealt by it

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
        """id, n_tokens, n_known, train_tokens, base_score and score of every text; none is learned from."""
        with Given(scratch, docs.sparkSession, "trie") as run:
            texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("held"), F.col(text_col).cast("string").alias("text"))
            blocks, _, buckets, _ = _in_blocks(texts, run)
            numbered = _numbered(blocks, buckets, self.word_shards, self.words, run)
            args = (self.order, self.shards, self.hot_from, self.n_texts)
            route = (_ask_grams(*args), _look_up_grams(self.order), _merge_asks(self.order, self.shards), _deal_answers(self.order))
            answered, _ = _answers(numbered, route, (_ASKED, _ANSWERED), self.shards, buckets, run, "answers", self.tries)
            found = _sums(numbered, answered, buckets, _hot_kinds(self.tries), self.n_tokens, self.n_words, args)
            out = found.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(self.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
            return out if scratch else run.settled(out)[0]


def _scored(docs: DataFrame, order: int, id_col: str, text_col: str, out: Column | None, scratch: Scratch) -> DataFrame:
    out = held_out(F.col(id_col)) if out is None else out
    texts = docs.select(F.col(id_col).cast("long").alias("id"), out.alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks, shards, buckets, n_texts = _in_blocks(texts, scratch)
    word_shards = max(1, shards // 4)
    route = (_ask_words(word_shards), _answer_words(word_shards), _merge_words(word_shards), _deal_words)
    own, words = _answers(blocks, route, (_WORDS_ASKED, _WORDS), word_shards, buckets, scratch, "words")
    n_tokens, n_words = words.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    numbered = _with_words(blocks, own, buckets)
    args = (order, shards, _hot_from(n_tokens), n_texts)
    route = (_ask_grams(*args), _answer_grams(order), _merge_asks(order, shards), _deal_answers(order))
    answered, hot = _answers(numbered, route, (_ASKED, _ANSWERED), shards, buckets, scratch, "answers")
    scored = _sums(numbered, answered, buckets, _hot_kinds(hot), n_tokens, n_words, args)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _in_blocks(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int, int]:
    """The table of blocks, the shards that its n-grams want, its buckets, and how many texts train."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    tokens = size[0] // 6 + size[1]  # about
    shards, buckets = max(1, math.ceil(tokens / SHARD_GRAMS)), min(MOST_BUCKETS, max(1, math.ceil(tokens / BLOCK_TOKENS)))
    blocks = scratch.write_bucketed(texts.mapInArrow(_blocks(BLOCK_TOKENS), _BLOCK), "blocks", "block", buckets)
    n_texts = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    return blocks, shards, buckets, n_texts


def _with_words(blocks: DataFrame, answered: DataFrame, buckets: int) -> DataFrame:
    # dealt as the blocks are, so that neither the grouping nor the join deals them again
    mine = answered.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("part", "counts", "numbers")).alias("words"))
    return blocks.join(mine, "block")


def _numbered(blocks: DataFrame, buckets: int, word_shards: int, words: DataFrame, scratch: Scratch) -> DataFrame:
    """The blocks with what kept words tell of theirs."""
    route = (_ask_words(word_shards), _look_up_words, _merge_words(word_shards), _deal_words)
    return _with_words(blocks, _answers(blocks, route, (_WORDS_ASKED, _WORDS), word_shards, buckets, scratch, "numbers", words)[0], buckets)


def _hot_from(n_tokens: int, count: int | None = None) -> int:
    """Occurrences from which on a first word is dealt further."""
    return max(count or HOT_COUNT, int(n_tokens * HOT_SHARE))


def _hot_kinds(hot: DataFrame) -> dict[int, int]:
    """How many different words follow the words that are dealt further: at most 1 / HOT_SHARE words."""
    kinds: dict[int, int] = {}
    for r in hot.filter("length(hot_words) > 0").select("hot_words", "hot_kinds").toLocalIterator():
        for w, n in zip(np.frombuffer(r["hot_words"], np.int64).tolist(), np.frombuffer(r["hot_kinds"], np.int64).tolist()):
            kinds[w] = kinds.get(w, 0) + n
    return kinds


def _sums(numbered: DataFrame, answered: DataFrame, buckets: int, kinds: dict[int, int], n_tokens: int, n_words: int, args: tuple) -> DataFrame:
    back = answered.repartition(buckets, "block")
    replies = back.groupBy("block").agg(F.collect_list(F.struct("part", "alpha", "gamma")).alias("answers"))
    kinds = numbered.sparkSession.sparkContext.broadcast(kinds)
    return numbered.join(replies, "block", "left").mapInArrow(_score(kinds, n_tokens, n_words, *args), _SCORE)


def _asks_to_shards(blocks: DataFrame, ask, merge, kind: str, shards: int, n_blocks: int, scratch: Scratch, name: str) -> tuple[DataFrame, tuple | None]:
    """What each shard is asked; beyond FAN_OUT shards also the asks of the regions, and the parts they are for."""
    if shards <= FAN_OUT:
        return blocks.mapInArrow(ask(shards), kind), None
    parts, regions = math.isqrt(shards) + 1, math.isqrt(n_blocks) + 1
    region = F.pmod(F.xxhash64("block"), F.lit(regions))
    asked = scratch.write(blocks.mapInArrow(ask(parts), kind).withColumn("region", region), f"{name}-asked")
    return asked.groupBy("part", "region").applyInPandas(merge, kind), (asked, parts)


def _answers(blocks: DataFrame, route: tuple, kinds: tuple[str, str], shards: int, n_blocks: int, scratch: Scratch, name: str,
             kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The shards' answers to the blocks, and what else they tell (block -1); ``kept``: they answer from what they keep.

    ``route``: what a block asks, what a shard answers, how asks are merged, how answers are dealt.  Up to FAN_OUT
    shards a block asks each of them.  Beyond, asks would be as many as blocks times shards and as small as single
    n-grams: blocks ask about as many parts of the shards as is their square root, the asks of a region (as many as
    the square root of the blocks) for a part are merged, and one ask goes to each shard.
    """
    ask, answer, merge, deal = route
    asks, merged = _asks_to_shards(blocks, ask, merge, kinds[0], shards, n_blocks, scratch, name)
    by_shard = asks.groupBy("part")
    by_shard = by_shard if kept is None else by_shard.cogroup(kept.groupBy("part"))
    answered = scratch.write(by_shard.applyInPandas(answer, kinds[1]), name if merged is None else f"{name}-of-shards")
    if merged is None:
        return answered.filter("block >= 0"), answered.filter("block < 0")
    asked, parts = merged
    # shards are dealt to parts as in the asks
    of = F.expr(f"CAST(CAST(part AS BIGINT) * {parts} div {shards} AS INT)")
    own = answered.filter("block >= 0").withColumns({"region": F.col("block"), "of": of})
    dealt = asked.groupBy("part", "region").cogroup(own.groupBy("of", "region")).applyInPandas(deal, kinds[1])
    return scratch.write(dealt, name), answered.filter("block < 0")


def op1_ngram_trie(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
