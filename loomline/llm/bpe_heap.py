"""Token counts by byte-pair merging with a heap over a linked list of symbols.

Every pre-token starts as one symbol a byte; the adjacent pair of lowest rank (ties: leftmost) is
popped and merged until no adjacent pair has a rank.  A text's count is its symbols minus its
merges (and one for each special string the library would recognise), so no identifiers are ever
made.  Counts of pre-tokens are remembered in each worker up to a bound.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a pre-token of any length costs
n log n; repeated rows are counted each; a special string inside a text (``<|endoftext|>``)
is one token, as the library has it; an empty table gives no rows; other columns stay, whatever their
names (but for n_bytes and n_tokens, which are given anew).
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

#: Pre-tokens remembered by a worker.
REMEMBERED = 800_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merges_of(symbols: list, ranks: dict, joined=lambda a, b: a + b) -> list:
    """The symbols left when pairs are merged by rank; ``ranks`` is keyed by pairs of symbols."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of = ranks.get
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank_of((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return symbols
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, a, b = pop(heap)
        j = after[i]
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i] = s = joined(a, b)
        symbols[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of((s, symbols[k]))) is not None:
                push(heap, (r, i, s, symbols[k]))
        if (h := before[i]) >= 0 and (r := rank_of((symbols[h], s))) is not None:
            push(heap, (r, h, symbols[h], s))
    return [s for s in symbols if s is not None]


class Counter(dict):
    """pre-token -> number of tokens, for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.alphabet = byte_alphabet()
        self.split = regex.compile(pattern).findall
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_strings = special
        self.remembered = remembered

    def __missing__(self, word: str) -> int:
        n = self[word] = len(merges_of(list(word.encode().decode("latin-1").translate(self.alphabet)), self.ranks))
        return n

    def count(self, text: str) -> int:
        if len(self) > self.remembered:
            self.clear()
        if any(s in text for s in self.special_strings):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)
        return sum(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes and n_tokens; ``path`` must exist on the executors."""
    keep = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        counted = counter(path, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "")
            n = [counted.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64())], names=[*keep, "n_bytes", "n_tokens"]
            )

    return docs.select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "_text"))).mapInArrow(run, f"{ddl}n_bytes long, n_tokens long")


def op5_bpe_heap(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
