"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

The inputs of a step are a word embedding and the mean embedding of the word's character 3- and
4-grams (both hashed).  Windows of WINDOW words overlap by WINDOW - STRIDE and cover the whole
text; a text scores as its highest window.  The network is fitted on the driver by
backpropagation on all windows of at most ``per_class`` labelled documents and ``fit_bytes`` of text a class
(the documented bounds of the fit; scoring has none).  The first passes take every window of a toxic document as
toxic; later ones only its highest, since most windows of a toxic document hold nothing toxic, and of
a clean document its highest few.  The cut between the classes is set on whole documents, by their
highest windows.  The fitted network, some MB whatever the corpus, is broadcast.

Defined cases: null, empty or wordless texts score as one window without words; a null id is never
held out and never learnt from; labels that are null are not learnt from, of repeated labels the
highest counts; without both classes among the labels every text scores 0; repeated rows score
alike; empty tables give no rows; other columns stay, but for one named score, which is given anew;
lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Given, Scratch, in_slices, table

WINDOW, STRIDE = 32, 24
#: Windows of a clean document that the later passes of the fit learn from: those that score highest.
HARDEST = 12
#: Bytes of text scored at a time; words whose input projections a worker remembers.
CHUNK_BYTES, REMEMBERED = 1 << 20, 60_000
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows that cover n words; the last one ends at the end."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def features(words: list[bytes], word_buckets: int, char_buckets: int):
    """Bucket of each word, and the buckets of its character n-grams as (flat, counts)."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    begin = np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - begin[own]
    left = lengths[own] - place  # bytes from here to the end of the word
    grams, of = [], []
    value = flat.copy()
    k = np.uint64(0x100000001B3)
    for n in (2, 3, 4):
        value = value[:-1] * k + flat[n - 1 :] + np.uint64(n) if len(value) > 1 else value[:0]
        if n > 2:
            at = np.flatnonzero(left[: len(value)] >= n)
            grams.append(_bucket(value[at], char_buckets))
            of.append(own[at])
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(words))
    # the hash of a whole word: a sum of its bytes weighted by their places
    weight = _mix(place.astype(np.uint64) + np.uint64(1))
    whole = np.add.reduceat(_mix(flat + np.uint64(257)) * weight, begin) if len(words) else np.zeros(0, np.uint64)
    return _bucket(whole, word_buckets), grams[order], counts


def _mix(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _bucket(h, n):
    return (_mix(h) >> np.uint64(40)).astype(np.int64) % n


def _sigmoid(x):
    return np.float32(1) / (np.float32(1) + np.exp(-x))


def _sum_by(rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index, as n rows."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        keys, first = np.unique(index[order], return_index=True)
        out[keys] = np.add.reduceat(rows[order], first, axis=0)
    return out


@dataclass
class Network:
    hidden: int = 8
    embed: int = 8
    word_buckets: int = 1 << 17
    char_buckets: int = 1 << 16
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.p:
            rng = np.random.default_rng(self.seed)
            h, e = self.hidden, self.embed
            draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
            self.p = {
                # zero, so that words and n-grams never met in the fit say nothing; the last row is kept zero
                "words": np.zeros((self.word_buckets + 1, e), np.float32), "chars": np.zeros((self.char_buckets + 1, e), np.float32),
                "input": draw(2 * e, 6 * h, scale=0.4), "bias": np.zeros(6 * h, np.float32),
                "forward": draw(h, 3 * h, scale=0.3), "backward": draw(h, 3 * h, scale=0.3),
                "attend": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "shift": np.zeros(1, np.float32),
            }

    # ---- inputs of words

    def inputs(self, feats) -> np.ndarray:
        word, grams, counts = feats
        chars = np.zeros((len(word), self.embed), np.float32)
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            chars[some] = np.add.reduceat(self.p["chars"][grams], first, axis=0) / counts[some, None].astype(np.float32)
        return np.concatenate([self.p["words"][word], chars], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["input"] + self.p["bias"]

    # ---- windows

    def _run(self, x, mask, u, keep):
        """One direction over x (steps, windows, 3h); the states of all steps, and what the gradient needs."""
        h = self.hidden
        state = np.zeros((x.shape[1], h), np.float32)
        states, saved = np.empty((x.shape[0], x.shape[1], h), np.float32), []
        for t in range(x.shape[0]):
            g = state @ u
            zr = _sigmoid(x[t, :, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (state - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, state)
            if keep:
                saved.append((state, g[:, 2 * h :], z, r, n))
            states[t] = state = new
        return states, saved

    def logits(self, projected: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows: index (windows, steps) into the projected words; mask False: no word there."""
        h = self.hidden
        x = projected[index.T]
        mask = None if mask is None else mask.T
        f, saved_f = self._run(x[:, :, : 3 * h], mask, self.p["forward"], keep)
        b, saved_b = self._run(x[::-1, :, 3 * h :], None if mask is None else mask[::-1], self.p["backward"], keep)
        states = np.concatenate([f, b[::-1]], axis=2)
        e = states @ self.p["attend"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        if mask is not None:
            a = a * mask
        a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tb,tbh->bh", a, states)
        y = pooled @ self.p["out"] + self.p["shift"]
        return (y, (x, mask, states, a, pooled, saved_f, saved_b)) if keep else y

    def _back(self, d_states, mask, u, saved):
        h = self.hidden
        steps = len(saved)
        dx = np.empty((steps, d_states.shape[1], 3 * h), np.float32)
        du, carry = np.zeros_like(u), np.zeros((d_states.shape[1], h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, gn, z, r, n = saved[t]
            d = carry + d_states[t]
            live = d if mask is None else d * mask[t][:, None]
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (state - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            du += state.T @ dg
            carry = (d - live) + live * z + dg @ u.T
        return dx, du

    def gradient(self, feats, index, mask, y):
        """Loss and gradients for windows over the words of ``feats``."""
        x_words = self.inputs(feats)
        out, (x, m, states, a, pooled, sf, sb) = self.logits(self.project(x_words), index, mask, keep=True)
        prob = _sigmoid(out)
        d_out = ((prob - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d_out, "shift": d_out.sum(keepdims=True)}
        d_pooled = d_out[:, None] * self.p["out"]
        d_a = np.einsum("bh,tbh->tb", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["attend"]
        h = self.hidden
        dxf, g["forward"] = self._back(d_states[:, :, :h], m, self.p["forward"], sf)
        dxb, g["backward"] = self._back(d_states[::-1, :, h:], None if m is None else m[::-1], self.p["backward"], sb)
        dx = np.concatenate([dxf, dxb[::-1]], axis=2)
        d_proj = _sum_by(dx.reshape(-1, 6 * h), index.T.ravel(), len(x_words))
        g["input"], g["bias"] = x_words.T @ d_proj, d_proj.sum(axis=0)
        d_x = d_proj @ self.p["input"].T
        word, grams, counts = feats
        g["words"] = (word, d_x[:, : self.embed])
        per = np.repeat(np.arange(len(word)), counts)
        g["chars"] = (grams, d_x[per, self.embed :] / np.maximum(counts, 1)[per, None].astype(np.float32))
        eps = 1e-7
        return float(-np.mean(y * np.log(prob + eps) + (1 - y) * np.log(1 - prob + eps))), g


class _Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, g) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            at = slice(None)
            if isinstance(d, tuple):  # rows that the batch touched
                at = np.unique(d[0])
                d = _sum_by(d[1], np.searchsorted(at, d[0]), len(at))
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * d * d
            self.net.p[k][at] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        self.net.p["words"][-1] = self.net.p["chars"][-1] = 0


def _slice(feats, rows):
    word, grams, counts = feats
    first = np.cumsum(counts) - counts
    n = counts[rows]
    flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)
    return word[rows], grams[flat], n


def fit(docs: list[tuple[int, str]], net: Network | None = None, passes: int = 5, batch: int = 256, rate: float = 0.01, least_docs: int = 5) -> Network:
    """Fit on all windows of labelled texts (label, text); the threshold is set between the classes.

    Few windows are taken in smaller batches and more passes, so that there are some hundred steps.
    """
    net = net or Network()
    names: dict[bytes, int] = {b"": 0}
    windows = []
    for _, text in docs:
        ws = words_of(text.encode())
        ids = np.zeros(max(WINDOW, len(ws)), np.int32)
        ids[: len(ws)] = [names.setdefault(w, len(names)) for w in ws]
        windows.append(ids[np.array(windows_of(len(ws)))[:, None] + np.arange(WINDOW)])
    owner = np.repeat(np.arange(len(docs)), [len(w) for w in windows])
    labels, index = np.array([y for y, _ in docs], np.float32)[owner], np.concatenate(windows)
    del windows
    known = list(names)
    parts = [features(known[i : i + 20_000], net.word_buckets, net.char_buckets) for i in range(0, len(known), 20_000)]
    word, grams, counts = map(np.concatenate, zip(*parts))
    # words and n-grams of few documents would be learnt by heart: they get the bucket that stays zero
    raw = (word, grams, counts)
    docs_of_word, docs_of_gram = np.zeros(len(names), np.int64), np.zeros(net.char_buckets, np.int64)
    first = np.searchsorted(owner, np.arange(len(docs) + 1))
    for d in range(len(docs)):
        own = np.unique(index[first[d] : first[d + 1]])
        docs_of_word[own] += 1
        docs_of_gram[np.unique(_slice(raw, own)[1])] += 1
    common, known = docs_of_word >= least_docs, docs_of_gram >= least_docs
    feats = np.where(common, word, net.word_buckets), np.where(known[grams], grams, net.char_buckets), counts
    doc_y = np.array([y for y, _ in docs], dtype=np.float32)
    adam, rng = _Adam(net, rate), np.random.default_rng(net.seed)
    batch = min(batch, max(16, len(owner) // 100))
    passes = max(passes, min(40, 600 * batch // max(1, len(owner))))
    for k in range(passes):
        if k < passes // 5:
            chosen = np.arange(len(owner))
        else:  # of toxic documents only the highest window, of clean ones the HARDEST
            score = _score(net, feats, index)
            order = np.lexsort((-score, owner))
            place = np.arange(len(owner)) - first[owner[order]]
            chosen = np.concatenate([order[(labels[order] == 0) & (place < HARDEST)], np.repeat(order[(labels[order] == 1) & (place == 0)], 4)])
        chosen = rng.permutation(chosen)
        for i in range(0, len(chosen), batch):
            at = chosen[i : i + batch]
            words, local = np.unique(index[at], return_inverse=True)
            local = local.reshape(len(at), WINDOW)
            adam.step(net.gradient(_slice(feats, words), local, index[at] > 0, labels[at])[1])
    score = _score(net, feats, index)
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, owner, score)
    # the cut of fewest errors; of equal ones nearer to the toxic side, as texts not fitted score higher than fitted ones
    order = np.argsort(top)
    errors = np.concatenate([[0], np.cumsum(np.where(doc_y[order] == 1, 1, -1))])
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[top.min() - 1], (top[order][1:] + top[order][:-1]) / 2, [top.max() + 1]])
    net.p["shift"] = net.p["shift"] - np.float32(edges[best[0]] + 0.7 * (edges[best[-1]] - edges[best[0]]))
    return net


def _score(net: Network, feats, index) -> np.ndarray:
    out = np.empty(len(index))
    for i in range(0, len(index), 1024):
        part = index[i : i + 1024]
        words, local = np.unique(part, return_inverse=True)
        out[i : i + 1024] = net.logits(net.project(net.inputs(_slice(feats, words))), local.reshape(part.shape), part > 0)
    return out


class Scorer:
    """Scores whole texts; remembers the input projections of words up to a bound."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self):
        self.rows = _Rows()
        self.table = np.zeros((1, 6 * self.net.hidden), np.float32)
        self.used = 1

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of a slice of texts (null: empty)."""
        return self._chunk([t or b"" for t in texts]) if len(texts) else np.zeros(0)

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self._clear()
        flat, counts = [], []
        for t in texts:
            ws = words_of(t)
            counts.append(len(ws))
            flat += ws
        ids = np.fromiter(map(self.rows.__getitem__, flat), dtype=np.int64, count=len(flat))
        if new := self.rows.new:
            if len(self.rows) + 1 > len(self.table):
                grown = np.zeros((max(len(self.rows) + 1, 3 * len(self.table) // 2), self.table.shape[1]), np.float32)
                grown[: self.used] = self.table[: self.used]
                self.table = grown
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                net = self.net
                self.table[self.used : self.used + len(part)] = net.project(net.inputs(features(part, net.word_buckets, net.char_buckets)))
                self.used += len(part)
            self.rows.new = []
        full, short, of_full, of_short = [], [], [], []
        base = 0
        for k, n in enumerate(counts):
            if n < WINDOW:
                short.append(np.concatenate([ids[base : base + n], np.zeros(WINDOW - n, np.int64)]))
                of_short.append(k)
            else:
                starts = windows_of(n)
                full += [base + s for s in starts]
                of_full += [k] * len(starts)
            base += n
        score = np.full(len(texts), -np.inf)
        steps = np.arange(WINDOW)
        for i in range(0, len(full), 2048):
            index = ids[np.array(full[i : i + 2048])[:, None] + steps]
            np.maximum.at(score, of_full[i : i + 2048], self.net.logits(self.table, index, None))
        for i in range(0, len(short), 2048):
            index = np.array(short[i : i + 2048])
            np.maximum.at(score, of_short[i : i + 2048], self.net.logits(self.table, index, index > 0))
        return 1 / (1 + np.exp(-score))


class _Rows(dict):
    """word -> row of the table of projections; row 0 is no word."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word):
        self.new.append(word)
        n = self[word] = len(self) + 1
        return n


# ---------------------------------------------------------------- on Spark

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1500, fit_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text",
          scratch: Scratch | None = None) -> Network | None:
    """Fit on labelled documents that are not held out: of each class the first by a hash of the id, as many as ``per_class``
    and ``fit_bytes`` of their texts allow (a text longer than all of that is not learnt from; scoring has no bound)."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(id_col).agg(F.max("toxic").cast("int").alias("y"))
    )
    order = [F.xxhash64(id_col), F.col(id_col)]
    # at most twice per_class ids: a bounded side
    sample = known.filter("y = 1").orderBy(*order).limit(per_class).unionByName(known.filter("y = 0").orderBy(*order).limit(per_class))
    with Given(scratch, docs.sparkSession, "fit") as run:
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample.withColumnRenamed(id_col, "id")), "id")
        rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))  # one text of a repeated id
        rows = run.write(rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "sample")
        # sizes of the sample, then the texts within the bound
        upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
        taken = rows.select("id", "y", "size").filter(F.col("size") <= fit_bytes).withColumn("upto", upto).filter(F.col("upto") <= fit_bytes).select("id")
        got = sorted((r["y"], r["text"] or "") for r in rows.join(F.broadcast(taken), "id").select("y", "text").collect())
    if len({y for y, _ in got}) < 2:
        return None
    order = np.random.default_rng(11).permutation(len(got))
    return fit([got[i] for i in order])


def save(net: Network, spark, folder: str) -> None:
    """The network as a table of one row, to score with in other sessions."""
    held = io.BytesIO()
    np.savez(held, hidden=net.hidden, embed=net.embed, word_buckets=net.word_buckets, char_buckets=net.char_buckets, **{f"p_{k}": v for k, v in net.p.items()})
    spark.createDataFrame([(held.getvalue(),)], "network binary").coalesce(1).write.parquet(folder)


def load(spark, folder: str) -> Network:
    held = np.load(io.BytesIO(bytes(spark.read.parquet(folder).first()["network"])))
    size = {k: int(held[k]) for k in ("hidden", "embed", "word_buckets", "char_buckets")}
    return Network(**size, p={k[2:]: held[k] for k in held.files if k.startswith("p_")})


def score(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1)."""
    if net is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = [c for c in docs.columns if c != "score"]
    docs = docs.select(*names)
    at = names.index(text_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, texts in in_slices(batch, at, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.score(texts), pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, ddl)


def drop_toxic(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under a half, all columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*names), net, names[docs.columns.index(text_col)])
    return scored.filter(F.col("score") < 0.5).select(*names).toDF(*docs.columns)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score(docs, learn(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
