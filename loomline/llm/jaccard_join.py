"""N-gram Jaccard self-join: the product of the document by n-gram incidence matrix, in blocks.

Links are pairs of documents whose sets of distinct word n-grams have
``percent * union <= 100 * intersection``.  Documents of equal sets are one row of the matrix.

1. Column blocks.  Two linked rows of sizes a and b differ in at most
   (100 - p) / (100 + p) * (a + b) columns.  For a window of sizes that is at most k, so with the
   columns dealt by hash to m > k blocks the two rows agree on a whole block, and one that is not
   empty in either (a row with too many empty blocks also offers these).  A block of a row is
   offered as one 64-bit value; the row blocks that meet are those with an equal value.  The
   windows of sizes overlap so that every pair of sizes that can link shares one.  A task offers a
   value once for SLICE_VALUES of them: later rows of the slice that hold it meet the first one
   there, so a block of many rows reaches the shuffle once a slice.
2. Rows that meet are bounded before they are compared: by their sizes, and by a sketch of parity
   bits, one flip a column, of which two rows cannot differ in more bits than columns.  A sketch has
   half as many bits as its row has columns at least (SKETCH, and at most WIDEST), as a narrower one
   is full and bounds nothing; of two widths the wider is folded.  First every row meets the centre (first member) of each of its blocks, which joins groups of
   near copies in about as many pairs as members.
3. Blocks of three rows and more that still hold several groups are met in tiles of bounded size;
   the pairs across groups that the bounds leave join these.
4. Rows that can link share a group now.  Only their sets are fetched anew from their texts, and
   the members of each group are dealt to tiles in which every two of them meet once.  A tile
   multiplies out the pairs that the bounds leave; each row counts its links there, a link with a
   row of the matrix once for each of its documents, and the links give the components.

No pairs of equal texts are made and no pairs within a group are listed, but every link is counted.

Defined cases: null, empty or wordless texts have an empty set and link with nothing; shorter
texts than the n-gram are one n-gram; very long texts are rows like others; repeated rows and
repeated ids are documents of their own (rows of the matrix are named by their sets, never by
ids); a null id is a document whose id is no component's smallest unless all there are null; an
empty table gives no rows; other columns are ignored by ``join`` and stay in ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Given, Scratch, WordHashes, fresh, in_slices, join_with_hot, mix, table
from .components import connected_components

#: Rows of one block in a tile; fewest and most bits of a row's sketch; words of sketches compared at a time.
TILE, SKETCH, WIDEST, WORDS = 1024, 512, 1 << 16, 1 << 20
#: Rows and columns' entries of one side of a tile whose links are counted; columns of its product at a time.
COUNTED, ENTRIES, COLUMNS = 512, 2_000_000, 4096
#: Rows whose names are broadcast to fetch their texts again or to leave them out; beyond it a shuffled join does.
BROADCAST_ROWS = 300_000
#: Block values of one slice of a task, and sets that a task remembers to have offered.
SLICE_VALUES, OFFERED_SETS = 1_000_000, 100_000
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- rows of the matrix

def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of one text, given its word hashes."""
    if not len(words):
        return words
    n = min(width, len(words))
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = mix(h) + words[i : len(words) - n + 1 + i]
    return np.unique(mix(h + np.uint64(n)))


def size_windows(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(smallest, largest, k, m) of the size windows up to ``most``.

    A pair with larger size b lies in the first window that reaches b.  Below the first window
    only equal sets link.
    """
    t = percent / 100
    out, top = [], 0
    while (100 - percent) * 2 * (top + 1) < 100 + percent:
        top += 1
    while top < most:
        low = -(-percent * (top + 1) // 100)
        top = max(top + 1, int(low / t**3))
        k = 2 * (100 - percent) * top // (100 + percent)
        m = k + 1
        for _ in range(8):  # room for the blocks that chance leaves empty
            empty = m * math.exp(-low / m)
            m = min(2 * k + 4, k + 1 + math.ceil(empty + 3 * math.sqrt(empty)))
        out.append((low, top, k, m))
    return out


def block_values(rows: list[np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) of every column block that the rows offer."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of, value = [], []
    first = np.searchsorted(windows[:, 1], sizes)
    for step in range(4):  # the windows that hold a size are consecutive
        w = first + step
        there = w < len(windows)
        there[there] = windows[w[there], 0] <= sizes[there]
        at = np.flatnonzero(there & (sizes > 0))
        if not len(at):
            break
        flat = np.concatenate([rows[i] for i in at])
        own = np.repeat(at, sizes[at])
        m = windows[w[at], 3].astype(np.uint64)
        block = ((flat >> np.uint64(32)) * np.repeat(m, sizes[at])) >> np.uint64(32)
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (block[1:] != block[:-1])]))
        content = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), new)
        row = own[new]
        label = w[row].astype(np.uint64) << np.uint64(32) | block[new]
        of.append(row)
        value.append(mix(content ^ mix(label)))
        filled = np.bincount(row, minlength=len(rows))
        for i in at[filled[at] <= windows[w[at], 2]]:  # so many are empty that only empty ones may agree
            empty = np.setdiff1d(np.arange(int(windows[w[i], 3])), block[new][row == i].astype(np.int64))
            of.append(np.full(len(empty), i))
            value.append(mix(mix(np.uint64(w[i]) << np.uint64(32) | empty.astype(np.uint64))))
    return (np.concatenate(of), np.concatenate(value)) if of else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _rows_of(texts: list[bytes | None], width: int, hashes: WordHashes) -> list[np.ndarray]:
    return [gram_hashes(hashes.of((t or b"").lower().split()), width) for t in texts]


def sketch(row: np.ndarray) -> bytes:
    """Parity of the columns of each residue; there is a power of two of them."""
    bits = min(WIDEST, max(SKETCH, 1 << (len(row) - 1).bit_length() >> 1))
    return np.packbits((np.bincount((row & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


class _Slice:
    """Rows of a slice of a task: what each offers, and the blocks in which it meets an earlier one."""

    def __init__(self):
        self.keys, self.sets, self.sizes, self.sketches, self.of, self.values, self.held = [], [], [], [], [], [], 0

    def add(self, keys: pa.RecordBatch, sets: list, sizes: list, sketches: list, of: np.ndarray, values: np.ndarray) -> None:
        self.of.append(of + len(self.sets))
        self.values.append(values)
        self.held += len(values)
        self.keys.append(keys)
        self.sets += sets
        self.sizes += sizes
        self.sketches += sketches

    def batch(self) -> pa.RecordBatch:
        n = len(self.sets)
        shorts = np.array([0 if s is None else int.from_bytes(s[:8], "little", signed=True) for s in self.sets], np.int64)
        of, values = np.concatenate(self.of), np.concatenate(self.values).view(np.int64)
        order = np.lexsort((of, values))
        of, values = of[order], values[order]
        first = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
        run = np.cumsum(first) - 1
        holder = of[first][run] if len(of) else of
        shared = (np.bincount(run) > 1)[run] if len(of) else first
        ids, told = (pa.concat_arrays([k.column(i) for k in self.keys]) for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [
                ids, told, pa.array(self.sets, pa.binary()), pa.array(shorts), pa.array(self.sizes, pa.int64()), pa.array(self.sketches, pa.binary()),
                _lists(of[first], values[first], n), _lists(of[shared], values[shared], n), _lists(of[shared], shorts[holder[shared]], n),
            ],
            names=["id", "told", "set", "short", "n", "sketch", "offered", "met", "centres"],
        )


_MATRIX = "id long, told long, set binary, short long, n long, sketch binary, offered array<long>, met array<long>, centres array<long>"


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n rows."""
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order]))


def digest(row: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(row.tobytes()) if len(row) else None


def _matrix(width: int, percent: int):
    """Batches of (id, told, text) to one row a document; a set that the task has offered before offers nothing."""

    def run(batches):
        hashes, offered, held = WordHashes(), set(), _Slice()
        windows = np.array(size_windows(percent, 1 << 40), dtype=np.int64)
        for batch in batches:
            for part, texts in in_slices(batch, 2, CHUNK_BYTES):
                rows = _rows_of(texts, width, hashes)
                sets, sizes, sketches = [digest(r) for r in rows], [len(r) for r in rows], []
                for i, (s, r) in enumerate(zip(sets, rows)):
                    if s is None or s in offered:
                        rows[i] = r[:0]
                        sketches.append(None)
                    else:
                        offered.add(s)
                        sketches.append(sketch(r))
                held.add(part, sets, sizes, sketches, *block_values(rows, windows))
                if held.held >= SLICE_VALUES or len(held.sets) >= SLICE_VALUES // 8:
                    yield held.batch()
                    held = _Slice()
                    if len(offered) > OFFERED_SETS:
                        offered.clear()
        if held.sets:
            yield held.batch()

    return run


# ---------------------------------------------------------------- comparing rows

def within_bounds(n_a, n_b, bits_a: np.ndarray, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of these sizes and sketches (as 64-bit words) can link."""
    most = (100 - percent) * (n_a + n_b) // (100 + percent)
    fits = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent
    return fits & (np.bitwise_count(bits_a ^ bits_b).sum(axis=-1) <= most)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of one width as rows of so many 64-bit words: the residues of half as many are the sum of both halves."""
    out = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while out.shape[1] > words:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def _held_bytes(column) -> np.ndarray:
    return np.array(column.to_pylist() + [None], dtype=object)[:-1]


def _words(sketches: np.ndarray) -> np.ndarray:
    return np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8


def can_link(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the rows a (their sizes and sketches) the bounds allow to link with which of the rows b, as a matrix."""
    out, w_a, w_b = np.zeros((len(a), len(b)), dtype=bool), _words(a), _words(b)
    for u in np.unique(w_a):
        i = np.flatnonzero(w_a == u)
        for v in np.unique(w_b):
            j = np.flatnonzero(w_b == v)
            if 100 * min(n_a[i].max(), n_b[j].max()) < percent * max(n_a[i].min(), n_b[j].min()):
                continue
            x, y = folded(a[i], min(u, v)), folded(b[j], min(u, v))
            step = max(1, WORDS // y.size)
            for at in range(0, len(i), step):
                some = i[at : at + step]
                out[np.ix_(some, j)] = within_bounds(n_a[some][:, None], n_b[j], x[at : at + step][:, None], y, percent)
    return out


def _bounded_pairs(percent: int):
    """Rows a, n, bits, b, n, bits to the pairs (a, b) that the bounds leave."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(i).to_numpy() for i in (1, 4)]
                bits = [_held_bytes(batch.column(i)) for i in (2, 5)]
                words, keep = [_words(b) for b in bits], np.zeros(batch.num_rows, dtype=bool)
                for u, v in np.unique(np.stack(words), axis=1).T:
                    at = np.flatnonzero((words[0] == u) & (words[1] == v))
                    keep[at] = within_bounds(n[0][at], n[1][at], *[folded(b[at], min(u, v)) for b in bits], percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _tile_pairs(percent: int):
    """Rows tile, side, short, n, component, bits sorted by tile: the pairs of components that the bounds leave together.

    Side 0 meets side 1, or itself where a tile has one side; a tile has at most 2 * TILE rows.
    """

    def products(tile, side, short, n, component, sketches):
        out_a, out_b, words = [component[:0]], [component[:0]], _words(sketches)
        bits = np.zeros((len(sketches), SKETCH // 64), np.uint64)
        bits[words == SKETCH // 64] = folded(sketches[words == SKETCH // 64], SKETCH // 64) if (words == SKETCH // 64).any() else 0
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        for lo, hi in zip(first, [*first[1:], len(tile)]):
            left = np.arange(lo, hi)
            right = left[side[lo:hi] == 1]
            left = left[side[lo:hi] == 0]
            few = (words[lo:hi] == SKETCH // 64).all()
            for i in range(0, len(left), 64):
                x = left[i : i + 64]
                y = right if len(right) else left[i:]
                if few:
                    ok = within_bounds(n[x][:, None], n[y], bits[x][:, None], bits[y], percent)
                else:
                    ok = can_link(n[x], sketches[x], n[y], sketches[y], percent)
                ok &= component[x][:, None] != component[y]
                j, k = np.nonzero(ok)
                out_a.append(component[x[j]])
                out_b.append(component[y[k]])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches):
        rest = None  # the last tile of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(5)] + [_held_bytes(batch.column(5))]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[cut:] for c in cols]
            if cut:
                yield products(*[c[:cut] for c in cols])
        if rest is not None:
            yield products(*rest)

    return run


def products(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The same overlap counts as ``overlaps``, for rows that share most columns: dense slices of columns."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    cols = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(r) for r in x]) for x in (left, right)]
    both = np.intersect1d(*cols)
    at = [np.searchsorted(both, c) for c in cols]
    held = [np.flatnonzero(both[np.minimum(a, len(both) - 1)] == c) if len(both) else a[:0] for a, c in zip(at, cols)]
    order = [h[np.argsort(a[h], kind="stable")] for a, h in zip(at, held)]
    for begin in range(0, len(both), COLUMNS):
        dense = []
        for s, x in enumerate((left, right)):
            lo, hi = np.searchsorted(at[s][order[s]], [begin, begin + COLUMNS])
            some = order[s][lo:hi]
            m = np.zeros((len(x), min(COLUMNS, len(both) - begin)), dtype=np.float32)
            m[rows[s][some], at[s][some] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], ok: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs ``ok`` (a matrix) link."""
    i, j = np.nonzero(ok)
    if len(i) <= 64:
        both = np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    else:
        both = products(left, right)[i, j]
    size = np.array([len(r) for r in left])[i] + np.array([len(r) for r in right])[j]
    out = np.zeros(ok.shape, dtype=bool)
    out[i, j] = 100 * both >= percent * (size - both)
    return out


def stars(link: np.ndarray, same: bool) -> np.ndarray:
    """For the rows of a tile (of one side, then of the other) the first row that their links reach within it."""
    if same:
        link = link | link.T
    n, none = link.shape, sum(link.shape)
    x, y = np.arange(n[0]), np.arange(n[1]) + (0 if same else n[0])
    while True:
        new_x = np.minimum(x, np.where(link, y, none).min(axis=1, initial=none))
        if same:
            new_y = new_x = new_x[new_x]
        else:
            new_y = np.minimum(y, np.where(link.T, new_x, none).min(axis=1, initial=none))
        if (new_x == x).all() and (new_y == y).all():
            return x if same else np.concatenate([x, y])
        x, y = new_x, new_y


def _count_links(percent: int):
    """Rows component, lo, hi, side, short, copies, n, grams sorted by tile (the first three): a, b, links.

    Side 0 meets side 1, or itself where lo = hi.  Rows out: links counted at a, or (b not null) a link.
    """

    def tile(same, side, short, copies, n, grams):
        # repeated rows of one id bring their set again
        once = np.unique(np.stack([side, short]), axis=1, return_index=True)[1]
        side, short, copies, n, grams = (c[once] for c in (side, short, copies, n, grams))
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        bits = np.array([sketch(s) for s in sets] + [None], dtype=object)[:-1]
        of = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
        x, y = (of[0], of[0]) if same else of
        links = np.zeros(len(short), np.int64)
        ok = can_link(n[x], bits[x], n[y], bits[y], percent)
        if same:
            ok = np.triu(ok, 1)
        some = np.zeros(0, np.int64)
        first = some
        if ok.any():
            link = linked([sets[i] for i in x], [sets[i] for i in y], ok, percent)
            links[x] += link @ copies[y]
            links[y] += copies[x] @ link
            rows = x if same else np.concatenate([x, y])
            to = stars(link, same)
            moved = np.flatnonzero(to != np.arange(len(to)))
            some, first = short[rows[moved]], short[rows[to[moved]]]
        counted = np.flatnonzero(links)
        b = pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(first)])
        n_out = np.concatenate([links[counted], np.zeros(len(some), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([short[counted], some])), b, pa.array(n_out)], names=["a", "b", "links"])

    def run(batches):
        rest = None  # the last tile of a batch may go on in the next
        done = lambda c: tile(c[1][0] == c[2][0], *c[3:])
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(7)] + [_held_bytes(batch.column(7))]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            if rest is not None:
                if all(r[0] == c[0] for r, c in zip(rest[:3], cols)):
                    end = int(new[0]) if len(new) else batch.num_rows
                    rest = [np.concatenate([r, c[:end]]) for r, c in zip(rest, cols)]
                    cols, new = [c[end:] for c in cols], new[1:] - end
                if not len(cols[0]):
                    continue
                yield done(rest)
            ends = [0, *new.tolist(), len(cols[0])]
            for lo, hi in zip(ends[:-2], ends[1:-1]):
                yield done([c[lo:hi] for c in cols])
            rest = [c[ends[-2] :].copy() for c in cols]
        if rest is not None:
            yield done(rest)

    return run


# ---------------------------------------------------------------- the join

def join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, n_shingles, n_links (other rows it links with) and component_id (smallest id reachable by links) of every row; ids are integers."""
    with Given(scratch, docs.sparkSession, "jaccard", tidy=True) as run:
        rows, classes = _classes(docs, width, percent, id_col, text_col, run)
        joined = join_with_hot(rows, classes.drop("class", "members"), "set", F.col("copies"), rows.count())
        out = joined.select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
        return out if scratch else run.settled(out)[0]


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (id, told: a hash of the text, set, n), and for every set: copies, n_links, and its class with component_id and members."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("told"), F.col(text_col).cast("string").alias("text"))
    matrix = scratch.write(texts.mapInArrow(_matrix(width, percent), _MATRIX), "matrix")
    sets = scratch.write(
        matrix.filter("n > 0").groupBy("set").agg(
            F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "told")).alias("at"), F.count(F.lit(1)).alias("copies"),
            F.first("short").alias("short"), F.first("n").alias("n"), F.first("sketch", True).alias("sketch"),
        ),
        "sets",
    )
    met = scratch.write(_meetings(matrix), "met")
    rows = scratch.write(matrix.select("id", "told", "set", "n"), "rows")
    scratch.remove("matrix")  # most of it is what was offered
    known = sets.select("short", "n", "sketch")
    groups = connected_components(_centre_pairs(met, known, percent), scratch, "near")
    more = scratch.write(_open_pairs(met, groups, known, percent).distinct(), "more")
    if not more.isEmpty():
        joined = connected_components(more, scratch, "open")
        nodes = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
        alone = nodes.join(groups, "node", "left_anti").select("node", F.col("node").alias("component"))
        to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        groups = groups.unionByName(alone).join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    found = scratch.write(_links(texts, sets, groups, width, percent, scratch), "found")
    links = found.filter("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("b is not null").select("a", "b"), scratch, "all")
    parts = sets.join(links.withColumnRenamed("a", "short"), "short", "left").join(components.withColumnRenamed("node", "short"), "short", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    parts = scratch.write(parts.select("set", "short", "rep", "copies", "component", n_links.alias("n_links")), "parts")
    least = parts.filter("component is not null").groupBy("component").agg(
        F.min("rep").alias("least"), F.count(F.lit(1)).alias("sets"), F.sum("copies").alias("members")
    )
    classes = join_with_hot(parts, least, "component", F.col("sets"), sets.count()).select(
        "set", "copies", "n_links", F.coalesce("component", "short").alias("class"), F.coalesce("least", "rep").alias("component_id"),
        F.coalesce("members", "copies").alias("members"),
    )
    return rows, scratch.write(classes, "classes")


def _meetings(matrix: DataFrame) -> DataFrame:
    """block, short, centre of every row in a block of several rows."""
    by_block = Window.partitionBy("block")  # a block is there once a slice at most
    offered = matrix.select("short", F.explode("offered").alias("block"))
    across = offered.select("block", "short", F.min("short").over(by_block).alias("centre"), F.max("short").over(by_block).alias("last"))
    within = matrix.select("short", F.inline(F.arrays_zip(F.col("met").alias("block"), F.col("centres").alias("centre"))))
    return across.filter("centre <> last").select("block", "short", "centre").unionByName(within.select("block", "short", "centre"))


def _centre_pairs(met: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Each row with the centres of its blocks, where the bounds allow a link."""
    pairs = met.filter("short <> centre").select(F.col("short").alias("a"), F.col("centre").alias("b")).distinct()
    of = lambda side: known.select(F.col("short").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"bits_{side}"))
    bounded = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "n_a", "bits_a", "b", "n_b", "bits_b")
    return bounded.mapInArrow(_bounded_pairs(percent), "a long, b long")


def _open_pairs(met: DataFrame, groups: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that meet in blocks of three rows and more, where the bounds allow a link."""
    members = met.select("block", "short").distinct()
    labelled = members.join(groups.withColumnRenamed("node", "short"), "short", "left").withColumn("component", F.coalesce("component", "short"))
    blocks = labelled.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    # a block of two rows has been met as a row and its centre; a block of several tiles is sent to each of them
    parts = F.ceil(F.col("size") / TILE).cast("int")
    some = blocks.filter("lo <> hi and size > 2").select("block", parts.alias("parts"))
    part = F.pmod(F.xxhash64("short"), F.col("parts")).cast("int")
    dealt = labelled.join(some, "block").select("*", part.alias("part")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other")).alias("tile")
    tiles = dealt.select(tile, (F.col("part") > F.col("other")).cast("int").alias("side"), "short", "component").join(known, "short")
    tiles = tiles.select("tile", "side", "short", "n", "component", "sketch").repartition("tile").sortWithinPartitions("tile", "side", "short")
    return tiles.mapInArrow(_tile_pairs(percent), "a long, b long")


def _fetch(width: int):
    """Rows of text, set, short and other columns to all but the first two and grams, where the text has that set; of repeated rows one a task."""

    def run(batches):
        hashes, met = WordHashes(), set()
        for batch in batches:
            if len(met) > OFFERED_SETS:
                met.clear()
            new = []
            for short in batch.column(2).to_pylist():
                new.append(short not in met)
                met.add(short)
            for part, texts in in_slices(batch.filter(pa.array(new, pa.bool_())), 0, CHUNK_BYTES):
                rows = _rows_of(texts, width, hashes)
                same = pa.array([digest(r) == s for r, s in zip(rows, part.column(1).to_pylist())], pa.bool_())
                grams = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[2:], grams], names=[*part.schema.names[2:], "grams"]).filter(same)

    return run


def _held(texts: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """The texts of the wanted sets: each set names one row by id and hash, so rows that share an id are not met."""
    wanted = wanted.withColumnsRenamed({"id": "at_id", "told": "at_told"})
    met = F.col("id").eqNullSafe(F.col("at_id")) & F.col("told").eqNullSafe(F.col("at_told"))
    return texts.join(F.broadcast(wanted) if few else wanted, met).select("text", "set", "short", *[c for c in wanted.columns if c not in ("at_id", "at_told", "set", "short")])


def _links(texts: DataFrame, sets: DataFrame, groups: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """a, b, links: how many documents of other sets the set a links with in a tile, or (b not null) a link."""
    members = scratch.write(groups.withColumnRenamed("node", "short").join(sets, "short"), "group-members")
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("entries"))
    parts = F.greatest(F.ceil(F.col("size") / COUNTED), F.ceil(F.col("entries") / ENTRIES)).cast("int")
    total = members.count()
    sized = join_with_hot(members, size.select("component", "size", parts.alias("parts")), "component", F.col("size"), total)
    part = F.pmod(F.xxhash64("short"), F.col("parts")).cast("int").alias("part")
    wanted = sized.select("at.id", "at.told", "set", "short", "component", "parts", part, "copies", "n")  # sketches are made anew
    kinds = "short long, component long, parts int, part int, copies long, n long"
    fetched = _held(texts, wanted, total <= BROADCAST_ROWS).mapInArrow(_fetch(width), f"{kinds}, grams binary")
    dealt = fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.select(
        "component", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).cast("int").alias("side"),
        "short", "copies", "n", "grams",
    )
    tiles = tiles.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "side", "short")
    return tiles.mapInArrow(_count_links(percent), "a long, b long, links long")


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Of each component the row of the smallest id (of equal ids, of the smallest text digest), all columns as they are.

    Of rows without words, and of rows that repeat id and text, every wordless one and one of the repeats stays.
    """
    with Given(scratch, docs.sparkSession, "keep", tidy=True) as run:
        rows, classes = _classes(docs, width, percent, id_col, text_col, run)
        several = classes.filter("members > 1")
        named = join_with_hot(rows, several.select("set", "class", "copies"), "set", F.col("copies"), rows.count())
        named = run.write(named.filter("class is not null").groupBy("class", "id", "told").agg(F.count(F.lit(1)).alias("repeats")), "named")
        order = F.struct(F.col("id").isNull().alias("lost"), "id", "told")
        best = named.groupBy("class").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size"))
        judged = run.write(
            join_with_hot(named, best, "class", F.col("size"), named.count()).select("id", "told", "repeats", (order == F.col("best")).alias("stays")), "judged"
        )
        gone = judged.filter(~F.coalesce("stays", F.lit(False))).select("id", "told")
        repeated = judged.filter("stays and repeats > 1").select("id", "told")
        if not scratch:
            gone, repeated = run.settled(gone, repeated)
    told = fresh(docs, "told")
    marked = docs.withColumn(told, F.xxhash64(text_col))

    def matched(to: DataFrame, how: str, of: DataFrame) -> DataFrame:
        held = F.broadcast(to) if to.count() <= BROADCAST_ROWS else to
        return of.join(held, of[id_col].cast("long").eqNullSafe(held["id"]) & of[told].eqNullSafe(held["told"]), how)

    kept = matched(gone, "left_anti", marked)
    if not repeated.isEmpty():
        kept = matched(repeated, "left_anti", kept).unionByName(matched(repeated, "left_semi", kept).dropDuplicates([id_col, told]))
    return kept.select(*docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def op8_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """Only the counts."""
    return op8_jaccard_join(spark, sf_dir).select("doc_id", "n_links", "n_shingles", "component_id")
