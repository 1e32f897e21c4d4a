"""Exact near-duplicate vectors: cover trees and their dual traversal.

Vectors of one label link when their cosine is at least ``threshold``, that is when their unit
vectors are no farther than t = sqrt(2 - 2 threshold) apart.  Vectors are compared with vectors of
their label and dimension only; equal vectors are one point with a weight.

1. Top levels.  About sqrt(N) of all N points are pivots, chosen by a hash.  Every point goes to the
   nearest pivot of its label, and there to the level of its distance, levels halving towards the
   pivot: a region.  The pivots of a label are put in the order of a cover tree over them, so that
   regions that follow one another lie close together, and runs of regions become groups of at most
   about ``group_points`` points.  A label without a pivot is cut into groups by hash.
2. One cover tree is built for each group and written beside its points: nested nets of halving
   radii, with the covering radii as measured.
3. Two regions whose bounds keep all points farther than t are pruned; groups without a pair of
   regions left never meet.  Where the bounds keep all points of two large regions within t, every
   pair links and is counted without being looked at, which is what large groups of near copies
   come to.
4. For every other pair of groups the two trees are descended at once: node pairs farther than t
   and both covering radii are pruned, node pairs within t are counted whole, and the leaves that
   remain are compared in double precision.  A pair of groups gives link counts and a spanning set
   of links, never all pairs.  Pairs are dealt in tiles of groups by groups, so that a group is sent
   once a tile and not once a pair.

Pivots and the regions around them steer the cost, never the result.  They grow with the square
root of the table; a sample that would pass PIVOT_BYTES is thinned.  Points without structure (far
from each other in many dimensions) cannot be pruned above the leaves by any metric tree: within
a label the work is then that of the matrix product, shared out over pairs of groups.

Defined cases: a null label, and a null, empty or zero vector or one with null or non-finite
components, links with nothing; equal vectors link; repeated rows are equal vectors; an empty
table gives no rows; other columns are ignored, whatever their names.  Labels are compared as they
are (any atomic type).  ``vec_id`` is taken as the name of a vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Given, Scratch, join_with_hot, table
from .components import connected_components

#: Points of a leaf; candidates of a net and nodes of a traversal that are looked at together.
LEAF, CHUNK = 32, 256
#: Points and numbers of one group at most (a group is one task's work for a tree).
GROUP, GROUP_VALUES = 2048, 1 << 20
#: Groups on a side of a tile at most: a task holds twice as many, with their trees.
SIDE = 8
#: Bytes of pivots that are collected and broadcast at most.
PIVOT_BYTES = 64 << 20
#: Levels of halving radii around a pivot.
LEVELS = 7
#: Distances come from products in double precision: sqrt(2 - 2 x) is good to about 2e-8.
_SLACK = 1e-6


def group_points(dim: int) -> int:
    return max(256, min(GROUP, GROUP_VALUES // max(1, dim))) if GROUP >= 256 else GROUP


# ---------------------------------------------------------------- cover trees

class Tree:
    """Nodes as arrays over points in the order of the tree.

    A node holds the points ``start`` to ``stop``, the first of which is its centre; ``radius`` is the
    distance of the farthest; its children are the nodes ``low`` to ``high`` (none: a leaf).
    """

    def __init__(self, nodes: np.ndarray, radius: np.ndarray):
        self.nodes, self.radius = nodes, radius
        self.start, self.stop, self.low, self.high = nodes
        self.single = self.stop - self.start == 1

    def children(self, i: int) -> np.ndarray:
        return np.arange(self.low[i], self.high[i])


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def nets(unit: np.ndarray, points: np.ndarray, reach: float) -> list[np.ndarray]:
    """Parts of ``points`` within ``reach`` of their first points, which are farther than it from each other.

    The first point that no centre covers is the next centre; a point goes to the first that covers it.
    """
    least, out, rest = 1 - reach * reach / 2, [], points
    while len(rest):
        head = rest[:CHUNK]
        near = unit[head] @ unit[head].T >= least
        free, centres = np.ones(len(head), bool), []
        for i in range(len(head)):
            if free[i]:
                centres.append(i)
                free &= ~near[i]
        covered = unit[head[centres]] @ unit[rest].T >= least
        covered[:, centres] = np.eye(len(centres), dtype=bool)
        covered[:, : len(head)] |= near[centres] & ~np.isin(np.arange(len(head)), centres)
        first, some = covered.argmax(axis=0), covered.any(axis=0)
        first[~some] = len(centres)
        order = np.argsort(first, kind="stable")
        ends = np.searchsorted(first[order], np.arange(len(centres) + 1))
        for k, c in enumerate(centres):
            own = order[ends[k] : ends[k + 1]]
            out.append(np.concatenate([[rest[c]], rest[own[own != c]]]))
        rest = rest[~some]
    return out


def build(unit: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order of the points and the cover tree: the children of a node are a net of the next halved radius."""
    order = np.arange(len(unit))
    start, stop, low, high = [0], [len(unit)], [], []
    radius = [float(_distance(unit @ unit[0]).max()) if len(unit) else 0.0]
    i = 0
    while i < len(start):
        low.append(len(start))
        if stop[i] - start[i] > LEAF and radius[i] > _SLACK:
            reach = 2.0 ** (math.ceil(math.log2(radius[i])) - 1)
            at = start[i]
            parts = nets(unit, order[start[i] : stop[i]].copy(), reach)
            for part in parts if len(parts) > 1 else ():
                order[at : at + len(part)] = part
                start.append(at)
                at += len(part)
                stop.append(at)
                radius.append(float(_distance(unit[part] @ unit[part[0]]).max()) if len(part) > 1 else 0.0)
        high.append(len(start))
        i += 1
    return order, Tree(np.array([start, stop, low, high], np.int32), np.array(radius))


def dual(a: Tree, x: np.ndarray, b: Tree, y: np.ndarray, same: bool, threshold: float):
    """Yield (points of x, points of y, mask) of pairs that link; mask None: all of them, "each": pair by pair.

    With ``same`` both trees are one, and each unordered pair of points is met once; a mask of the
    points of one node with themselves is whole.
    """
    t = math.sqrt(2 - 2 * threshold)
    stack = [(0, 0)] if len(x) and len(y) else []
    while stack:
        p, q = stack.pop()
        leaf_p, leaf_q = a.low[p] == a.high[p], b.low[q] == b.high[q]
        if leaf_p and leaf_q:
            i, j = np.arange(a.start[p], a.stop[p]), np.arange(b.start[q], b.stop[q])
            yield i, j, x[i] @ y[j].T >= threshold
            continue
        itself = same and p == q
        own = a.children(p) if itself or not leaf_p and (leaf_q or a.radius[p] >= b.radius[q]) else np.array([p])
        other = b.children(q) if itself or not leaf_q and (leaf_p or b.radius[q] >= a.radius[p]) else np.array([q])
        for begin in range(0, len(own), CHUNK):
            part = own[begin : begin + CHUNK]
            dots = x[a.start[part]] @ y[b.start[other]].T
            gap, reach = _distance(dots), a.radius[part][:, None] + b.radius[other]
            open_ = gap <= reach + t + _SLACK
            if itself:
                open_ &= other >= part[:, None]
            one = a.single[part][:, None] & b.single[other]
            if itself:
                diagonal = part[:, None] == other
                open_ &= ~(one & diagonal)
                whole = open_ & ~diagonal & (gap + reach <= t - _SLACK) & ~one
            else:
                whole = open_ & (gap + reach <= t - _SLACK) & ~one
            i, j = np.nonzero(open_ & one & (dots >= threshold))
            if len(i):
                yield a.start[part[i]], b.start[other[j]], "each"
            for i, j in zip(*np.nonzero(whole)):
                p2, q2 = part[i], other[j]
                yield np.arange(a.start[p2], a.stop[p2]), np.arange(b.start[q2], b.stop[q2]), None
            stack += [(part[i], other[j]) for i, j in zip(*np.nonzero(open_ & ~one & ~whole))]


class _Parts:
    """Components of the points of a tile, and the links that made them."""

    def __init__(self, n: int, base: int):
        self.of, self.base, self.links = np.arange(n), base, []

    def tie(self, i: int, others: np.ndarray) -> None:
        """Point i of the left side links with ``others`` of the right one."""
        found, first = np.unique(self.of[others + self.base], return_index=True)
        new = found != self.of[i]
        if new.any():
            self.links += [(i, int(others[k])) for k in first[new]]
            joined = np.append(found[new], self.of[i])
            self.of[np.isin(self.of, joined)] = joined.min()


def compare(a: Tree, x: np.ndarray, wx: np.ndarray, b: Tree, y: np.ndarray, wy: np.ndarray, same: bool, threshold: float):
    """Weighted link counts of both sides, and a spanning set of links (i, j)."""
    n_x, n_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    parts = _Parts(len(x) + (0 if same else len(y)), 0 if same else len(x))
    for i, j, mask in dual(a, x, b, y, same, threshold):
        if mask is None:
            n_x[i] += wy[j].sum()
            n_y[j] += wx[i].sum()
            parts.tie(int(i[0]), j)
            for k in i[1:].tolist():
                parts.tie(k, j[:1])
        elif isinstance(mask, str):
            np.add.at(n_x, i, wy[j])
            np.add.at(n_y, j, wx[i])
            for k, m in zip(i.tolist(), j):
                parts.tie(k, np.array([m]))
        else:
            if same and i[0] == j[0]:
                mask = np.triu(mask, 1)
            n_x[i] += mask @ wy[j]
            n_y[j] += wx[i] @ mask
            for k in np.flatnonzero(mask.any(axis=1)):
                parts.tie(int(i[k]), j[mask[k]])
    return n_x, n_y, parts.links


# ---------------------------------------------------------------- points

def _units(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(vector, unit vector) of every usable one."""
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    ends = lists.offsets.to_numpy()
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    out: list = []
    for lo, hi, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), there.tolist()):
        v = flat[lo:hi]
        most = np.abs(v).max() if ok and hi > lo else 0.0
        if not (np.isfinite(most) and most > 0):
            out.append(None)
            continue
        u = v / most
        out.append((v, u / math.sqrt(u @ u)))
    return out


def _keyed(batches):
    for batch in batches:
        ids, vectors, labels = (batch.column(i) for i in range(3))
        found = [None if label is None else u for u, label in zip(_units(vectors), labels.to_pylist())]
        keys = [u and xxhash.xxh3_128_digest(u[0].tobytes() + f"\0{label}".encode()) for u, label in zip(found, labels.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                ids, labels, pa.array([u and len(u[0]) for u in found], pa.int32()), pa.array(keys, pa.binary()),
                pa.array([u and u[1].tobytes() for u in found], pa.binary()),
            ],
            names=["id", "label", "dim", "key", "unit"],
        )


def _stack(units: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), dim)


_PLACED = "key binary, rep long, copies long, label string, dim int, cell int, level int, gap double, unit binary"


def _placed(pivots):
    """Points with their nearest pivot (-1: their label has none) and the level of its distance."""

    def run(frames):
        for f in frames:
            cell, gap = np.full(len(f), -1, np.int32), np.zeros(len(f))
            for (label, dim), at in f.groupby(["label", "dim"]).indices.items():
                p = pivots.value.get((label, int(dim)))
                if p is not None:
                    u = _stack(f["unit"].iloc[at], dim)
                    cell[at] = (u @ p.T).argmax(axis=1)
                    gap[at] = np.linalg.norm(u - p[cell[at]], axis=1)
            level = np.clip(np.floor(1 - np.log2(np.maximum(gap, 1e-3))), 0, LEVELS - 1).astype(np.int32)
            yield f.assign(cell=cell, level=level, gap=gap)[["key", "rep", "copies", "label", "dim", "cell", "level", "gap", "unit"]]

    return run


# ---------------------------------------------------------------- regions and groups

class Regions:
    """The regions of one label around its pivots, in the order of a cover tree over the pivots.

    Region r has the groups ``first_group[r]`` and the ``parts[r]`` - 1 after it; regions of half a group and more
    (``large``) have groups of their own.
    """

    def __init__(self, pivots: np.ndarray, stats: pd.DataFrame):
        rank = np.empty(len(pivots), np.int64)
        rank[build(pivots)[0]] = np.arange(len(pivots))
        stats = stats.assign(rank=rank[stats["cell"]]).sort_values(["rank", "level"], kind="stable")
        self.cell, self.level = stats["cell"].to_numpy(), stats["level"].to_numpy()
        self.near, self.far = stats["near"].to_numpy(), stats["far"].to_numpy()
        self.weight, self.first = stats["weight"].to_numpy(), stats["first"].to_numpy()
        self.pivots = pivots
        size, most = stats["size"].to_numpy(), group_points(pivots.shape[1])
        self.large = size * 2 >= most
        self.parts = np.where(self.large, -(-size // most), 1)
        self.first_group = np.zeros(len(size), np.int64)
        group, room = -1, 0
        for r in range(len(size)):
            if self.large[r]:
                self.first_group[r], room = group + 1, 0
                group += int(self.parts[r])
            else:
                if room < size[r]:
                    group, room = group + 1, most
                self.first_group[r] = group
                room -= size[r]
        self.place = {k: r for r, k in enumerate(zip(self.cell.tolist(), self.level.tolist()))}

    def open_to(self, r: int, t: float) -> tuple[np.ndarray, np.ndarray]:
        """The regions from r on that are not pruned, and whether all pairs with them link."""
        rest = np.arange(r, len(self.cell))
        between = np.linalg.norm(self.pivots - self.pivots[self.cell[r]], axis=1)[self.cell[rest]]
        # |x - y| >= |p - q| - far - far; about one pivot, rings of it: >= near - far
        least = between - self.far[rest] - self.far[r]
        one = self.cell[rest] == self.cell[r]
        least[one] = np.maximum(self.near[rest] - self.far[r], self.near[r] - self.far[rest])[one]
        whole = (between + self.far[rest] + self.far[r] <= t - _SLACK) & self.large[rest] & self.large[r]
        keep = least <= t + _SLACK
        return rest[keep], whole[keep]


_MET = "label string, dim int, g long, h long, side long, r long, s long"


def _meetings(regions, t: float):
    """Rows label, dim, cell, level of regions: the pairs of groups they open, with the groups on a side of a tile, and the pairs of regions that link whole (r, s)."""

    def run(frames):
        for f in frames:
            out = []
            for label, dim, cell, level in zip(f["label"], f["dim"], f["cell"], f["level"]):
                held = regions.value[(label, int(dim))]
                r = held.place[(cell, level)]
                with_, whole = held.open_to(r, t)
                out += [(label, dim, None, None, None, r, s) for s in with_[whole].tolist()]
                side = tile_side(int(held.first_group[-1] + held.parts[-1]))
                met = set()
                for s in with_[~whole].tolist():
                    for g in range(held.first_group[r], held.first_group[r] + held.parts[r]):
                        met.update((min(g, h), max(g, h)) for h in range(held.first_group[s], held.first_group[s] + held.parts[s]))
                out += [(label, dim, g, h, side, None, None) for g, h in sorted(met)]
            frame = pd.DataFrame(out, columns=["label", "dim", "g", "h", "side", "r", "s"])
            yield frame.astype({"dim": "int32", **dict.fromkeys(("g", "h", "side", "r", "s"), "Int64")})

    return run


def _grouped(regions):
    """Adds the group of every point whose label has regions, and the number of its region."""

    def run(frames):
        for f in frames:
            group, region = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for (label, dim), at in f.groupby(["label", "dim"]).indices.items():
                held = regions.value[(label, int(dim))]
                r = np.array([held.place[k] for k in zip(f["cell"].iloc[at].tolist(), f["level"].iloc[at].tolist())])
                hashed = np.array([xxhash.xxh3_64_intdigest(k) % p for k, p in zip(f["key"].iloc[at], held.parts[r].tolist())])
                group[at], region[at] = held.first_group[r] + hashed, r
            yield f.assign(g=group, region=region)[["rep", "copies", "label", "dim", "unit", "g", "region"]]

    return run


_PACKED = "label string, dim int, g long, reps binary, copies binary, units binary, nodes binary, radii binary"


def _pack(f: pd.DataFrame) -> pd.DataFrame:
    """One row for a group: its points in the order of its tree, and the tree."""
    f = f.sort_values("rep")
    unit = _stack(f["unit"], int(f["dim"].iloc[0]))
    order, tree = build(unit)
    row = [f["label"].iloc[0], f["dim"].iloc[0], f["g"].iloc[0]]
    row += [f["rep"].to_numpy(np.int64)[order].tobytes(), f["copies"].to_numpy(np.int64)[order].tobytes(), unit[order].tobytes()]
    row += [tree.nodes.tobytes(), tree.radius.tobytes()]
    return pd.DataFrame([row], columns=["label", "dim", "g", "reps", "copies", "units", "nodes", "radii"])


def tile_side(groups: int) -> int:
    """Groups on a side of a tile, for a label of so many: each is sent once a tile, so about the square root of ``groups`` times up to SIDE."""
    return min(SIDE, max(1, math.isqrt(groups) // 2))


def _unpack(row: dict):
    reps, copies = (np.frombuffer(row[c], np.int64) for c in ("reps", "copies"))
    unit = np.frombuffer(row["units"], np.float64).reshape(len(reps), -1)
    tree = Tree(np.frombuffer(row["nodes"], np.int32).reshape(4, -1), np.frombuffer(row["radii"], np.float64))
    return reps, copies, unit, tree


_TILE = ("label", "dim", "first", "second")


def _tiles(threshold: float):
    """Packed groups sorted by tile, each with the groups there that it is to meet, to a, b, n: links counted at a, or a link."""

    def meet(held: dict[int, tuple], partners: dict[int, list[int]]):
        for g, others in partners.items():
            a, wx, x, tree = held[g]
            for h in others:
                b, wy, y, other = held[h]
                n_x, n_y, links = compare(tree, x, wx, other, y, wy, g == h, threshold)
                some, more = np.flatnonzero(n_x), np.flatnonzero(n_y)
                i, j = np.array(links, np.int64).reshape(-1, 2).T
                ends = np.concatenate([a[some], b[more], a[i]]), np.concatenate([n_x[some], n_y[more], np.zeros(len(i), np.int64)])
                to = pa.concat_arrays([pa.nulls(len(some) + len(more), pa.int64()), pa.array(b[j], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), to, pa.array(ends[1])], names=["a", "b", "n"])

    def run(batches):
        tile, held, partners = None, {}, {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if (own := tuple(row[c] for c in _TILE)) != tile:
                    yield from meet(held, partners)
                    tile, held, partners = own, {}, {}
                held[row["g"]], partners[row["g"]] = _unpack(row), row["partners"]
        yield from meet(held, partners)

    return run


# ---------------------------------------------------------------- the operator

def _label(rows: DataFrame, column: str):
    kind = rows.schema[column].dataType
    label = F.col(column) + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(column)  # -0.0 is 0.0
    return label.cast("string").alias("label")


def near_duplicates(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """id, n_links, component_id (smallest id reachable) and kept, for every row; ids are integers."""
    with Given(scratch, rows.sparkSession, "vectors") as run:
        found = _near_duplicates(rows, threshold, id_col, vector_col, label_col, run)
        return found if scratch else run.settled(found)[0]


def _near_duplicates(rows: DataFrame, threshold: float, id_col: str, vector_col: str, label_col: str, scratch: Scratch) -> DataFrame:
    spark = rows.sparkSession
    t = math.sqrt(2 - 2 * threshold)
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), _label(rows, label_col))
    keyed = scratch.write(vectors.mapInArrow(_keyed, "id long, label string, dim int, key binary, unit binary"), "keyed")
    ids = keyed.select("id", "key")

    held = _choose_pivots(keyed)
    pivots = spark.sparkContext.broadcast(held)
    points = keyed.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit")
    )
    placed = scratch.write(points.mapInPandas(_placed(pivots), _PLACED), "placed")

    # at most LEVELS regions a pivot
    own = placed.filter("cell >= 0").groupBy("label", "dim", "cell", "level").agg(
        F.count(F.lit(1)).alias("size"), F.sum("copies").alias("weight"), F.min("gap").alias("near"), F.max("gap").alias("far"), F.min("rep").alias("first")
    )
    stats = own.toPandas()
    by_label = {(k[0], int(k[1])): Regions(held[k], f) for k, f in stats.groupby(["label", "dim"])}
    regions = spark.sparkContext.broadcast(by_label)
    named = spark.createDataFrame(stats[["label", "dim", "cell", "level"]], "label string, dim int, cell int, level int")
    meetings = named.repartition(max(1, len(stats) // 500)).mapInPandas(_meetings(regions, t), _MET)
    met = scratch.write(meetings.distinct(), "met")

    # labels without a pivot: groups by hash, all of which meet
    plain = placed.filter("cell < 0")
    most = F.greatest(F.lit(min(256, GROUP)), F.least(F.lit(GROUP), F.floor(F.lit(GROUP_VALUES) / F.greatest("dim", F.lit(1)))))
    counts = plain.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("groups", F.ceil(F.col("n") / most).cast("long"))
    dealt = plain.join(counts.select("label", "dim", "groups"), ["label", "dim"]).select(
        "rep", "copies", "label", "dim", "unit", F.pmod(F.xxhash64("key"), F.col("groups")).alias("g")
    )
    numbers = lambda lo: F.explode(F.sequence(lo, F.col("groups") - 1))
    own_side = F.least(F.lit(SIDE), F.greatest(F.lit(1), F.floor(F.floor(F.sqrt("groups")) / 2))).cast("long").alias("side")
    pairs = counts.withColumn("g", numbers(F.lit(0).cast("long"))).withColumn("h", numbers(F.col("g"))).select("label", "dim", "g", "h", own_side)

    grouped = placed.filter("cell >= 0").mapInPandas(_grouped(regions), "rep long, copies long, label string, dim int, unit binary, g long, region long")
    all_groups = grouped.drop("region").unionByName(dealt)
    packed = scratch.write(all_groups.groupBy("label", "dim", "g").applyInPandas(_pack, _PACKED), "packed")
    tiled = met.filter("g is not null").select("label", "dim", "g", "h", "side").unionByName(pairs)
    # tiles of side by side groups: at most side * side pairs each
    by_tile = tiled.groupBy("label", "dim", F.expr("g div side").alias("first"), F.expr("h div side").alias("second")).agg(F.collect_list(F.struct("g", "h")).alias("pairs"))
    there = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["g"], p["h"]))))
    partners = F.transform(F.filter("pairs", lambda p: p["g"] == F.col("g")), lambda p: p["h"])
    sent = by_tile.withColumn("g", F.explode(there)).select(*_TILE, "g", partners.alias("partners"))
    work = sent.join(packed, ["label", "dim", "g"]).select(*_TILE, "g", "partners", *packed.columns[3:]).repartition(*_TILE).sortWithinPartitions(*_TILE, "g")
    compared = work.mapInArrow(_tiles(threshold), "a long, b long, n long")

    found = scratch.write(compared.unionByName(_whole(met, grouped, by_label)), "found")
    n_links = found.groupBy("a").agg(F.sum("n").alias("n"))
    components = connected_components(found.filter("b is not null").select("a", "b"), scratch, "near")
    by_key = (
        placed.select("key", "rep", "copies")
        .join(n_links.withColumnRenamed("a", "rep"), "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return join_with_hot(ids, by_key, "key", F.col("copies"), ids.count()).select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))


def _choose_pivots(keyed: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """About the square root of the points, by a hash of them, as unit vectors by label and dimension."""
    usable = keyed.filter("key is not null")
    n, size = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("unit")), F.lit(0))).first()
    rate = max(1, math.isqrt(n))
    rate = max(rate, math.ceil(size / PIVOT_BYTES))  # expected bytes: size / rate
    chosen = usable.filter(F.pmod(F.xxhash64("key"), F.lit(rate)) == 0).select("label", "dim", "key", "unit").dropDuplicates(["key"])
    held: dict[tuple[str, int], list] = {}
    for r in chosen.collect() if n > 1 else ():
        held.setdefault((r["label"], r["dim"]), []).append((bytes(r["key"]), np.frombuffer(bytes(r["unit"]), np.float64)))
    return {k: np.array([u for _, u in sorted(v, key=lambda x: x[0])]) for k, v in held.items()}


def _whole(met: DataFrame, grouped: DataFrame, by_label: dict[tuple[str, int], Regions]) -> DataFrame:
    """a, b, n of the pairs of regions all of whose points link: counts by weight, and a star of links."""
    spark = met.sparkSession
    told = [(*k, r, int(v.weight[r]), int(v.first[r])) for k, v in by_label.items() for r in np.flatnonzero(v.large).tolist()]
    large = spark.createDataFrame(told, "label string, dim int, region long, weight long, first long")
    pairs = met.filter("r is not null").select("label", "dim", "r", "s")
    both = pairs.select("label", "dim", F.col("r").alias("region"), F.col("s").alias("other")).unionByName(
        pairs.filter("r <> s").select("label", "dim", F.col("s").alias("region"), F.col("r").alias("other"))
    )
    stars = both.join(F.broadcast(large.withColumnRenamed("region", "other")), ["label", "dim", "other"])
    members = grouped.select("rep", "copies", "label", "dim", "region").join(stars, ["label", "dim", "region"])
    n = F.when(F.col("region") == F.col("other"), F.col("weight") - F.col("copies")).otherwise(F.col("weight"))
    return members.select(F.col("rep").alias("a"), F.col("first").alias("b"), n.alias("n"))


def op3_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
