"""Near duplicates among embeddings by dual traversal of cover trees.

Vectors of length one are alike by cosine if they are near: cosine 0.9 is a
distance of sqrt(0.2). A cover tree has a node at the root that covers all
its points, and on each further level nodes of half the radius that cover
the points of their parent, the first being the parent's own centre. Each
node knows the largest distance of its points, at most the radius.

1. Equal vectors form a class, which counts as often as it occurs.
2. The upper levels of one tree for all classes are built on the driver from
   a sample of about `SAMPLE` of them. Every class goes to its nearest centre.
   Neighbouring centres are put together into pieces of bounded size, and
   what one centre has beyond that is dealt over several pieces.
3. Each piece gets its own tree, down to the points, in a task.
4. Two pieces meet if some of their centres, less their farthest classes, may
   be near enough. There both trees are descended together. A pair of nodes
   is dropped if its centres are further apart than the limit and both
   covering radii, and linked as a whole if they are nearer than the limit
   less the radii. Between points the cosine itself decides.

A meeting returns for each linked class how many vectors it met and one class
that it is connected to, so a group of any size gives no more rows than it
has classes, for each piece they meet. Sums and components of these are
distributed. Pruning depends on the data: where all distances are alike, as
among random vectors, every pair of nodes of the first levels is looked at,
so time grows with the square of the groups.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components, and rows without an id, link with nothing and are
kept; shorter vectors count as filled with zeros; repeated rows are vectors
of their own, with equal results; an empty table has no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ship
from ledgerline.llm.near_dedup import components

COSINE = 0.9
#: Classes that give the upper levels, centres there at most, and classes of a piece.
SAMPLE, CENTRES, PIECE, LEAST_PIECE = 4096, 1024, 16_384, 512
#: Pieces that a smaller table is cut into.
_PIECES = 16
#: Nodes with fewer points have these as children; so have those of less than the least radius.
_LEAF, _LEAST_RADIUS = 16, 1e-3
#: Bounds and products within these are not trusted, in double and in single precision.
_SLACK, _SINGLE = 1e-7, 1e-5
_BLOCK, _PAIRS = 512, 16_384


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of length one."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the one that covers it; covering points are further apart than `radius`, the first is one."""
    covered = np.full(len(points), -1)
    for first in range(0, len(points), 256):
        some = np.arange(first, min(first + 256, len(points)))
        some, open_ = some[covered[some] < 0], np.flatnonzero(covered < 0)
        if not len(some):
            continue
        near = distances(points[some], points[open_]) <= radius
        for point, row in zip(some.tolist(), near, strict=True):
            if covered[point] < 0:
                covered[open_[row & (covered[open_] < 0)]] = point
                covered[point] = point
    return covered


class Tree:
    """Cover tree. Its points are in such an order that a node has consecutive ones, its centre first."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray):
        points = unit(raw)
        nodes, radius = [np.arange(len(raw))], 2.0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            far = [distances(points[own[:1]], points[own]).max() if len(own) > 1 else 0.0 for own in nodes]
            sizes = np.array([len(own) for own in nodes])
            # Rounded up, so that the bounds hold.
            reach = np.nextafter(np.array(far, np.float32), np.float32(9)) * (sizes > 1)
            self.levels.append(((np.cumsum(sizes) - sizes).astype(np.int32), reach.astype(np.float32)))
            if len(nodes) == len(raw):
                break
            radius, children = radius / 2, []
            for own, most in zip(nodes, far, strict=True):
                if len(own) > 1 and (len(own) <= _LEAF or radius < _LEAST_RADIUS):
                    children += [own[k : k + 1] for k in range(len(own))]
                elif most <= radius:
                    children.append(own)
                else:
                    covered = net(points[own], radius)
                    by = np.argsort(covered, kind="stable")
                    starts = np.flatnonzero(np.diff(covered[by], prepend=-1))
                    for one in np.split(by, starts[1:]):
                        centre = covered[one[0]]
                        children.append(own[np.concatenate([[centre], one[one != centre]])])
            nodes = children
        order = np.concatenate(nodes)
        self.ids, self.weights, self.raw = ids[order], weights[order], raw[order]

    def open(self) -> Tree:
        """Ready to be searched, after it has been sent."""
        self.points = unit(self.raw)
        self.single = self.points.astype(np.float32)
        return self

    def level(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and radii of the nodes of a level; the last one has all points."""
        return self.levels[min(number, len(self.levels) - 1)]

    def children(self, number: int, nodes: np.ndarray) -> np.ndarray:
        begins, next_ = self.level(number)[0], self.level(number + 1)[0]
        ends = np.append(begins[1:], len(self.raw))[nodes]
        first, last = np.searchsorted(next_, begins[nodes]), np.searchsorted(next_, ends)
        counts = last - first
        return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())

    def points_of(self, number: int, node: int) -> slice:
        begins = self.level(number)[0]
        return slice(begins[node], begins[node + 1] if node + 1 < len(begins) else len(self.raw))


class Labels:
    """Components of numbered things, the least number of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label != (top := self.label[self.label])).any():
                self.label = top


class Meeting:
    """Links between two trees, or within one."""

    def __init__(self, a: Tree, b: Tree, cosine: float):
        self.a, self.b, self.within = a, b, a is b
        self.cosine, self.limit = cosine, math.sqrt(2 - 2 * cosine)
        self.shift = 0 if self.within else len(a.ids)
        self.counts = np.zeros(self.shift + len(b.ids), np.int64)
        self.labels = Labels(len(self.counts))
        #: Pairs of nodes of which the distance was looked at closely.
        self.compared = 0
        stack = [(0, np.array([0]), np.array([0]))]
        while stack:
            level, left, right = stack.pop()
            stack += [(level + 1, a.children(level, i), b.children(level, j)) for i, j in self._nodes(level, left, right)]

    def _candidates(self, level: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes that may be near enough, by products in single precision."""
        (begin, reach), (other_begin, other_reach) = self.a.level(level), self.b.level(level)
        left = left[np.argsort(reach[left], kind="stable")]
        right = right[np.argsort(other_reach[right], kind="stable")]
        for first in range(0, len(left), _BLOCK):
            own = left[first : first + _BLOCK]
            for second in range(0, len(right), _BLOCK):
                other = right[second : second + _BLOCK]
                # Nodes come by radius, so the largest of a block is last.
                most = self.limit + float(reach[own[-1]]) + float(other_reach[other[-1]])
                least = 1 - min(most, 2.0) ** 2 / 2 - _SINGLE
                products = self.a.single[begin[own]] @ self.b.single[other_begin[other]].T
                i, j = np.nonzero(products >= least)
                i, j = own[i], other[j]
                if self.within:
                    i, j = i[i <= j], j[i <= j]
                for at in range(0, len(i), _PAIRS):
                    yield i[at : at + _PAIRS], j[at : at + _PAIRS]

    def _cosines(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found = np.einsum("ij,ij->i", self.a.points[i], self.b.points[j])
        for k in np.flatnonzero(np.abs(found - self.cosine) < 1e-9):
            x, y = self.a.raw[i[k]].astype(np.float64), self.b.raw[j[k]].astype(np.float64)
            with np.errstate(all="ignore"):
                exact = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))
            found[k] = exact if np.isfinite(exact) else found[k]
        return found

    def _nodes(self, level: int, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links what can be decided about pairs of these nodes; sets of nodes that all have to be opened against each other."""
        (begin, reach), (other_begin, other_reach) = self.a.level(level), self.b.level(level)
        found, open_ = [], []
        for i, j in self._candidates(level, left, right):
            cosine = self._cosines(begin[i], other_begin[j])
            distance = np.sqrt(np.maximum(0, 2 - 2 * cosine))
            both = reach[i].astype(np.float64) + other_reach[j]
            whole = (both > 0) & (distance + both <= self.limit - _SLACK)
            more = (both > 0) & ~whole & (distance <= self.limit + both + _SLACK)
            self.compared += len(i)
            open_.append(np.stack([i[more], j[more]]))
            found.append((i, j, (both == 0) & (cosine >= self.cosine), whole))
            if sum(pairs.shape[1] for pairs in open_) > 2 * (len(left) + len(right)):
                # Few bounds tell here: all children against all is quicker than pair by pair.
                return [(left, right)]
        for i, j, linked, whole in found:
            x, y = begin[i[linked]], other_begin[j[linked]]
            apart = x != y if self.within else np.ones(len(x), bool)
            self._link(x[apart], y[apart])
            for m, n in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
                self._link_all(self.a.points_of(level, m), self.b.points_of(level, n))
        i, j = np.concatenate(open_, axis=1) if open_ else np.empty((2, 0), int)
        if not len(i):
            return []
        turned = len(np.unique(i)) > len(np.unique(j))
        by, of = (j, i) if turned else (i, j)
        order = np.argsort(by, kind="stable")
        by, of = by[order], of[order]
        starts = np.flatnonzero(np.diff(by, prepend=-1))
        groups = [(by[s : s + 1], np.sort(some)) for s, some in zip(starts, np.split(of, starts[1:]), strict=True)]
        return [(some, one) for one, some in groups] if turned else groups

    def _link(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.counts, x, self.b.weights[y])
        np.add.at(self.counts, y + self.shift, self.a.weights[x])
        self.labels.join(x, y + self.shift)

    def _link_all(self, x: slice, y: slice) -> None:
        """All points of two nodes are linked, or all of one with each other."""
        self.labels.join(np.arange(x.start, x.stop), np.full(x.stop - x.start, y.start + self.shift))
        self.labels.join(np.arange(y.start, y.stop) + self.shift, np.full(y.stop - y.start, x.start))
        self.counts[x] += self.b.weights[y].sum()
        if self.within and x == y:
            self.counts[x] -= self.a.weights[x]
        else:
            self.counts[y.start + self.shift : y.stop + self.shift] += self.a.weights[x].sum()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked classes, how many vectors each met, and a class it is connected to."""
        ids = self.a.ids if self.within else np.concatenate([self.a.ids, self.b.ids])
        linked = np.flatnonzero(self.counts)
        return ids[linked], self.counts[linked], ids[self.labels.label[linked]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _assigner(centres, width: int):
    """Adds to each class its nearest centre and the distance to that, and packs the vector."""

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                some = batch.slice(first, 2048)
                raw = _matrix(some.column("x"), width)
                far = distances(unit(raw), centres.value)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("node"),
                        some.column("weight"),
                        pa.array([row.tobytes() for row in raw], pa.binary()),
                        pa.array(cell, pa.int64()),
                        pa.array(far[np.arange(len(cell)), cell], pa.float64()),
                    ],
                    ["node", "weight", "x", "cell", "far"],
                )

    return assigned


def _planter(kind: str):
    def planted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        raw = np.stack([np.frombuffer(x, kind) for x in frame["x"]])
        tree = pickle.dumps(Tree(frame["node"].to_numpy(), frame["weight"].to_numpy(), raw))
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "tree": [tree]})

    return planted


def _meeter(cosine: float):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a = pickle.loads(batch.column("left")[at].as_py()).open()
                same = batch.column("p")[at].as_py() == batch.column("q")[at].as_py()
                b = a if same else pickle.loads(batch.column("right")[at].as_py()).open()
                rows = Meeting(a, b, cosine).rows()
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["a", "links", "b"])

    return met


def _plan(cells: list, centres: np.ndarray, n: int, limit: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The pieces of each cell, and the pairs of cells that may have classes near enough.

    `cells`: cell, n and the largest distance, of each that has classes.
    """
    size = min(max(-(-n // _PIECES), LEAST_PIECE), PIECE)
    # Neighbours follow each other, by the nearest of a few centres.
    near = distances(centres, centres[:32]).argmin(1)
    cells = sorted(cells, key=lambda c: (near[c["cell"]], c["cell"]))
    plan, piece, room = [], 0, size
    for c in cells:
        own = -(-c["n"] // size)
        if own > 1 or c["n"] > room:
            piece, room = piece + (room < size), size
        plan.append((c["cell"], piece, own))
        piece, room = (piece + own, size) if own > 1 else (piece, room - c["n"])
    named = np.array([c["cell"] for c in cells])
    reach = np.array([c["far"] for c in cells])
    meet = distances(centres[named], centres[named]) <= limit + reach[:, None] + reach + _SLACK
    i, j = np.nonzero(meet)
    pairs = pd.DataFrame({"cell": named[i], "other": named[j]})
    return pd.DataFrame(plan, columns=["cell", "first", "pieces"]), pairs


def links(classes: DataFrame, kind: str, width: int, *, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """a, links, b for each class and meeting that links it: how many vectors, and a class connected to it.

    `classes`: node, x (array of numbers of numpy's `kind`), weight.
    """
    spark = classes.sparkSession
    n = classes.count()
    if not n:
        return classes.select(F.col("node").alias("a"), F.col("weight").alias("links"), F.col("node").alias("b"))
    spread = F.pmod(F.xxhash64(F.lit(11), "node"), F.lit(1 << 40))
    share = math.ceil(min(1.0, sample / n) * (1 << 40))
    some = classes.where(spread < share).select("x").toArrow().column("x").combine_chunks()
    # An unlucky sample may be empty; any direction is a centre.
    points = unit(_matrix(some, width)) if len(some) else np.eye(1, width)
    radius, centres = 1.0, np.unique(net(points, 1.0))
    while len(centres) < CENTRES and radius > _LEAST_RADIUS:
        radius /= 2
        finer = np.unique(net(points, radius))
        if len(finer) > CENTRES:
            break
        centres = finer
    centres = points[centres[:CENTRES]]
    shared = spark.sparkContext.broadcast(centres)
    placed = cut(classes.mapInArrow(_assigner(shared, width), "node bigint, weight bigint, x binary, cell bigint, far double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    plan, pairs = _plan(cells, centres, n, math.sqrt(2 - 2 * cosine))
    plan = spark.createDataFrame(plan, "cell bigint, first bigint, pieces bigint")
    pairs = spark.createDataFrame(pairs, "cell bigint, other bigint")
    number = F.col("first") + F.pmod(F.xxhash64(F.lit(12), "node"), F.col("pieces"))
    pieces = placed.join(F.broadcast(plan), "cell").select(number.alias("piece"), "node", "weight", "x")
    pieces = cut(pieces.groupBy("piece").applyInPandas(_planter(kind), "piece bigint, tree binary"))
    of_cells = plan.select("cell", F.explode(F.sequence("first", F.col("first") + F.col("pieces") - 1)).alias("p"))
    meetings = pairs.join(of_cells, "cell").join(of_cells.toDF("other", "q"), "other")
    meetings = cut(meetings.where(F.col("p") <= F.col("q")).select("p", "q").distinct())
    met = meetings.join(pieces.toDF("p", "left"), "p").join(pieces.toDF("q", "right"), "q")
    return cut(met.select("p", "q", "left", "right").mapInArrow(_meeter(cosine), "a bigint, links bigint, b bigint"))


def near_vectors(embeddings: DataFrame, *, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    ship(embeddings.sparkSession)
    given = embeddings.schema["embedding"].dataType.elementType.typeName()
    kind = "float" if given == "float" else "double"
    x = F.col("embedding").cast(f"array<{kind}>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & (F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(usable, x).alias("x"))
    # Vectors are equal if they have 128 bits in common.
    key = [F.xxhash64(F.lit(seed), "x").alias(f"key_{seed}") for seed in (0, 1)]
    rows = rows.select("vec_id", "x", *(F.when(F.col("x").isNotNull(), k).alias(f"key_{i}") for i, k in enumerate(key)))
    found = rows.where(F.col("x").isNotNull())
    classes = found.groupBy("key_0", "key_1").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.max("x").alias("x")
    )
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    width = classes.agg(F.max(F.size("x"))).first()[0] or 0
    linked = links(classes.select("node", "x", "weight"), "<f4" if kind == "float" else "<f8", width, cosine=cosine, sample=sample)
    counts = linked.groupBy(F.col("a").alias("counted")).agg(F.sum("links").alias("links"))
    roots = components(linked.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    members = classes.join(roots.toDF("named", "root"), F.col("node") == F.col("named"), "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    leads = members.groupBy(F.col("root").alias("led")).agg(F.min("least").alias("component_id"))
    members = members.join(leads, F.col("root") == F.col("led")).join(counts, F.col("node") == F.col("counted"), "left")
    total = F.col("weight") - 1 + F.coalesce("links", F.lit(0))
    members = cut(members.select(F.col("key_0").alias("k0"), F.col("key_1").alias("k1"), total.alias("n_links"), "component_id"))
    same = (F.col("key_0") == F.col("k0")) & (F.col("key_1") == F.col("k1"))
    met = rows.where(F.col("x").isNotNull()).join(members, same).select("vec_id", "n_links", "component_id")
    # Rows that link with nothing would share a key.
    alone = rows.where(F.col("x").isNull()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = met.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
