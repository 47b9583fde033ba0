"""Hard-negative mining by a GNAT-style multiway hyperplane tree.

Scores are integer inner products of scaled, floored vectors. For each anchor the best rows of its own label are its
positives; for each positive the best rows of other labels whose score lies in a band below the positive's score are
its hard negatives.

Tree: a bounded sample, the only thing sampled, gives the split points; a node has up to ``FANOUT`` of them and a row
goes to the nearest. All rows are routed, and for every split point and every sibling subtree the least and greatest
distance of that subtree's rows is kept, besides the range of their norms. A score within a band is a distance within an
annulus round the anchor (the width of which follows from the norms), so a subtree is eliminated when, by the triangle
inequality at any sibling's split point, its range does not meet the annulus. The rest is exact: the rows of the leaves
that are left are scored one by one, after the same test on runs of rows by their distance from the leaf's split point.
The annulus is narrowed by the sample beforehand: its k-th best fitting score is a lower bound of the k-th of all rows.

Spark: leaves are dealt to units of bounded size; a leaf above the bound is split over several, and a unit that more
queries visit than a task should take is given to several tasks. A unit's rows come first, then the queries that visit
it, streamed in blocks; only the best of each band leave a task. No pair is made of rows that no query asks for.

Defined cases: rows with a null id or label, or a null vector, or one holding nulls or non-finite components, or not of
the most frequent length, or of length zero, take no part, nor those whose squared integer norm is 2^56 or more (a score
times 100 would not fit a long); zero vectors do. Rows with equal ids each take part, and each is an anchor or a
candidate of its own, but never a partner of a row with its own id. Equal scores are ordered by id, equal ids follow in
any order. An anchor without other rows of its label has no positives, and a positive below 0 has an empty band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of the positive's.
BAND = (30, 90)
FANOUT = 16
# Rows of the sample that gives the split points, and its bytes.
SAMPLE, SAMPLE_BYTES = 16_384, 16_000_000
LEAF = 96
# Rows of a unit, and queries that one task takes for a unit.
UNIT, VISITS = 32_768, 16_384
# Queries that are compared with the sample at once, and queries and rows of a unit that are.
NARROWED, QUERIES, RUN = 64, 256, 512
_WIDE = 1 << 62
_SQUARE = 2.0**56
_KEPT = 200_000


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can be rounded, else in long integers."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    greatest = (x * x).sum(axis=1).max(initial=0.0) * (y * y).sum(axis=1).max(initial=0.0)
    if greatest < 2.0**104:
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.astype(np.int64), x.astype(np.int64))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _norms(a)[:, None] + _norms(b)[None, :] - 2 * _products(a, b)


def usable(rows: DataFrame, id_column: str, label_column: str, vector_column: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Stored rows (id, label, norm, v as packed integers) of the vectors that take part, and their length."""
    v = F.col("v")
    infinite = F.lit(float("inf"))
    rows = rows.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = lengths[0].n if lengths else 1
    rows = rows.where(F.size("v") == width)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * float(scale))
            with np.errstate(over="ignore"):
                fits = np.flatnonzero((x * x).sum(axis=1) < _SQUARE)
            x = x[fits].astype(np.int32)
            at = pa.array(fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(_norms(x)), pa.array([r.tobytes() for r in x], pa.binary())],
                ["id", "label", "norm", "v"],
            )

    return stored(rows.mapInArrow(packed, "id long, label long, norm long, v binary"), "vectors"), width


class Tree:
    """Split points by node, the children of each node (a node, or ~leaf) and the split point of each leaf."""

    def __init__(self, sample: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF) -> None:
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_points: list[np.ndarray] = []
        self.fanout = fanout
        # Members are distinct, so that every split point has a member and every split makes progress.
        members = np.unique(sample, axis=0)
        members = members[np.random.default_rng(0).permutation(len(members))]
        self._node(members, leaf)
        shape = (len(self.points), fanout, fanout)
        self.least, self.most = np.full(shape, np.inf), np.full(shape, -np.inf)
        self.norm_least, self.norm_most = np.full(shape[:2], np.inf), np.full(shape[:2], -np.inf)
        self.leaf_rows = np.zeros(len(self.leaf_points), np.int64)

    def _node(self, members: np.ndarray, leaf: int) -> int:
        """Split points: of a few members, each the farthest from those chosen before."""
        some = members[: 3 * self.fanout]
        chosen, near = [0], _squares(some, some[:1])[:, 0]
        while len(chosen) < self.fanout and near.max(initial=0) > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _squares(some, some[chosen[-1]][None])[:, 0])
        at = len(self.points)
        self.points.append(some[chosen])
        self.children.append([])
        nearest = _squares(members, self.points[at]).argmin(axis=1)
        for c in range(len(chosen)):
            own = members[nearest == c]
            if len(own) > leaf:
                self.children[at].append(self._node(own, leaf))
            else:
                self.children[at].append(~len(self.leaf_points))
                self.leaf_points.append(self.points[at][c])
        return at

    def route(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, child, rows that go there, their squared distances from all split points of the node)."""
        waiting = [(0, np.arange(len(x)))] if len(x) else []
        while waiting:
            node, rows = waiting.pop()
            squares = _squares(x[rows], self.points[node])
            nearest = squares.argmin(axis=1)
            for c, child in enumerate(self.children[node]):
                own = np.flatnonzero(nearest == c)
                if len(own):
                    yield node, c, rows[own], squares[own]
                    if child >= 0:
                        waiting.append((child, rows[own]))

    def alive(self, x: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Which leaves may hold rows that score within any band (lows, highs) of each query."""
        found = np.zeros((len(x), len(self.leaf_points)), bool)
        norms = _norms(x).astype(np.float64)
        waiting = [(0, np.arange(len(x)))] if len(x) else []
        while waiting:
            node, rows = waiting.pop()
            m = len(self.points[node])
            distance = np.sqrt(_squares(x[rows], self.points[node]).astype(np.float64))[:, :, None]
            least, most = np.sqrt(self.least[node, :m, :m]), np.sqrt(np.maximum(self.most[node, :m, :m], 0.0))
            with np.errstate(invalid="ignore"):
                nearest = np.maximum(distance - most, least - distance).max(axis=1)
                farthest = (distance + most).min(axis=1)
            for c, child in enumerate(self.children[node]):
                if self.norm_most[node, c] < 0:
                    continue
                meets = _meets(
                    nearest[:, c], farthest[:, c], norms[rows], self.norm_least[node, c], self.norm_most[node, c], lows[rows], highs[rows]
                )
                left = rows[meets]
                if len(left) and child >= 0:
                    waiting.append((child, left))
                elif len(left):
                    found[left, ~child] = True
        return found


def _meets(
    nearest: np.ndarray, farthest: np.ndarray, norms: np.ndarray, least: float, most: float, lows: np.ndarray, highs: np.ndarray
) -> np.ndarray:
    """Whether distances between ``nearest`` and ``farthest`` meet the annulus of any band, rounding allowed for."""
    slack = 1e-9 * (norms + most) + 1.0
    inner = norms[:, None] + least - 2.0 * highs
    outer = norms[:, None] + most - 2.0 * lows
    near = np.maximum(nearest, 0.0) ** 2 - slack
    far = farthest**2 + slack
    return ((lows <= highs) & (near[:, None] <= outer) & (far[:, None] >= inner)).any(axis=1)


def _sampled(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a bounded sample of rows: all rows of a table that is no larger."""
    rows = vectors.count()
    wanted = max(FANOUT, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
    chosen = vectors
    if rows > wanted:
        share = int(2**40 * min(1.0, 1.2 * wanted / rows))
        chosen = vectors.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)) < share)
    found = chosen.select("id", "label", "v").limit(wanted).collect()
    x = np.frombuffer(b"".join(r.v for r in found), np.int32).reshape(-1, width)
    return np.array([r.id for r in found], np.int64), np.array([r.label for r in found], np.int64), x


def _measure(vectors: DataFrame, tree: Tree, width: int) -> None:
    """Fill the tree's ranges from all rows; tasks send their least and greatest only."""
    nodes, fanout = len(tree.points), tree.fanout

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full((nodes, fanout, fanout), 1 << 62), np.full((nodes, fanout, fanout), -1)
        norm_least, norm_most = np.full((nodes, fanout), 1 << 62), np.full((nodes, fanout), -1)
        rows = np.zeros((nodes, fanout), np.int64)
        for batch in batches:
            x = _vectors(batch.column(1), width)
            norms = batch.column(0).to_numpy()
            for node, c, own, squares in tree.route(x):
                m = squares.shape[1]
                least[node, :m, c] = np.minimum(least[node, :m, c], squares.min(axis=0))
                most[node, :m, c] = np.maximum(most[node, :m, c], squares.max(axis=0))
                norm_least[node, c] = min(norm_least[node, c], norms[own].min())
                norm_most[node, c] = max(norm_most[node, c], norms[own].max())
                rows[node, c] += len(own)
        node, point, child = np.nonzero(most >= 0)
        columns = (
            node, point, child, least[node, point, child], most[node, point, child],
            norm_least[node, child], norm_most[node, child], rows[node, child],
        )
        names = ["node", "point", "child", "least", "most", "norm_least", "norm_most", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    kinds = ", ".join(f"{c} long" for c in ("node", "point", "child", "least", "most", "norm_least", "norm_most", "n"))
    found = vectors.select("norm", "v").mapInArrow(ranges, kinds).groupBy("node", "point", "child").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.min("norm_least").alias("norm_least"),
        F.max("norm_most").alias("norm_most"), F.sum("n").alias("n"),
    )
    for r in found.collect():
        tree.least[r.node, r.point, r.child], tree.most[r.node, r.point, r.child] = r.least, r.most
        tree.norm_least[r.node, r.child], tree.norm_most[r.node, r.child] = r.norm_least, r.norm_most
        child = tree.children[r.node][r.child]
        if child < 0:
            tree.leaf_rows[~child] = r.n


class Units:
    """Leaves dealt to groups: consecutive ones up to ``size`` rows, or one larger leaf in several parts."""

    def __init__(self, leaf_rows: np.ndarray, size: int) -> None:
        self.group = np.zeros(len(leaf_rows), np.int64)
        parts, held = [], size + 1
        for leaf, n in enumerate(leaf_rows.tolist()):
            if held + n > size:
                parts.append(1)
                held = 0
            self.group[leaf] = len(parts) - 1
            held += n
            parts[-1] = max(1, -(-held // size))
        self.parts = np.array(parts, np.int64)


class Index:
    """All rows routed to their leaves (unit group, part, leaf, squared distance from its split point, id, label, norm,
    v), the tree with its ranges, and the sample."""

    def __init__(self, vectors: DataFrame, width: int, fanout: int = FANOUT, leaf: int = LEAF, unit: int = UNIT) -> None:
        self.width = width
        self.sample = _sampled(vectors, width)
        self.rows = vectors
        if not len(self.sample[0]):
            return
        self.tree = tree = Tree(self.sample[2], fanout, leaf)
        _measure(vectors, tree, width)
        rows = int(tree.leaf_rows.sum())
        self.units = units = Units(tree.leaf_rows, min(unit, -(-rows // (2 * vectors.sparkSession.sparkContext.defaultParallelism))))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = TaskContext.get().partitionId() * 7919
            for batch in batches:
                x = _vectors(batch.column(3), width)
                at, square = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                for node, c, own, squares in tree.route(x):
                    if tree.children[node][c] < 0:
                        at[own], square[own] = ~tree.children[node][c], squares[:, c]
                part = (count + np.arange(len(x))) % units.parts[units.group[at]]
                count += len(x)
                arrays = [pa.array(units.group[at]), pa.array(part), pa.array(at), pa.array(square), *batch.columns]
                yield pa.RecordBatch.from_arrays(arrays, ["unit", "part", "leaf", "square", "id", "label", "norm", "v"])

        kinds = "unit long, part long, leaf long, square long, id long, label long, norm long, v binary"
        self.rows = stored(vectors.mapInArrow(routed, kinds), "routed")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """Rows (q, band, rank, id, score): the k best rows, of the query's label or of others, within each of its bands.

        ``queries`` are stored rows (q, id, label, v, lows, highs), the bands as arrays of equal lengths.
        """
        spark = queries.sparkSession
        if not len(self.sample[0]):
            return spark.createDataFrame([], "q long, band int, rank int, id long, score long")
        visits = stored(self._visits(queries, k, same), "visits")
        splits = {r.unit: -(-r.n // VISITS) for r in visits.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
        # One row for each group of leaves, of which there are at most as many as leaves of the sample's tree.
        plan = F.broadcast(spark.createDataFrame([(u, int(self.units.parts[u]), n) for u, n in splits.items()], "unit long, parts long, splits int"))
        none = F.lit(None)
        asked = visits.join(plan, "unit").select(
            "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            F.pmod(F.xxhash64("q"), F.col("splits")).cast("int").alias("split"), F.lit(1).alias("kind"), none.cast("long").alias("leaf"),
            "label", none.cast("long").alias("square"), "id", none.cast("long").alias("norm"), "v", "q", "lows", "highs", "leaves",
        )
        held = self.rows.join(plan, "unit").select(
            "unit", "part", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(0).alias("kind"), "leaf",
            "label", "square", "id", "norm", "v", none.cast("long").alias("q"),
            *(none.cast(f"array<{kind}>").alias(c) for c, kind in (("lows", "long"), ("highs", "long"), ("leaves", "int"))),
        )
        key = ("unit", "part", "split")
        met = held.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind", "leaf", "label", "square")
        best = met.mapInArrow(self._meeting(k, same), "q long, band int, id long, score long")
        rank = F.row_number().over(Window.partitionBy("q", "band").orderBy(F.desc("score"), "id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "band", "rank", "id", "score")

    def _visits(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """A row for each query and each group of leaves it has to visit, its bands narrowed by the sample."""
        tree, units, width = self.tree, self.units, self.width
        ids, labels, sample = self.sample

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, NARROWED):
                    batch = whole.slice(a, NARROWED)
                    own, label = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                    x = _vectors(batch.column(3), width)
                    lows, highs = _bands(batch.column(4), batch.column(5))
                    score = _products(x, sample)
                    fits = ((label[:, None] == labels) == same) & (own[:, None] != ids)
                    for band in range(lows.shape[1]):
                        within = np.where(fits & (score >= lows[:, band, None]) & (score <= highs[:, band, None]), score, -_WIDE)
                        if within.shape[1] >= k:
                            least = np.partition(within, -k, axis=1)[:, -k]
                            lows[:, band] = np.maximum(lows[:, band], least)
                    alive = tree.alive(x, lows, highs)
                    query, leaf = np.nonzero(alive)
                    unit = units.group[leaf]
                    first = np.flatnonzero(np.concatenate(([True], (np.diff(query) != 0) | (np.diff(unit) != 0)))) if len(query) else query
                    at = pa.array(query[first])
                    bounds = pa.array(np.append(first, len(leaf)), pa.int32())
                    kept = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * lows.shape[1]), pa.array(lows.ravel()))
                    upper = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * lows.shape[1]), pa.array(highs.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(unit[first]), *(batch.column(i).take(at) for i in range(4)), kept.take(at), upper.take(at),
                         pa.ListArray.from_arrays(bounds, pa.array(leaf.astype(np.int32)))],
                        ["unit", "q", "id", "label", "v", "lows", "highs", "leaves"],
                    )

        kinds = "unit long, q long, id long, label long, v binary, lows array<long>, highs array<long>, leaves array<int>"
        return queries.select("q", "id", "label", "v", "lows", "highs").mapInArrow(visit, kinds)

    def _meeting(self, k: int, same: bool):  # noqa: ANN202
        """Function over sorted rows: holds the rows of a unit and answers the queries that follow them."""
        tree, width = self.tree, self.width

        def answers(batch: pa.RecordBatch, held: list[np.ndarray]) -> pa.RecordBatch:
            leaf, label, square, id_, norm, x = held
            own, asked, query = batch.column(7).to_numpy(), batch.column(5).to_numpy(), batch.column(10).to_numpy()
            y = _vectors(batch.column(9), width)
            lows, highs = _bands(batch.column(11), batch.column(12))
            norms = _norms(y).astype(np.float64)
            leaves = batch.column(13)
            wanted = leaves.flatten().to_numpy()
            wanting = np.repeat(np.arange(len(y)), np.diff(leaves.offsets.to_numpy()))
            found: list[np.ndarray] = []
            size = 0
            bounds = np.flatnonzero(np.concatenate(([True], np.diff(leaf) != 0, [True])))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                visiting = wanting[wanted == leaf[a]]
                if not len(visiting):
                    continue
                distance = np.sqrt(_squares(y[visiting], tree.leaf_points[leaf[a]][None])[:, 0].astype(np.float64))
                for start in range(a, b, RUN):
                    stop = min(start + RUN, b)
                    near, far = np.sqrt(float(square[start:stop].min())), np.sqrt(float(square[start:stop].max()))
                    run_norms = norm[start:stop]
                    meets = _meets(
                        np.maximum(distance - far, near - distance), distance + far, norms[visiting],
                        float(run_norms.min()), float(run_norms.max()), lows[visiting], highs[visiting],
                    )
                    # Rows of a leaf are sorted by label.
                    if same:
                        meets &= (asked[visiting] >= label[start]) & (asked[visiting] <= label[stop - 1])
                    elif label[start] == label[stop - 1]:
                        meets &= asked[visiting] != label[start]
                    rows = visiting[meets]
                    if not len(rows):
                        continue
                    score = _products(y[rows], x[start:stop])
                    fits = ((asked[rows, None] == label[None, start:stop]) == same) & (own[rows, None] != id_[None, start:stop])
                    for band in range(lows.shape[1]):
                        i, j = np.nonzero(fits & (score >= lows[rows, band, None]) & (score <= highs[rows, band, None]))
                        if len(i):
                            found.append(np.stack((rows[i], np.full(len(i), band), score[i, j], id_[start + j])))
                            size += len(i)
                    if size > _KEPT:
                        found = [_first(np.concatenate(found, axis=1), k)]
                        size = found[0].shape[1]
            best = _first(np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1), k)
            return pa.RecordBatch.from_arrays(
                [pa.array(query[best[0]]), pa.array(best[1].astype(np.int32)), pa.array(best[3]), pa.array(best[2])], ["q", "band", "id", "score"]
            )

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit: tuple | None = None
            parts: list[list[np.ndarray]] = []
            held: list[np.ndarray] = []
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
                changes = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
                for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
                    if a == b:
                        continue
                    own = batch.slice(a, b - a)
                    if tuple(keys[:3, a]) != unit:
                        unit, parts, held = tuple(keys[:3, a]), [], []
                    if keys[3, a] == 0:
                        parts.append([own.column(i).to_numpy() for i in (4, 5, 6, 7, 8)] + [_vectors(own.column(9), width)])
                        continue
                    if parts:
                        held, parts = [np.concatenate(c) for c in zip(*parts, strict=True)], []
                    for at in range(0, own.num_rows if held else 0, QUERIES):
                        yield answers(own.slice(at, QUERIES), held)

        return meet


def _bands(lows: pa.Array, highs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bands as matrices; queries with fewer than others get empty ones."""
    low, high = lows.to_pylist(), highs.to_pylist()
    n = max(map(len, low), default=0)
    out = [np.array([r + [fill] * (n - len(r)) for r in rows], np.int64).reshape(len(rows), n) for rows, fill in ((low, 1), (high, 0))]
    return out[0], out[1]


def _first(found: np.ndarray, k: int) -> np.ndarray:
    """Of columns (query, band, score, id), the k best of each query and band."""
    found = found[:, np.lexsort((found[3], -found[2], found[1], found[0]))]
    n = found.shape[1]
    new = np.concatenate(([True], (np.diff(found[:2], axis=1) != 0).any(axis=0)))[:n]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return found[:, np.arange(n) - begin < k]


def _floor(value: Column, divisor: int) -> Column:
    """Whole quotient, rounded down."""
    rest = F.pmod(value, F.lit(divisor).cast("long"))
    return ((value - rest) / divisor).cast("long")


def mine(
    rows: DataFrame,
    is_anchor: Column | str,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
    **sizes: int,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. For each of an anchor's first ``positives`` rows of its label, the first
    ``negatives`` rows of other labels with band[0] * positive_score <= 100 * negative_score <= band[1] * positive_score.
    ``sizes`` are those of ``Index``.
    """
    vectors, width = usable(rows, id_column, label_column, vector_column)
    index = Index(vectors, width, **sizes)
    anchors = vectors.where(is_anchor).select(F.monotonically_increasing_id().alias("q"), "id", "label", "v")
    anchors = stored(anchors, "anchors")
    every = (F.array(F.lit(-_WIDE).cast("long")).alias("lows"), F.array(F.lit(_WIDE).cast("long")).alias("highs"))
    near = stored(index.search(anchors.select("*", *every), positives, same=True), "positives")
    ends = near.select(
        "q",
        F.struct(
            "rank",
            (-_floor(F.lit(-band[0]) * F.col("score"), 100)).alias("low"),
            _floor(F.lit(band[1]) * F.col("score"), 100).alias("high"),
        ).alias("end"),
    )
    # At most as many as positives were asked for.
    ends = ends.groupBy("q").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    asking = anchors.join(ends, "q").select("q", "id", "label", "v", F.col("ends.low").alias("lows"), F.col("ends.high").alias("highs"))
    found = stored(index.search(stored(asking, "asking"), negatives, same=False), "negatives")
    named = near.select(
        "q", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    out = found.join(named, ["q", "band"]).join(anchors.select("q", F.col("id").alias("anchor_id")), "q")
    return out.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
