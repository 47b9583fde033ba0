"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node (named by a 64-bit digest), which keeps as many of its smallest ids as a result can hold,
so copies cost nothing and cannot crowd a neighbourhood. The graph is built and searched on the original vectors, in
the precision they are given in; distances are double-precision, and so near or large vectors keep their order.

Build: nodes meet in the cells of their nearest pivots (a bounded sample of nodes, the only thing that is sampled;
all nodes are indexed) and take the best of their cell as first neighbours; cells above ``CELL`` members are split at
random. Then rounds of NN-descent as joins: a node's neighbours and some reverse ones meet at the node, and pairs of
them that are nearer than the farthest neighbour they have become neighbours, until few change. Only pairs with a new
member are compared, and only vectors of members move.

Search: all queries advance together. Each holds a pool of its nearest nodes so far; each round joins the nodes of
the pool that are not opened yet to their neighbours, and those not seen before to their vectors, until the pool is
open. The pool is the recall's parameter; ``tests/llm`` and the README hold measured recall against brute force. Where
all that a pool holds behind the last result ties with it, nodes outside may tie as well, and where the search ends with
a pool that is not full, nodes were out of reach: these queries are compared with all nodes in a scan.

Defined cases: vectors that are null, zero, hold nulls or non-finite components, or are not of the most frequent
length take no part; rows with equal ids take part each; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import sized, stored

NEIGHBOURS = 20
REVERSE = 20
ROUNDS = 4
# A round that changes less than this share of all neighbours is the last.
CHANGED = 0.02
CELL = 2048
CELLS_PER_NODE = 3
PIVOTS = 2048
POOL = 400
SEARCH_ROUNDS = 30
ENTRIES = 4
# Pairs whose squared distance is below this share of their squared norms are measured by differences.
CLOSE = 1e-7
# Queries of one scan, and bytes of query vectors that are broadcast.
SCANNED = 2048
BROADCAST_BYTES = 32_000_000


def _matrix(column: pa.Array, kind: type = np.int8) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows as doubles. Rows are moved near the origin first; where rounding of the product would
    still count, or it overflows, the differences themselves are squared."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    some = np.sort(b[:: max(1, len(b) // 15)], axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        x, y = a - some[len(some) // 2], b - some[len(some) // 2]
        norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
        d = norms - 2 * x @ y.T
        i, j = np.nonzero(~(d > CLOSE * norms))
        step = max(1, 4_000_000 // b.shape[1])
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            d[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return d


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows (id, node, vector as packed doubles) of the vectors that take part."""
    v = F.col("v")
    rows = rows.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    infinite = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)) & F.exists(v, lambda x: x != 0)
    rows = rows.where(v.isNotNull()).where(fine)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0].n if lengths else 0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            n = len(vectors)
            values = vectors.flatten().to_numpy().reshape(n, -1) + 0.0 if n else np.zeros((0, 1))
            out = [x.tobytes() for x in values]
            nodes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["id", "node", "vector"])

    return rows.mapInArrow(packed, f"id {dict(rows.dtypes)['id']}, node long, vector binary")


def _originals(vectors: DataFrame, kind: type) -> DataFrame:
    """Rows (node, code): the components as they were given, as floats or doubles."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _matrix(batch.column(1), np.float64).astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in codes], pa.binary())], ["node", "code"])

    return vectors.select("node", "vector").mapInArrow(coded, "node long, code binary")


def _codes(vectors: DataFrame) -> DataFrame:
    """Rows (node, code): components as signed bytes of one scale. One large component makes all others equal, so
    ``nearest`` does not use them; ``build`` takes them for vectors that are known to be even."""

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(_matrix(batch.column(0), np.float64)).max())])], ["m"])

    scale = vectors.select("vector").mapInArrow(largest, "m double").agg(F.max("m")).first()[0] or 1.0

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.rint(_matrix(batch.column(1), np.float64) / scale * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in codes], pa.binary())], ["node", "code"])

    return vectors.select("node", "vector").mapInArrow(coded, "node long, code binary")


def _nearest_pivots(rows: DataFrame, key: str, pivots: np.ndarray, many: int) -> DataFrame:
    """Rows (key, code, cell): the numbers of each row's nearest pivots."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                distance = _squares(_matrix(batch.column(1), pivots.dtype), pivots)
                n = min(many, len(pivots))
                cells = np.argpartition(distance, n - 1, axis=1)[:, :n]
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells.ravel())], [key, "code", "cell"])

    return rows.select(key, "code").mapInArrow(assign, f"{key} long, code binary, cell long")


def _first_graph(codes: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Rows (u, v, d): the best of each node's cells. Cells are streamed, and split where they are too large."""
    met = _nearest_pivots(codes, "node", pivots, CELLS_PER_NODE)
    parts = met.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    met = met.join(sized(stored(parts, "cells")), "cell").withColumn("part", F.expr("pmod(xxhash64(node, cell), parts)"))
    met = met.repartition("cell", "part").sortWithinPartitions("cell", "part").select("cell", "part", "node", "code")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, codes_ = None, [], []

        def best() -> pa.RecordBatch:
            own, x = np.array(nodes), np.frombuffer(b"".join(codes_), pivots.dtype).reshape(len(nodes), -1)
            n = min(k, len(own) - 1)
            found = []
            for a in range(0, len(own), 512):
                d = _squares(x[a : a + 512], x)
                d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                found.append((np.repeat(own[a : a + 512], n), own[near].ravel(), np.take_along_axis(d, near, axis=1).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["u", "v", "d"])

        for batch in batches:
            for cell, part, node, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != (cell, part):
                    if len(nodes) > 1:
                        yield best()
                    unit, nodes, codes_ = (cell, part), [], []
                nodes.append(node)
                codes_.append(code)
        if len(nodes) > 1:
            yield best()

    return _best(met.mapInArrow(link, "u long, v long, d double").withColumn("fresh", F.lit(True)), k)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; an edge found again is not fresh. One shuffle, by node."""
    single = edges.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return single.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _reverse(graph: DataFrame, most: int) -> DataFrame:
    """Rows (u, v, fresh) of reversed edges, of each node those of its ``most`` nearest."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))
    ranked = graph.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")


def _descend(graph: DataFrame, codes: DataFrame, k: int, reverse: int, kind: np.dtype) -> DataFrame:
    """Nearer pairs (u, v, d, fresh) among the members that meet at a node."""
    limits = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("limit"))
    members = graph.select("u", "v", "fresh").union(_reverse(graph, reverse)).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
    state = codes.join(limits.withColumnRenamed("u", "node"), "node", "left")
    rows = members.join(state, F.col("v") == F.col("node")).select("u", "node", "fresh", "code", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    rows = rows.repartition("u").sortWithinPartitions("u")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, []
        out: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def pairs() -> None:
            nonlocal waiting
            node = np.array([x[0] for x in held])
            fresh = np.array([x[1] for x in held])
            if not fresh.any():
                return
            x = np.frombuffer(b"".join(x[2] for x in held), kind).reshape(len(held), -1)
            limit = np.array([x[3] for x in held])
            d = _squares(x, x)
            nearer = (d < limit[:, None]) & (fresh[:, None] | fresh[None, :])
            np.fill_diagonal(nearer, False)
            a, b = np.nonzero(nearer)
            out.append((node[a], node[b], d[a, b]))
            waiting += len(a)

        def made() -> pa.RecordBatch:
            nonlocal waiting
            u, v, d = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            waiting = 0
            # The same pair is met at several nodes of a task.
            keep = np.unique(np.stack((u, v)), axis=1, return_index=True)[1]
            return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep]), pa.array(d[keep])], ["u", "v", "d"])

        for batch in batches:
            for u, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != centre:
                    if len(held) > 1:
                        pairs()
                    centre, held = u, []
                    if waiting > 500_000:
                        yield made()
                held.append(rest)
        if len(held) > 1:
            pairs()
        if out:
            yield made()

    return rows.mapInArrow(meet, "u long, v long, d double").withColumn("fresh", F.lit(True))


def build(codes: DataFrame, pivots: np.ndarray, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph, rows (u, v, d, fresh), of stored codes (node, code), which are of the type of the pivots."""
    graph = stored(_first_graph(codes, pivots, k), "graph")
    for _ in range(rounds):
        changed = graph.agg(F.avg(F.col("fresh").cast("int"))).first()[0] or 0.0
        if changed < CHANGED:
            break
        news = _descend(graph, codes, k, reverse, pivots.dtype)
        graph = stored(_best(graph.withColumn("fresh", F.lit(False)).union(news), k), "graph")
    return graph


def _update(queries_pool: DataFrame, pool: int) -> DataFrame:
    """Pools (q, seen, nodes, distances, opened) with found (node, d) taken in; ``opening`` are nodes to open next."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, seen, nodes, d, opened, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = {x["node"]: x["d"] for x in found or ()}
                ids = np.array([*nodes, *new], np.int64)
                distances = np.array([*d, *new.values()], np.float64)
                done = np.array([*opened, *([False] * len(new))], bool)
                order = np.lexsort((ids, distances))[:pool]
                opening = ids[order][~done[order]]
                rows.append((q, [*seen, *new], ids[order], distances[order], np.ones(len(order), bool), opening))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["q", "seen", "nodes", "distances", "opened", "opening"])

    return queries_pool.mapInArrow(update, "q long, seen array<long>, nodes array<long>, distances array<double>, opened array<boolean>, opening array<long>")


def _distances(wanted: DataFrame, codes: DataFrame, queries: DataFrame, kind: np.dtype) -> DataFrame:
    """Rows (q, node) with their distance, gathered by query as an array of (node, d)."""
    rows = wanted.join(codes, "node").join(queries, "q").select("q", "node", "code", "query_code")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column(2), kind).astype(np.float64), _matrix(batch.column(3), kind).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.cumsum((a - b) ** 2, axis=1)[:, -1])], ["q", "node", "d"])

    measured = rows.mapInArrow(measure, "q long, node long, d double")
    return measured.groupBy("q").agg(F.collect_list(F.struct("node", "d")).alias("found"))


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, entries: DataFrame, kind: np.dtype, reverse: int = REVERSE, pool: int = POOL) -> DataFrame:
    """Rows (q, node): the pool of each query after greedy search. ``queries`` is (q, query_code), ``entries`` (q, node)."""
    if (queries.agg(F.sum(F.length("query_code"))).first()[0] or 0) <= BROADCAST_BYTES:
        queries = F.broadcast(queries)
    edges = graph.select("u", "v").union(_reverse(graph, reverse).select("u", "v"))
    around = stored(edges.groupBy("u").agg(F.collect_set("v").alias("near")), "adjacency")
    start = queries.select("q").join(_distances(entries.distinct(), codes, queries, kind), "q", "left")
    empty = {"seen": "array<long>", "nodes": "array<long>", "distances": "array<double>", "opened": "array<boolean>"}
    pools = start.select("q", *(F.array().cast(t).alias(c) for c, t in empty.items()), "found")
    pools = stored(_update(pools, pool), "pools")
    for _ in range(SEARCH_ROUNDS):
        opening = pools.where(F.size("opening") > 0)
        if opening.isEmpty():
            break
        ways = opening.select("q", F.explode("opening").alias("u")).join(around, "u").select("q", F.explode("near").alias("node")).distinct()
        ways = ways.groupBy("q").agg(F.collect_list("node").alias("reached")).join(pools.select("q", "seen"), "q")
        wanted = ways.select("q", F.explode(F.array_except("reached", "seen")).alias("node"))
        found = _distances(wanted, codes, queries, kind)
        joined = pools.join(found, "q", "left").select("q", "seen", "nodes", "distances", "opened", "found")
        pools = stored(_update(joined, pool), "pools")
    return pools.select("q", F.explode("nodes").alias("node"))


def _scan(single: DataFrame, tied: DataFrame, k: int) -> DataFrame:
    """Rows (q, node, score): of each query (q, a) of ``tied`` and each task the k + 1 nearest of its nodes (id, node,
    vector), ties to the smaller id, by comparing all. Queries travel with the code, some at a time."""
    blocks = -(-tied.count() // SCANNED)
    found = None
    for block in range(blocks):
        rows = tied.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        names, points = np.array([r.q for r in rows]), np.array([np.frombuffer(r.a, np.float64) for r in rows])

        def compare(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, points: np.ndarray = points) -> Iterator[pa.RecordBatch]:
            d, nodes = np.zeros((len(points), 0)), np.zeros((len(points), 0), np.int64)
            for whole in batches:
                for a in range(0, whole.num_rows, 512):
                    batch = whole.slice(a, 512)
                    x = _matrix(batch.column(1), np.float64)
                    squares = np.zeros((len(points), len(x)))
                    for c in range(x.shape[1]):
                        squares += (points[:, c, None] - x[None, :, c]) ** 2
                    d = np.concatenate((d, np.sqrt(squares)), axis=1)
                    nodes = np.concatenate((nodes, np.broadcast_to(batch.column(0).to_numpy(), squares.shape)), axis=1)
                    # Rows come by id, so the first of equal ones has the smaller id.
                    first = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
                    d, nodes = np.take_along_axis(d, first, axis=1), np.take_along_axis(nodes, first, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, d.shape[1])), pa.array(nodes.ravel()), pa.array(d.ravel())], ["q", "node", "score"])

        ordered = single.sortWithinPartitions("id").select("node", "vector")
        one = stored(ordered.mapInArrow(compare, "q long, node long, score double"), "scan")
        found = one if found is None else found.union(one)
    return found


def nearest(
    rows: DataFrame, is_query: Column | str, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    pool: int = POOL, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS,
) -> DataFrame:
    """For each row of which ``is_query`` (of the column ``id``) holds: query_id, rank, vec_id, score (Euclidean
    distance) of its k nearest other rows, ties to the smaller id."""
    vectors = usable(rows, id_column, vector_column)
    # Copies of a vector: of each node as many ids as a result can hold, the query's own besides. The limit is
    # taken before the shuffle, too.
    copy = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    given = stored(vectors, "vectors")
    copies = stored(given.withColumn("copy", copy).where(F.col("copy") <= k + 1), "copies")
    single = copies.where("copy = 1")
    # Components given as floats are floats without loss.
    kind = np.dtype(np.float32 if dict(rows.dtypes)[vector_column] == "array<float>" else np.float64)
    codes = stored(_originals(single, kind), "codes")
    n = codes.count()
    wanted = min(PIVOTS, max(1, n * CELLS_PER_NODE // (CELL * 3 // 4)))
    sample = codes.orderBy(F.xxhash64("node"), "node").limit(wanted).collect()
    pivots = np.array([np.frombuffer(r.code, kind) for r in sample])
    graph = build(codes, pivots, neighbours, rounds=rounds) if n else None

    asked = stored(given.where(is_query).select(F.col("id").alias("query_id"), "node", "vector"), "queries")
    points = asked.select("node").distinct()
    queries = stored(points.join(codes, "node").select(F.col("node").alias("q"), F.col("code").alias("query_code")), "query_codes")
    if graph is None:
        pools = queries.select("q", F.col("q").alias("node"))
    else:
        numbered = [r.node for r in sample]
        near = _nearest_pivots(queries.select("q", F.col("query_code").alias("code")), "q", pivots, ENTRIES)
        entries = near.select("q", F.element_at(F.array(*map(F.lit, numbered)), (F.col("cell") + 1).cast("int")).alias("node"))
        # A query that is a node starts there as well.
        entries = entries.union(queries.select("q", F.col("q").alias("node")))
        pools = search(graph, codes, queries, entries, kind, pool=pool)

    one = asked.select("query_id", F.col("node").alias("q"), F.col("vector").alias("a"))
    found = pools.union(queries.select("q", F.col("q").alias("node"))).distinct().join(single.select("node", F.col("vector").alias("b")), "node")
    pairs = found.join(one, "q").select("query_id", "q", "node", "a", "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column(3), np.float64), _matrix(batch.column(4), np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1]))], ["query_id", "q", "node", "score"])

    id_kind = dict(rows.dtypes)[id_column]
    measured = stored(pairs.mapInArrow(exact, f"query_id {id_kind}, q long, node long, score double"), "measured")

    # k + 1 nodes hold k other rows at least; more are kept where distances tie with the last.
    def placed(measured: DataFrame) -> DataFrame:
        near = measured.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "node")))
        return near.withColumn("last", F.max(F.when(F.col("place") <= k + 1, F.col("score"))).over(Window.partitionBy("query_id")))

    pooled = placed(measured).groupBy("query_id", "q").agg(F.count(F.lit(1)).alias("held"), F.max("score").alias("far"), F.max("last").alias("last"))
    open_ended = stored(pooled.where((F.col("held") < n) & ((F.col("held") < pool) | (F.col("far") <= F.col("last")))).select("q").distinct(), "open_ended")
    if not open_ended.isEmpty():
        scan = _scan(single, open_ended.join(single.select(F.col("node").alias("q"), F.col("vector").alias("a")), "q"), k)
        scanned = scan.join(one.select("query_id", "q"), "q").select("query_id", "q", "node", "score")
        measured = measured.join(open_ended, "q", "left_anti").select("query_id", "q", "node", "score").union(scanned)
    near = placed(measured)
    near = near.where("score <= last").select("query_id", "node", "score")
    others = near.join(copies.select("node", F.col("id").alias("vec_id")), "node").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
