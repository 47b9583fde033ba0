import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import neighbours

IS_QUERY = "id % 100 = 0"


def exact(ids, vectors, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        others = np.flatnonzero(np.arange(len(ids)) != i)
        order = others[np.lexsort((ids[others], d[others]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def table_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = table_of(neighbours.nearest(rows, IS_QUERY, pool=150).collect())
    table = rows.orderBy("vec_id").collect()
    truth = exact(np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64))
    assert found.keys() == truth.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hits >= 0.95 * 10 * len(truth)
    distance = {(q, i): d for q in truth for i, d in truth[q]}
    for q, near in found.items():
        assert len(near) == 10
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        assert all(abs(distance.get((q, i), d) - d) < 1e-12 for i, d in near)


def test_descent_improves_a_poor_graph(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "CELL", 16)
    codes = neighbours.stored(neighbours._codes(neighbours.usable(rows, "vec_id", "embedding")), "codes")
    pivots = np.array([np.frombuffer(r.code, np.int8) for r in codes.limit(100).collect()])
    table = codes.collect()
    code = np.array([np.frombuffer(r.code, np.int8) for r in table], float)
    node = np.array([r.node for r in table])
    best = {int(node[i]): {int(node[j]) for j in np.argsort(((code - code[i]) ** 2).sum(axis=1))[1:11]} for i in range(len(node))}

    def recall(graph):
        return np.mean([r.v in best[r.u] for r in graph.where("u != v").withColumn("r", F.row_number().over(neighbours.Window.partitionBy("u").orderBy("d"))).where("r <= 10").collect()])

    first = recall(neighbours.build(codes, pivots, k=10, rounds=0))
    last = recall(neighbours.build(codes, pivots, k=10, rounds=5))
    assert first < 0.6
    assert last > 0.9


@pytest.fixture
def odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(0, 330)]
    rows += [(1000 + i, [3.0, 3.0, 3.0]) for i in range(40)]
    rows += [(2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0, None, 2.0]), (2003, [1.0, inf, 2.0]), (2004, [1.0, nan, 2.0]), (2005, []), (2006, [1.0, 2.0])]
    rows += [(300, [3.0, 3.0, 3.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))


def test_copies_ties_and_unusable_vectors(odd):
    rows, table = odd
    used = [(i, v) for i, v in rows if i < 2000]
    ids, vectors = np.array([i for i, _ in used]), np.array([v for _, v in used])
    found = neighbours.nearest(table.where("vec_id != 300"), IS_QUERY, pool=120).collect()
    keep = ids != 300
    assert table_of(found) == exact(ids[keep], vectors[keep])
    assert {r.query_id for r in neighbours.nearest(table, IS_QUERY, pool=120).collect()} == {0, 100, 200, 300, 1000}


def test_few_and_no_rows(spark):
    some = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert table_of(neighbours.nearest(some, IS_QUERY).collect()) == {0: [(2, 1.0), (1, 2**0.5)]}
    assert neighbours.nearest(some.where("vec_id = 0"), IS_QUERY).count() == 0
    assert neighbours.nearest(some.where("false"), IS_QUERY).count() == 0


def recall_of(spark, vectors):
    ids = np.arange(len(vectors))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    found, truth = table_of(neighbours.nearest(rows, IS_QUERY).collect()), exact(ids, vectors)
    assert found.keys() == truth.keys()
    return np.mean([len({i for i, _ in found[q]} & {i for i, _ in truth[q]}) / 10 for q in truth])


def test_one_large_component_leaves_the_order_of_others(spark):
    vectors = np.random.default_rng(1).normal(size=(2000, 16))
    vectors[7, 3] = 1e30
    vectors[100, 2] = 1e5
    assert recall_of(spark, vectors) >= 0.95


def test_thousands_of_near_copies(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate((rng.normal(size=16) + rng.normal(size=(3000, 16)) * 1e-4, rng.normal(size=(600, 16))))
    assert recall_of(spark, vectors) >= 0.95


def test_ties_beyond_the_pool_go_to_the_smallest_ids(spark):
    ids = np.random.default_rng(3).permutation(700)
    rows = spark.createDataFrame([(int(i), [float(i == j) for j in range(700)]) for i in ids], "vec_id long, embedding array<double>")
    found = table_of(neighbours.nearest(rows, IS_QUERY, pool=50).collect())
    assert found == {q: [(i, 2**0.5) for i in range(11) if i != q][:10] for q in range(0, 700, 100)}


def test_squares_of_near_and_large_rows():
    x = np.random.default_rng(4).normal(size=(40, 8))
    rows = np.concatenate((x, x[:5] + 1e-9, x[:5] + 1e6, x[:5] * 1e200, x[:5] * 1e200))
    with np.errstate(over="ignore"):
        truth = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    assert np.allclose(neighbours._squares(rows, rows), truth, rtol=1e-6, atol=0)
