import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import hardnegatives

KIND = "vec_id long, label int, embedding array<double>"


def by_hand(rows, anchor, positives=5, negatives=10, band=(30, 90)):
    """Every anchor against every row, one by one; ``anchor`` is a condition on the id."""
    usable = []
    for key, label, v in rows:
        if key is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in w) < 2**56:
            usable.append((key, label, w))
    out = []
    for a in usable:
        if not anchor(a[0]):
            continue
        near = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in usable if b[0] != a[0]]
        own = sorted(x for x in near if x[2] == a[1])[:positives]
        for p, key, _ in own:
            fits = sorted((s, i) for s, i, label in near if label != a[1] and band[0] * -p <= 100 * -s <= band[1] * -p)
            out += [(a[0], key, rank + 1, i, -p, -s) for rank, (s, i) in enumerate(fits[:negatives])]
    return sorted(out)


def found(frame):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in frame.collect())


def test_equals_every_pair(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(0, 6, 600)] + rng.normal(size=(600, 12)) * 0.3
    # Lengths of all sizes, copies with other ids and labels, equal scores.
    x[::9] *= 40
    x[100:140] = x[7]
    x[200:230] = np.round(x[200:230])
    rows = [(i, int(i % 4), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, KIND)
    expected = by_hand(rows, lambda i: i % 20 == 0)
    assert len(expected) > 500
    assert found(hardnegatives.mine(frame, F.col("id") % 20 == 0)) == expected
    assert found(hardnegatives.mine(frame, F.col("id") % 20 == 0, leaf=4, fanout=3, unit=32)) == expected


def test_units_of_hot_leaves_and_busy_units(spark, monkeypatch):
    """A third of all rows are one vector, leaves are split, and units are given to several tasks."""
    monkeypatch.setattr(hardnegatives, "VISITS", 3)
    monkeypatch.setattr(hardnegatives, "SAMPLE", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6))
    x[300:600] = x[0]
    rows = [(i, int(i % 3), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, KIND)
    expected = by_hand(rows, lambda i: i % 50 == 0)
    assert found(hardnegatives.mine(frame, F.col("id") % 50 == 0, leaf=8, fanout=4, unit=40)) == expected


def test_far_groups_are_eliminated(spark):
    """Of well separated groups a query visits its own and those its bands reach, and no others."""
    rng = np.random.default_rng(3)
    centres = np.eye(16)[:12] * 3
    x = centres[np.arange(1200) % 12] + rng.normal(size=(1200, 16)) * 0.02
    frame = spark.createDataFrame([(i, int(i % 2 + 2 * (i % 12)), v.tolist()) for i, v in enumerate(x)], KIND)
    vectors, width = hardnegatives.usable(frame, "vec_id", "label", "embedding")
    index = hardnegatives.Index(vectors, width, leaf=16, fanout=12)
    y = np.stack([np.frombuffer(r.v, np.int32) for r in vectors.where("id % 100 = 0").collect()])
    best = (y.astype(np.int64) ** 2).sum(axis=1)
    alive = index.tree.alive(y, (best * 9 // 10)[:, None], np.full((len(y), 1), 1 << 62))
    assert 0 < alive.mean() < 0.25


def test_large_numbers_are_exact(spark):
    big = 2.0**17 + 1 / 256
    rows = [(0, 0, [big, 1.0]), (100, 0, [big, 2.0]), (1, 0, [big, 3.0]), (2, 1, [big * 0.75, 5.0]), (3, 1, [big * 0.75, 6.0]), (4, 1, [2.0**30, 0.0])]
    frame = spark.createDataFrame(rows, KIND)
    expected = by_hand(rows, lambda i: i % 100 == 0)
    assert len(expected) == 8
    assert found(hardnegatives.mine(frame, F.col("id") % 100 == 0)) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 0, [1.0, 0.5]), (0, 0, [1.0, 0.5]), (0, 1, [0.5, 0.5]), (100, 1, [0.0, 0.0]), (200, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]),
        (300, 0, None), (400, 0, [1.0, None]), (500, 0, [nan, 1.0]), (600, 0, [inf, 1.0]), (700, 0, []), (900, 2, [1.0, 0.1]),
        (1, 0, [1.0, 0.4]), (2, 0, [-1.0, -0.4]), (3, 1, [0.5, 0.1]), (3, 1, [0.5, 0.1]), (4, 1, [0.4, 0.1]), (5, 2, [0.3, 0.3]), (6, 0, [0.9, 0.4]),
    ]
    frame = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("id", "v", "q", "leaf", "rank", "score")})
    expected = by_hand(rows, lambda i: i % 100 == 0)
    assert found(hardnegatives.mine(frame, F.col("id") % 100 == 0)) == expected
    # A vector of another length takes no part.
    other = frame.unionByName(spark.createDataFrame([(7, 0, [1.0, 1.0, 1.0])], KIND), allowMissingColumns=True)
    assert found(hardnegatives.mine(other, F.col("id") % 100 == 0)) == expected


@pytest.mark.parametrize("condition", ["false", "vec_id = 3"])
def test_nothing_to_find(spark, condition):
    rows = spark.createDataFrame([(3, 1, [1.0, 2.0]), (100, 1, [1.0, 1.0])], KIND).where(condition)
    assert hardnegatives.mine(rows, F.col("id") % 100 == 0).collect() == []
    assert hardnegatives.mine(rows, F.col("id") == 3).collect() == []
