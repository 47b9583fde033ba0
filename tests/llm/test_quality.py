import numpy as np
from pyspark.sql import functions as F

from ledgerleaf.llm import quality
from ledgerleaf.llm.common import in_fold


def test_held_out_ranking(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    found = quality.score(docs, labels, in_fold(F.col("doc_id"), 4, 2)).join(labels, "doc_id").where("held_out").collect()
    good = np.array([r.score for r in found if r.quality == 1])
    bad = np.array([r.score for r in found if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert np.mean([r.predicted == r.quality for r in found]) > 0.92
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_odd_rows_get_scores(spark, docs, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    odd = spark.createDataFrame([(None, 1), (90001, None), (90005, 1), (90005, 0), (123456, 0)], labels.schema)
    rows = quality.score(docs, labels.union(odd), in_fold(F.col("doc_id"), 4, 2)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id in (90001, 90002, 90003)]
    assert len(same) == 3 and max(same) - min(same) < 1e-5
    assert quality.score(none, labels, F.lit(False)).count() == 0
    assert {r.score for r in quality.score(docs, labels.where("false"), F.lit(False)).collect()} == {0.5}


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 5)).astype(np.float32)
    truth = 1 / (1 + np.exp(-3 * (x[:, 0] * x[:, 1])))
    y = (rng.random(6000) < truth).astype(float)
    network = quality.Network.fit(x[:5000], y[:5000])
    p = network.probabilities(x[5000:])
    assert ((p > 0.5) == (truth[5000:] > 0.5)).mean() > 0.9
    assert abs(p.mean() - y[5000:].mean()) < 0.05


def test_vectors_of_words_in_like_places_are_alike(spark):
    rows = [(i, f"{a} {b} {c}") for i, (a, b, c) in enumerate([("the", w, "runs") for w in ("dog", "cat")] * 60 + [("a", "stone", "falls")] * 60)]
    vectors = quality.word_vectors(spark.createDataFrame(rows, "doc_id long, text string"))
    units = quality.Units([b"dog cat stone"], quality.RangeHash()).word
    dog, cat, stone = (vectors[u] / np.linalg.norm(vectors[u]) for u in units)
    assert dog @ cat > 0.9 > abs(dog @ stone)
