import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import lexical

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return _TERM.findall(folded)


def by_hand(docs, items, k=10):
    """Every item against every document."""
    bags = [(key, collections.Counter(terms(text)), len(terms(text))) for key, text in docs]
    bags = [b for b in bags if b[2]]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for key, bag, n in bags:
            m = 10 + 90 * n * n_docs // length
            score = 0
            for t in set(terms(text)) & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


def test_terms_are_those_of_the_pattern():
    for text in ("", " ", "Ab-c_d 12\x00x\x7fy[z]{q}", "Éa ñ\u00a0b\u2003c 日本", "\t\n\x0b\x0c\r\x1c\x85a"):
        assert lexical.terms_of(text.encode()) == terms(text)


@pytest.fixture(scope="module")
def asked(spark, listed):
    items = [(i, t) for i, t in [(i, text[:300]) for i, text in listed[::12] if text and i is not None]]
    items += [(-1, None), (-2, ""), (-3, "!!"), (-4, "neverseenword"), (None, "one two three"), (-5, "ONE two one, thrée"), (-5, "one"), (-6, listed[3][1])]
    return items


def test_equals_every_pair(spark, docs, listed, asked):
    frame = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit(1) for c in ("number", "rank", "item")})
    expected = by_hand(listed, asked)
    assert len(expected) > 100
    assert rows_of(lexical.search(docs, frame)) == expected


def test_blocks_steps_and_rounds(spark, docs, listed, asked, monkeypatch):
    """The same rows where everything is cut into small pieces."""
    monkeypatch.setattr(lexical, "FIRST_TERMS", 1)
    monkeypatch.setattr(lexical, "STEP_POSTINGS", 50)
    monkeypatch.setattr(lexical, "STEP_TERMS", 1)
    monkeypatch.setattr(lexical, "_POOL", 20)
    few = asked[-8:] + asked[:3]
    frame = spark.createDataFrame(few, "item_id long, text string")
    assert rows_of(lexical.search(docs.repartition(3), frame, k=3, block_terms=60)) == by_hand(listed, few, 3)


def test_accumulators_are_limited():
    """Frequent terms make no accumulators once the kth score is out of their reach."""
    rng = np.random.default_rng(0)
    plan = lexical.Plan(np.array([0, 3]), np.array([0, 1, 2]), np.array([9000, 100, 10]), np.array([9_000_000, 90_000, 9_000, 0]), 1000, 50_000, 3)
    assert plan.stops(np.array([0])).tolist() == [3]
    assert plan.stops(np.array([90_001])).tolist() == [1]
    assert plan.stops(np.array([90_000])).tolist() == [2]
    n = rng.integers(20, 80, 1000)
    held = [[0, 1, 2] if i % 100 == 0 else [1, 2] if i % 2 else [2] for i in range(1000)]
    evaluation = lexical.Evaluation(plan, np.array([1]), np.array([90_001]))
    evaluation.load(n, np.array([len(x) for x in held]), np.concatenate(held), np.ones(sum(map(len, held)), np.int32))
    item, doc, score = evaluation.accumulators()
    assert doc.tolist() == list(range(0, 1000, 100))
    item, doc, score = evaluation.update(item, doc, score)
    m = 10 + 90 * n[doc] * 1000 // 50_000
    assert score.tolist() == [9110 * (10**9 // (1000 + 8 * int(x))) for x in m]


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical.RangeHash, "of", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    words = [b"ab", b"cd", b"abc", b"x"]
    vocabulary = lexical.Vocabulary(words[:3])
    data = np.frombuffer(b"x cd ab abc abd", np.uint8)
    starts, ends = np.array([0, 2, 5, 8, 12]), np.array([1, 4, 7, 11, 15])
    assert vocabulary.find(data, starts, ends, lexical.RangeHash()).tolist() == [-1, 1, 0, 2, -1]


def test_many_copies_tie(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "rare common").otherwise("common").alias("text"))
    items = spark.createDataFrame([(1, "common rare"), (2, "common")], "item_id long, text string")
    found = lexical.search(docs, items).collect()
    assert [r.doc_id for r in sorted((r for r in found if r.item_id == 1), key=lambda r: r["rank"])] == list(range(0, 30, 3))


def test_empty_tables(spark, none, asked):
    items = spark.createDataFrame(asked, "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(none, items.limit(0)).collect() == []
