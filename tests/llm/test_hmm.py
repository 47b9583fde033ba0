import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import hmm
from ledgerleaf.llm.common import in_fold


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_base_scores_and_counts(docs, listed):
    rows = hmm.score(docs, in_fold(F.col("doc_id"), 5, 1), iterations=2).collect()
    counts = collections.Counter()
    for key, text in listed:
        if key is None or zlib.crc32(str(key).encode()) % 5 != 1:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for key, text in listed:
        own = tokens(text)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        expected.append((str(key), len(own), sum(counts[w] > 0 for w in own), total, round(base, 4)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == sorted(expected)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_likelihood(sequence, model):
    """Sum over all ways through the states."""
    import itertools

    total = 0.0
    for way in itertools.product(range(len(model.start)), repeat=len(sequence)):
        p = model.start[way[0]] * model.emits[sequence[0], way[0]]
        for i in range(1, len(sequence)):
            p *= model.moves[way[i - 1], way[i]] * model.emits[sequence[i], way[i]]
        total += p
    return math.log10(total)


@pytest.fixture
def small():
    rng = np.random.default_rng(2)
    return hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)


def test_forward_recursion_is_exact(small):
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    found = hmm.log10_likelihood(sequences, small)
    assert np.allclose(found, [brute_likelihood(s, small) for s in sequences])


def test_long_sequences_do_not_underflow(small):
    assert np.isfinite(hmm.log10_likelihood([np.zeros(200_000, np.int64), np.array([1])], small)).all()


def test_expected_counts_never_lower_the_likelihood(small):
    rng = np.random.default_rng(4)
    sequences = [rng.integers(0, 5, n) for n in (40, 7, 23, 1)]
    last = -math.inf
    for _ in range(15):
        start, moves, emits, log = hmm.expected_counts(sequences, small)
        assert math.isclose(emits.sum(), sum(map(len, sequences)))
        assert math.isclose(moves.sum(), sum(len(s) - 1 for s in sequences))
        assert log >= last - 1e-9
        last = log
        small = hmm.Model(start / start.sum(), moves / moves.sum(axis=1)[:, None], emits / emits.sum(axis=0))


def test_probabilities_of_all_words_sum_to_one(spark, docs):
    counts = hmm.count_words(docs.select("text")).cache()
    words = hmm.vocabulary(counts, listed=50, own=20)
    model = hmm.Model.initial(words)
    by_class = model.emits @ model.start
    total = 0.5 / words.masses[words.own :] @ by_class[words.own :]  # the unknown word of each shared class
    for r in counts.collect():
        word = bytes(r.word)
        number = words.listed.get(word, -1 - hmm.shared_class(word))
        kind = int(words.classes(np.array([number]))[0])
        total += by_class[kind] * (r.n + 0.5) / words.masses[kind]
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_nothing_to_learn_from(docs, none):
    assert hmm.score(none, F.lit(False)).count() == 0
    rows = hmm.score(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score and abs(r.score) < 1e-6 for r in rows)


def brute_counts(sequence, model):
    """Expected starts, transitions and emissions by the recursions over one whole text, step by step."""
    n = len(sequence)
    alpha, beta = [model.start * model.emits[sequence[0]]], [np.ones(len(model.start))]
    alpha[0] = alpha[0] / alpha[0].sum()
    for x in sequence[1:]:
        a = (alpha[-1] @ model.moves) * model.emits[x]
        alpha.append(a / a.sum())
    for x in sequence[:0:-1]:
        b = model.moves @ (model.emits[x] * beta[0])
        beta.insert(0, b / b.sum())
    posterior = [a * b / (a @ b) for a, b in zip(alpha, beta, strict=True)]
    moves, emits = np.zeros_like(model.moves), np.zeros_like(model.emits)
    for t in range(n):
        emits[sequence[t]] += posterior[t]
        if t:
            pair = alpha[t - 1][:, None] * model.moves * (model.emits[sequence[t]] * beta[t])[None, :]
            moves += pair / pair.sum()
    return posterior[0], moves, emits


def test_values_are_carried_over_piece_borders(small):
    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 5, n) for n in (hmm.PIECE, 3 * hmm.PIECE + 5, 1, hmm.PIECE + 1, 2 * hmm.PIECE, 3)]
    start, moves, emits, log = hmm.expected_counts(sequences, small)
    truth = [sum(c) for c in zip(*(brute_counts(s, small) for s in sequences), strict=True)]
    assert all(np.allclose(a, b) for a, b in zip((start, moves, emits), truth, strict=True))
    assert math.isclose(log / math.log(10), hmm.log10_likelihood(sequences, small).sum(), rel_tol=1e-9)


def test_training_starts_once_in_each_text(spark, small, monkeypatch):
    text = np.random.default_rng(6).integers(0, 5, 5 * hmm.PIECE)
    encoded = spark.createDataFrame([(bytearray(text.astype("<u2").tobytes()),)], "classes binary")
    words = hmm.Vocabulary({}, np.zeros(0, np.int64), 0, 0, np.ones(5), 5)
    monkeypatch.setattr(hmm.Model, "initial", classmethod(lambda cls, *_: small))
    model = hmm.train(encoded, words, states=3, iterations=1)
    start, moves, _ = brute_counts(text, small)
    assert np.allclose(model.start, (start + 1) / 4)
    assert np.allclose(model.moves, (moves + 1) / (moves + 1).sum(axis=1)[:, None])
