import collections
import random

import numpy as np
import pytest

from ledgerleaf.llm import minhash
from ledgerleaf.llm.graph import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(id, set size, smallest id reachable) of each row, comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (a == b or min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b))):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        own = least[find(i)]
        out.append((key, len(sets[i]), (min(own) if own else None) if sets[i] else key))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_report_equals_brute_force(docs, listed):
    rows = minhash.report(docs).collect()
    assert found(rows) == brute(listed)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in rows)


@pytest.fixture(scope="module")
def copies(spark):
    """A base, many near copies that are alike only through it, chains at the limit, and exact copies."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in rng.sample(range(len(own)), 3):
            own[at] = word()
        rows.append((i + 1000, " ".join(own)))
    rows.append((5000, " ".join(base)))
    chain = [word() for _ in range(200)]
    for i in range(12):
        rows.append((100 + i, " ".join(chain)))
        chain = chain[8:] + [word() for _ in range(8)]
    rows += [(7000 + i, "the very same text stands here many times") for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_groups_that_hang_together_by_few(copies, monkeypatch):
    rows, docs = copies
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "MEMBERS_PER_SALT", 7)
    assert found(minhash.report(docs).collect()) == brute(rows)


def thue_morse(letters):
    """The string and its complement, which polynomial hashes modulo 2^64 cannot tell apart from 1,024 letters on."""
    own = "".join("ab"[bin(i).count("1") % 2] for i in range(letters))
    return own, own.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", [1024, 2048])
def test_words_decide_not_hashes(spark, letters):
    one, two = thue_morse(letters)
    a, b = minhash.shingle_sets([[one.encode()], [two.encode()]])
    assert a.tolist() != b.tolist()
    docs = spark.createDataFrame([(1, one), (2, two), (3, one + " x y z u v"), (4, two + " x y z u v")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.report(docs).collect()} == {(i, i) for i in (1, 2, 3, 4)}
    assert minhash.keep_one(docs).count() == 4


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Where all hashes of shingles are equal, words still tell texts apart."""
    monkeypatch.setattr(minhash, "hash_array", lambda own: np.ones(len(own), np.uint64))
    pairs = spark.createDataFrame([(1, 0)], "a long, b long")
    texts = spark.createDataFrame([(0, "a b c d e f g"), (1, "h i j k l m n")], "node long, text string")
    assert minhash._confirmed(pairs, texts, 75).collect() == []


def test_same_shingles_in_another_order(spark):
    """Lines said more often have the same shingles but not the same words."""
    line = "alpha beta gamma delta epsilon zeta eta "
    docs = spark.createDataFrame([(5, line * 4), (3, line * 3), (8, line * 9), (1, line)], "doc_id long, text string")
    assert found(minhash.report(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_stays_of_groups_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " tail"), (None, "other words that stand alone in here"), (None, None), (7, "some more words of their own kind")]
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 4
    assert sum(t is not None and t.startswith("w0") for _, t in kept) == 1


def test_one_of_each_group_stays(docs, listed):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {key for key, n, _ in brute(rows) if n}
    again = brute(rows)
    assert len({c for k, n, c in again if n and c is not None}) == len([1 for k, n, c in again if n and c is not None])
    expected = {c for _, n, c in brute(listed) if n and c is not None}
    assert {k for k in groups if k is not None} == expected
    # Texts without words stay.
    assert {90001, 90002, 90003} <= {k for k, _ in rows}


def test_estimate_is_close_and_unbiased():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.95):
        errors = []
        for _ in range(60):
            common = rng.integers(1, 1 << 62, int(400 * share), dtype=np.uint64)
            rest = (400 - len(common)) // 2
            a, b = (np.unique(np.concatenate((common, rng.integers(1, 1 << 62, rest, dtype=np.uint64)))) for _ in range(2))
            low, _ = minhash.signatures([a, b])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(float(minhash.estimate(low[0], low[1])) - truth)
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) < 0.06


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (60, 80), (40, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)]
        root = {}
        for a, b in links:
            root.setdefault(a, a)
            root.setdefault(b, b)
        changed = True
        while changed:
            changed = False
            for a, b in links:
                low = min(root[a], root[b])
                changed |= (root[a], root[b]) != (low, low)
                root[a] = root[b] = low
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        alone = {x for x in root if all(a == b for a, b in links if x in (a, b))}
        assert got == {k: v for k, v in root.items() if k not in alone}


def test_empty_table(none):
    assert minhash.report(none).count() == 0
    assert minhash.keep_one(none).count() == 0
