import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerleaf.llm import substrings


def brute(rows, length):
    windows = collections.Counter()
    texts = [(key, (text or "").encode()) for key, text in rows]
    for _, x in texts:
        windows.update(x[p : p + length] for p in range(len(x) - length + 1))
    out = []
    for key, x in texts:
        hit = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - length + 1):
            if windows[x[p : p + length]] > 1:
                hit[p : p + length] = True
        runs = int((np.diff(np.concatenate(([False], hit[:-1], [False])).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~hit[:-1]])
        out.append((key, len(x), int(hit[:-1].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def test_report_equals_brute_force(docs, listed):
    short = docs.where("doc_id IS NULL OR doc_id != 90005")
    rows = [(k, x) for k, x in listed if k != 90005]
    result = substrings.report(short).collect()
    assert found(result) == brute(rows, 400)
    assert sum(r.n_removed > 0 for r in result) > 10
    cut = substrings.cut_repeats(short)
    assert cut.columns == docs.columns
    assert cut.count() == len(rows)
    assert cut.where("doc_id = 90011").first().text == ""
    assert cut.where("doc_id = 90001").first().text is None


@pytest.mark.parametrize("seed", range(3))
def test_passages_at_all_edges(spark, seed, monkeypatch):
    """Passages around the limit, overlapping, at the ends of texts, in runs of one character, in long texts."""
    rng = random.Random(seed)
    monkeypatch.setattr(substrings, "PIECE", 700)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    passages = [word(n) for n in (30, 37, 40, 60, 150, 33)]
    rows = []
    for i in range(60):
        parts = [word(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(passages)
            a = rng.randint(0, 12)
            parts += [own[a : len(own) - rng.randint(0, 12)], word(rng.randint(0, 25))]
        rows.append((i, "".join(parts)))
    rows += [(100, "x" * 300), (101, "y" * 41), (102, word(3000) + passages[4] + word(800)), (103, rows[0][1]), (103, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    result = substrings.report(docs, length=40, q=12).collect()
    assert found(result) == brute(rows, 40)


def test_a_very_long_text(spark):
    sentence = "Of anntre erthnd, thlyre to the inea that esly ndstnd nter inor eringedwh hathre and onon thhahe "
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij ") for _ in range(1_500_000))
    docs = spark.createDataFrame([(1, text + text[:2000]), (2, sentence * 3000)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.report(docs).collect()}
    assert rows[1] == (4000, 2)
    assert rows[2] == (len(sentence) * 3000, 1)


def span_batch(lists):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    spans = pa.array([[{"start": a, "stop": b} for a, b in x] for x in lists], kind)
    return pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(range(len(lists))), spans], ["id", "text_key", "spans"])


def test_spans_are_united_by_document(monkeypatch):
    monkeypatch.setattr(substrings, "UNITED", 7)
    rng = random.Random(5)
    lists = [[(a := rng.randint(0, 400), a + rng.randint(1, 30)) for _ in range(rng.randint(1, 40))] for _ in range(100)]
    lists[3] = [(5, 9), (0, 2), (9, 12)]
    found = [r for b in substrings.united([span_batch(lists)]) for r in b.to_pylist()]
    assert [r["id"] for r in found] == list(range(100))
    assert [(s["start"], s["stop"]) for s in found[3]["spans"]] == [(0, 2), (5, 12)]
    for spans, row in zip(lists, found, strict=True):
        covered = {p for a, b in spans for p in range(2 * a, 2 * b + 1)}
        runs = [(s["start"], s["stop"]) for s in row["spans"]]
        assert runs == sorted(runs)
        assert [p for a, b in runs for p in range(2 * a, 2 * b + 1)] == sorted(covered)


def test_many_spans_are_no_python_objects():
    batch = span_batch([[(i * 7, i * 7 + 400) for i in range(200)]] * 5000)
    tracemalloc.start()
    found = sum(len(b.column(2).flatten()) for b in substrings.united([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 5000
    assert peak < 60e6


def brute_words(rows, length):
    """Texts without the words of strings of ``length`` words that start elsewhere too, and the blanks inside such runs."""
    windows = collections.Counter()
    for _, x in rows:
        words = (x or "").split()
        windows.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    out = []
    for key, x in rows:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", x or "")]
        words = [x[a:b] for a, b in spans]
        hit, gone = np.zeros(len(words), bool), np.zeros(len(x or ""), bool)
        for i in range(len(words) - length + 1):
            hit[i : i + length] |= windows[tuple(words[i : i + length])] > 1
        for i in np.flatnonzero(hit):
            gone[spans[i][0] if i == 0 or not hit[i - 1] else spans[i - 1][1] : spans[i][1]] = True
        out.append((key, None if x is None else "".join(c for c, g in zip(x, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_strings_of_words(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(substrings, "PIECE", 300)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (19, 20, 22, 30, 75, 50)]
    rows = [(None, None), (1, ""), (2, " \n"), (3, "x " * 80), (3, "x " * 80), (4, "y" * 900)]
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(passages)
            words += own[rng.randint(0, 2) : len(own) - rng.randint(0, 2)] + [word() for _ in range(rng.randint(0, 9))]
        rows.append((10 + i, "".join(w + rng.choice((" ", "\n", "  ")) for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    result = substrings.cut_repeats(docs, words=20, length=10**6).collect()
    assert sorted(((r.doc_id, r.text) for r in result), key=str) == brute_words(rows, 20)
    assert sum(dict(rows)[r.doc_id] != r.text for r in result if r.doc_id) > 20


def test_passages_of_over_50_words_leave_the_pipeline(spark, tmp_path):
    """Also of fewer than 400 bytes, joined to other words at both ends; benchmark passages are left to their own stage."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage, short, item = text(51), text(40), text(55)
    assert len(passage) < 400
    texts = [f"{text(60)} {edge}{passage}{edge} {text(60)}" for edge in "xyz"] + [f"{text(60)} {short} {text(60)}" for _ in range(3)]
    texts += [f"{text(60)} {item} {text(60)}" for _ in range(3)] + ["z" * 900, "z" * 950]
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cut = corpus_pipeline.suffix_array_dedup(spark, docs, str(tmp_path))
    found = {r.doc_id: r.text for r in cut.collect()}
    words = passage.split()
    for i in range(3):
        assert found[i] == texts[i].replace(" ".join(words[1:-1]), "")
    assert [found[i] for i in range(3, 9)] == texts[3:9]
    assert found[9] == found[10] == ""
    kept = corpus_pipeline.decontamination(spark, cut, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {0, 1, 2, 3, 4, 5, 9, 10}


def test_empty_table(none):
    assert substrings.report(none).count() == 0
    assert substrings.cut_repeats(none).count() == 0
