import gc
import hashlib
import re
import weakref

import pytest

from ledgerleaf.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def benchmark(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    more = [(7001, None), (7002, ""), (7003, "One two, three"), (None, "without an id but with words"), (7004, "one two three"), (7003, "..")]
    return given.unionByName(spark.createDataFrame(more, given.schema))


def brute(documents, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for key, text in documents:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        ids = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [500_000, 40])
def test_report_equals_brute_force(docs, listed, benchmark, block):
    found = decontaminate.report(docs, benchmark, block_windows=block).collect()
    expected = brute(listed, [(r.item_id, r.text) for r in benchmark.collect()])
    assert sorted(map(tuple, found), key=str) == expected
    assert sum(r.contaminated for r in found) > 3


def test_cut_and_dropped_texts_are_clean(docs, benchmark):
    cut = decontaminate.cut_spans(docs, benchmark)
    assert cut.columns == docs.columns
    assert cut.count() == docs.count()
    dropped = decontaminate.drop_contaminated(docs, benchmark)
    assert dropped.columns == docs.columns
    assert not any(r.contaminated for r in decontaminate.report(dropped, benchmark).collect())
    spans = {(r.doc_id, r.text) for r in cut.where("doc_id in (90006, 90007)").select("doc_id", "text").collect()}
    assert spans == {(90006, ""), (90007, "")}


def test_empty_tables(docs, none, benchmark):
    assert decontaminate.report(none, benchmark).count() == 0
    assert decontaminate.report(docs, benchmark.where("false")).where("contaminated").count() == 0


def test_one_index_is_held_at_a_time(docs, spark, sf_dir, monkeypatch):
    """Of many blocks the driver holds one index, and each is used before the next is made."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    alive, most = weakref.WeakSet(), []
    real = decontaminate.WindowIndex

    class Counted(real):
        def __init__(self, rows):
            gc.collect()
            most.append(len(alive) + 1)
            alive.add(self)
            super().__init__(rows)

    monkeypatch.setattr(decontaminate, "WindowIndex", Counted)
    decontaminate.find_hits(docs.select("doc_id", "text").limit(5), benchmark, block_windows=200)
    assert len(most) >= 4
    # The one that is made and, at most, the one whose scan has just ended.
    assert max(most) <= 2
