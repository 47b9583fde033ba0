"""Registered queries of this folder against their SQL, and the pipeline against its own rules."""

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from ledgerleaf.llm import decontaminate
from ledgerleaf.llm.common import stored
from ledgerleaf.llm.queries import ORACLES, QUERIES, tokenizer_path

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_all_are_registered():
    names = entry_point.queries()
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert [x for x in names if x.startswith(f"op{n}_")]
    assert names["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    result = connection.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect()) == expected


def test_stages(spark, sf_dir, docs):
    """Each stage over all that the one before kept, with odd rows and further columns; decisions take effect."""
    rows = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, rows, sf_dir), name)
        if name != "best_fit_packing":
            assert result.columns == docs.columns
        seen[name] = (rows, result)
        rows = result
    before, after = (x.collect() for x in seen["language_id"])
    assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {90001, 90002, 90003, 90004} | {r.doc_id for r in before if len(r.text or "") < 40}
    for text in (None, "", "12 34 !!"):
        assert text not in {r.text for r in after}
    before, after = seen["suffix_array_dedup"]
    assert before.count() == after.count()
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["decontamination"]
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = {r.doc_id for r in decontaminate.report(before, benchmark).where("NOT contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = seen["best_fit_packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    assert sum(r.piece == 0 for r in pieces) == before.count()
    assert len(tokenizer_path()) > 0


def test_run_over_empty_documents(spark, sf_dir, none):
    rows = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, sf_dir), name)
    assert rows.count() == 0
