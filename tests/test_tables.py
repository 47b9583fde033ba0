"""Managed tables: writes become visible by one step at their end, deliveries are synced by the catalog alone."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.plans import process
from ledgerleaf.sinks import tables

DB = "tables_test"
CHUNKS, VECTORS = f"{DB}.document_chunks", f"{DB}.chunk_embeddings"


@pytest.fixture
def database(spark):
    tables.create_tables(spark, DB)
    yield DB
    spark.sql(f"DROP DATABASE {DB} CASCADE")


def chunks(spark, *documents):
    rows = [(f"{d}_{i}", "c", d, f"text {i} of {d}", i) for d in documents for i in range(3)]
    return spark.createDataFrame(rows, "chunk_id string, company_id string, document_id string, text string, chunk_index int")


def companies(spark, *names):
    return spark.createDataFrame([(n, n.upper(), "2024-01-01 00:00:00") for n in names], "company_id string, name string, t string").select(
        "company_id", "name", *[F.col("t").cast("timestamp").alias(c) for c in ("created_at", "updated_at")]
    )


class Break(Exception):
    pass


def broken(*_):
    raise Break


def names(spark, table, column):
    return sorted(r[0] for r in spark.table(table).select(column).collect())


def test_a_replacement_that_breaks_off_leaves_the_old_rows(spark, database, monkeypatch):
    table = f"{DB}.companies"
    tables.register_companies(companies(spark, "a", "b"), table)
    settings = dict(spark.sparkContext.getConf().getAll())
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_point", broken)
        with pytest.raises(Break):
            tables.register_companies(companies(spark, "c"), table)
    assert names(spark, table, "company_id") == ["a", "b"]
    tables.register_companies(companies(spark, "c"), table)
    assert names(spark, table, "company_id") == ["a", "b", "c"]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert dict(spark.sparkContext.getConf().getAll()) == settings


def test_who_reads_meanwhile_reads_the_old_rows(spark, database):
    table = f"{DB}.companies"
    tables.register_companies(companies(spark, "a"), table)
    reading = spark.read.parquet(*spark.table(table).inputFiles())
    tables.register_companies(companies(spark, "b"), table)
    assert [r.company_id for r in reading.collect()] == ["a"]
    # One replaced version and the first, empty place.
    assert tables.vacuum(spark, DB) == 1
    assert names(spark, table, "company_id") == ["a", "b"]
    assert tables.vacuum(spark, DB) == 0


def test_days_that_are_replaced_break_off_whole(spark, database, monkeypatch):
    table = f"{DB}.documents"
    rows = [(f"d{i}", "c", "f", "/f", f"2024-01-0{1 + i % 2} 10:00:00") for i in range(6)]
    documents = spark.createDataFrame(rows, "document_id string, company_id string, filename string, file_path string, t string")
    documents = documents.withColumns({"uploaded_at": F.col("t").cast("timestamp"), "processed": F.lit(False)}).drop("t")
    assert tables.register_documents(documents, table) == 6
    result = spark.createDataFrame(
        [(f"d{i}", True, None, 1, False, False) for i in range(6)],
        "document_id string, success boolean, error string, page_count int, has_tables boolean, has_charts boolean",
    )
    real, seen = spark.sql, []

    def after_first(text):
        if "SET LOCATION" in text:
            seen.append(text)
            if len(seen) == 2:
                raise Break
        return real(text)

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", lambda self, text: after_first(text))
        with pytest.raises(Break):
            tables.mark_documents(result, table)
    by_day = {(str(r.upload_day), r.processed): r.n for r in spark.table(table).groupBy("upload_day", "processed").agg(F.count("*").alias("n")).collect()}
    assert sorted(by_day.values()) == [3, 3] and {p for _, p in by_day} == {True, False}
    tables.mark_documents(result, table)
    assert spark.table(table).filter("processed").count() == 6


def test_an_append_that_breaks_off_is_not_seen(spark, database, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_point", broken)
        with pytest.raises(Break):
            tables.append_documents(chunks(spark, "d1", "d2"), CHUNKS)
    assert spark.table(CHUNKS).count() == 0 and tables.partitions(spark, CHUNKS) == set()
    assert tables.append_documents(chunks(spark, "d1", "d2"), CHUNKS) == 6
    assert tables.append_documents(chunks(spark, "d2"), CHUNKS) == 0
    # An append without rows is no delivery.
    assert len(tables.partitions(spark, CHUNKS)) == 1


def test_sync_reads_new_deliveries_only(spark, database, monkeypatch):
    assert process.sync_embeddings(spark, DB) == 0
    tables.append_documents(chunks(spark, "d1", "d2"), CHUNKS)
    assert process.sync_embeddings(spark, DB) == 1
    tables.append_documents(chunks(spark, "d2", "d3"), CHUNKS)
    old = set(spark.table(VECTORS).select("delivery").distinct().toPandas()["delivery"])
    pending = process.pending_embeddings(spark, DB)
    assert {r.chunk_id for r in pending.collect()} == {f"d3_{i}" for i in range(3)}
    # Neither old chunks nor stored vectors are read.
    assert all("document_chunks" in f and not any(d in f for d in old) for f in pending.inputFiles())
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "delivery#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_point", broken)
        with pytest.raises(Break):
            process.sync_embeddings(spark, DB)
    assert spark.table(VECTORS).count() == 6
    assert process.sync_embeddings(spark, DB) == 1
    assert process.sync_embeddings(spark, DB) == 0
    assert names(spark, VECTORS, "chunk_id") == names(spark, CHUNKS, "chunk_id")
    assert tables.partitions(spark, VECTORS) == tables.partitions(spark, CHUNKS)


def test_new_rows_are_compared_by_hash_first(spark, database, monkeypatch):
    table = f"{DB}.financial_metrics"

    def rows(*keys):
        return spark.createDataFrame([(k, "c", "d", float(i)) for i, k in enumerate(keys)], "metric_id string, company_id string, document_id string, revenue double")

    compared = []
    new_rows = tables.new_rows
    monkeypatch.setattr(tables, "new_rows", lambda arrived, *rest: compared.append(arrived.count()) or new_rows(arrived, *rest))
    assert tables.append_new(rows("a", "b", "c"), table) == 3
    # Nothing is there yet and nothing comes twice: no row is shuffled.
    assert compared == []
    assert tables.append_new(rows("c", "d", "d", "e", None, None), table) == 3
    assert compared == [5]
    assert sorted(r[0] or "" for r in spark.table(table).select("metric_id").collect()) == ["", "a", "b", "c", "d", "e"]
    assert tables.append_new(rows("a", "e"), table) == 0
