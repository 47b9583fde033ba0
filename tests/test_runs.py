"""Whole runs: ingestion, processing, analysis, streaming; repeating a run changes nothing."""


import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import quality, report
from ledgerleaf.plans import analyse, ingest, process
from ledgerleaf.registry import inputs
from ledgerleaf.sinks import tables
from ledgerleaf.streaming import incremental

DB = "portfolio_test"




@pytest.fixture(scope="module")
def base(tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    contents = {
        "acme/financials/q1.csv": "Metric,Q1 2024,Q2 2024\nTotal Revenue,$5M,$6M\nMonthly burn,100K,90K\n",
        "acme/financials/notes.txt": "Runway: 18 months. Cash balance: $2M. " * 40,
        "acme/pitch/deck.md": "# Market\nThe market is large.\n" + "More words follow here. " * 60,
        "acme/old.pptx": "x",
        "beta/contract.txt": "This agreement is short.",
    }
    for name, content in contents.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    return str(root)


def counts(spark):
    return {row["table_name"]: row["n_rows"] for row in tables.count_tables(spark, DB).collect()}


def test_ingest_process_analyse(spark, base):
    tables.create_tables(spark, DB)
    tables.create_tables(spark, DB)
    companies = spark.createDataFrame(
        [("acme", "Acme Corp", "SaaS"), ("beta", "Beta", None), ("gone", "Gone", None)], "folder string, name string, industry string"
    )
    summary = {row["company_name"]: row for row in ingest.ingest_folders(spark, base, companies, DB).collect()}
    assert (summary["Acme Corp"]["documents_found"], summary["Acme Corp"]["documents_registered"]) == (4, 4)
    assert summary["Acme Corp"]["document_types"] == {"financial": 2, "pitch_deck": 2}
    assert summary["Gone"]["documents_found"] == 0

    again = {row["company_name"]: row for row in ingest.ingest_folders(spark, base, companies, DB).collect()}
    assert (again["Acme Corp"]["documents_found"], again["Acme Corp"]["documents_registered"]) == (4, 0)
    assert (counts(spark)["companies"], counts(spark)["documents"]) == (3, 5)

    contents = ingest.classified_folder(spark, base, companies, with_content=True)
    ran = process.process_documents(spark, DB, contents).first()
    assert (ran["documents"], ran["processed"]) == (5, 4)
    documents = {row["filename"]: row for row in spark.table(f"{DB}.documents").collect()}
    assert documents["old.pptx"]["processing_error"] == "Unsupported file type: .pptx"
    assert documents["old.pptx"]["processed"] is False
    assert documents["q1.csv"]["processed"] and documents["q1.csv"]["has_tables"] and documents["q1.csv"]["processed_at"]
    wide = spark.table(f"{DB}.financial_metrics")
    assert "upload_day" in {c.name for c in spark.catalog.listColumns(f"{DB}.documents") if c.isPartition}
    assert {row[0] for row in wide.select("revenue").dropna().collect()} == {5e6, 6e6}
    assert {row[0] for row in wide.select("runway_months").dropna().collect()} == {18.0}
    chunks = spark.table(f"{DB}.document_chunks")
    assert {row[0] for row in chunks.filter("document_type = 'pitch_deck'").select("section_title").collect()} == {"Market"}
    before = counts(spark)
    assert before["chunk_embeddings"] == before["document_chunks"] == ran["chunks"]

    process.process_documents(spark, DB, contents)
    assert counts(spark) == before
    assert process.files_to_do(contents, spark.table(f"{DB}.documents").limit(2), 2).count() == 2
    assert process.files_to_do(contents, spark.table(f"{DB}.documents").limit(2), 1).count() == 2

    reply = '{"score": 7.5, "reasoning": "fine", "key_findings": ["one", "two", "three"]}'

    def always(text):
        return lambda prompts: [text] * len(prompts)

    saved = analyse.analyse_companies(spark, DB, always("an answer"), always(reply), always(" A summary. "))
    assert saved == 3
    memo = spark.table(f"{DB}.investment_analysis").filter(F.col("documents_analyzed") == 4).first()
    assert (memo["overall_score"], memo["recommendation"], memo["confidence_level"]) == (7.5, "buy", 1.0)
    assert memo["executive_summary"] == "A summary."
    assert memo["key_risks"] == ["one", "two", "three"]
    assert memo["financial_analysis"].startswith(
        "Revenue: $5,500,000. Growth rate: 20.0%. Burn rate: $95,000/month. Runway: 18.0 months"
    )
    assert counts(spark)["analysis_dimensions"] == 21
    weights = spark.table(f"{DB}.analysis_dimensions").agg(F.sum("weight")).first()[0]
    assert weights == pytest.approx(3.0)

    rolled = report.company_rollup(
        spark.table(f"{DB}.companies"), spark.table(f"{DB}.documents"), spark.table(f"{DB}.investment_analysis")
    )
    written = spark.table(f"{DB}.companies").select("name", "total_documents", F.col("last_analyzed").isNotNull().alias("seen"))
    assert {tuple(r) for r in written.collect()} == {("Acme Corp", 4, True), ("Beta", 1, True), ("Gone", 0, True)}
    assert {(r["name"], r["total_documents"]) for r in rolled.collect()} == {("Acme Corp", 4), ("Beta", 1), ("Gone", 0)}
    checks = quality.check_columns(
        spark.table(f"{DB}.investment_analysis"), {"overall_score": (0, 10), "confidence_level": (0, 1)}, None, ["company_id"]
    )
    assert {row["n_violations"] for row in checks.collect()} == {0}
    tables.drop_tables(spark, DB)
    assert spark.catalog.listTables(DB) == []


def test_status_rewrites_touched_days_only(spark):
    database = DB + "3"
    tables.create_tables(spark, database, ["documents"])
    name = f"{database}.documents"
    rows = [(f"d{i}", "c", f"f{i}", f"/f{i}", f"2024-01-0{1 + i % 3} 10:00:00") for i in range(9)]
    documents = spark.createDataFrame(rows, "document_id string, company_id string, filename string, file_path string, t string")
    documents = documents.withColumns({"uploaded_at": F.col("t").cast("timestamp"), "processed": F.lit(False)}).drop("t")
    assert tables.register_documents(documents, name) == 9
    assert tables.register_documents(documents, name) == 0

    def files(day):
        return set(spark.table(name).filter(F.col("upload_day") == day).select(F.col("_metadata.file_name")).toPandas()["file_name"])

    before = {day: files(day) for day in ("2024-01-01", "2024-01-02")}
    result = spark.createDataFrame([("d0", True, None, 3, False, True), ("d3", False, "torn", None, None, None)],
                                   "document_id string, success boolean, error string, page_count int, has_tables boolean, has_charts boolean")
    tables.mark_documents(result, name)
    assert files("2024-01-02") == before["2024-01-02"] and files("2024-01-01") != before["2024-01-01"]
    after = {row["document_id"]: row for row in spark.table(name).collect()}
    assert len(after) == 9
    assert (after["d0"]["processed"], after["d0"]["page_count"], after["d0"]["has_charts"]) == (True, 3, True)
    assert (after["d3"]["processed"], after["d3"]["processing_error"]) == (False, "torn")
    tables.mark_documents(result.filter("document_id = 'd3'").withColumn("success", F.lit(True)), name)
    assert spark.table(name).filter("document_id = 'd3'").first()["processing_error"] is None
    tables.drop_tables(spark, database, ["documents"])


def test_company_updates(spark):
    tables.create_tables(spark, DB + "2", ["companies"])
    name = f"{DB}2.companies"
    first = spark.createDataFrame([("c", "Old", "2024-01-01"), ("d", "Dee", "2024-01-01")], "company_id string, name string, t string")
    stamped = first.withColumns({"created_at": F.col("t").cast("timestamp"), "updated_at": F.col("t").cast("timestamp")}).drop("t")
    tables.register_companies(stamped, name)
    tables.register_companies(spark.createDataFrame([("c", "New")], "company_id string, name string"), name)
    rows = {row["company_id"]: row for row in spark.table(name).collect()}
    assert {k: r["name"] for k, r in rows.items()} == {"c": "New", "d": "Dee"}
    assert str(rows["c"]["created_at"]) == "2024-01-01 00:00:00"
    tables.drop_tables(spark, DB + "2", ["companies"])


SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


COLUMNS = ("document_id", "company_id", "filename", "relative_path", "text")


def shaped(rows):
    return inputs.manifest_of(rows).select(*COLUMNS)


def test_micro_batches_equal_one_batch(spark, tmp_path):
    source = str(tmp_path / "arrivals")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents.repartition(3).write.parquet(source)

    def run(target, checkpoint, per_batch=None):
        incremental.incremental(
            spark, source, SCHEMA, str(tmp_path / target), str(tmp_path / checkpoint), shaped, per_batch
        ).awaitTermination()

    def rows(target, name):
        return sorted(map(str, spark.read.parquet(str(tmp_path / target / name)).drop("batch").collect()))

    run("many", "offsets1", 1)
    incremental.process_batch(shaped(documents), str(tmp_path / "one"), "only")
    for name in ("documents", "chunks", "metrics"):
        assert rows("many", name) == rows("one", name)
    before = rows("many", "chunks")
    incremental.process_batch(shaped(documents), str(tmp_path / "one"), "only")  # the same batch once more
    assert rows("one", "chunks") == before
    run("many", "offsets1")  # nothing new
    run("many", "offsets2")  # everything delivered once more
    assert rows("many", "chunks") == before
    documents.limit(5).withColumn("doc_id", F.col("doc_id") + 100000).coalesce(1).write.mode("append").parquet(source)
    run("many", "offsets1")
    assert len(rows("many", "documents")) == documents.count() + 5


def test_state_recognises_what_is_delivered_again(spark, tmp_path, monkeypatch):
    source, target, offsets = (str(tmp_path / n) for n in ("arrivals", "ingested", "offsets"))
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).coalesce(1)
    read = []
    real = incremental._stored_ids

    def counted(*args):
        found = real(*args)
        read.append(found is not None)
        return found

    monkeypatch.setattr(incremental, "_stored_ids", counted)

    def deliver(rows, checkpoint=offsets, **options):
        rows.write.mode("append").parquet(source)
        incremental.incremental(spark, source, SCHEMA, target, checkpoint, shaped, 1, **options).awaitTermination()

    def ids():
        return sorted(r.document_id for r in spark.read.parquet(f"{target}/documents").collect())

    first, more = documents.filter("doc_id < 40"), documents
    deliver(first)
    deliver(more)
    deliver(documents)
    assert ids() == sorted({str(r.doc_id) for r in documents.collect()})
    # No batch read what is stored.
    assert read and not any(read)
    read.clear()
    # A new checkpoint knows nothing of the first: its batches compare with what that one stored.
    deliver(documents, str(tmp_path / "offsets2"))
    assert ids() == sorted({str(r.doc_id) for r in documents.collect()})
    assert all(read)
    # The state no longer knows documents that are older than the horizon: these are compared with their own stream's.
    read.clear()
    alone = str(tmp_path / "alone")
    old = F.col("document_id").cast("int") < 10
    for number in range(2):
        incremental.process_batch(shaped(documents), alone, f"s-{number}", "s", old, unique=True)
    stored = spark.read.parquet(f"{alone}/documents").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in stored} == {"s-0": 60, "s-1": 50}
    assert read == [False, False, False, True]


def test_run_takes_pages_files_and_what_does_not_arrive(spark, tmp_path):
    database = DB + "4"
    tables.create_tables(spark, database, buckets=2)
    root = tmp_path / "base"
    for name, content in {"acme/a.txt": "Runway: 18 months.", "acme/lost.txt": "gone", "acme/deck.pdf": "%PDF-1", "acme/b.txt": "Plain."}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    companies = spark.createDataFrame([("acme", "Acme")], "folder string, name string")
    ingest.ingest_folders(spark, str(root), companies, database)
    documents = {r.filename: r.document_id for r in spark.table(f"{database}.documents").collect()}
    files = ingest.classified_folder(spark, str(root), companies, with_content=True)
    listed = spark.createDataFrame(ingest.classified_folder(spark, str(root), companies).select("document_id").collect())
    (root / "acme/lost.txt").unlink()
    key = documents["deck.pdf"]
    pages = spark.createDataFrame(
        [(key, 2, "Second page. " * 100, 1), (key, 1, "# Title\nFirst page.", 0), ("unknown", 1, "x", 0)],
        "document_id string, page int, text string, n_images int",
    )
    ran = process.process_documents(spark, database, files, pages=pages, listed=listed).first()
    assert (ran["documents"], ran["processed"]) == (4, 3)
    status = {r.filename: r for r in spark.table(f"{database}.documents").collect()}
    assert (status["lost.txt"].processed, status["lost.txt"].processing_error) == (False, process.UNREADABLE)
    assert (status["deck.pdf"].processed, status["deck.pdf"].page_count, status["deck.pdf"].has_charts) == (True, 2, True)
    chunks = spark.table(f"{database}.document_chunks")
    assert {r.page_number for r in chunks.filter(F.col("document_id") == key).collect()} == {1, 2}
    assert {r.page_number for r in chunks.filter(F.col("document_id") != key).collect()} == {None}
    # The next run finds the file again and finishes it.
    (root / "acme/lost.txt").write_text("gone")
    again = ingest.classified_folder(spark, str(root), companies, with_content=True)
    given = again.withColumn("document_id", F.when(F.col("filename") == "lost.txt", documents["lost.txt"]).otherwise(F.col("document_id")))
    process.process_documents(spark, database, given)
    status = {r.filename: r for r in spark.table(f"{database}.documents").collect()}
    assert all(r.processed and r.processing_error is None for r in status.values())
    assert spark.table(f"{database}.document_chunks").select("document_id").distinct().count() == 4
    assert spark.table(f"{database}.companies").first()["total_documents"] == 4
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_the_same_payload_is_processed_once(spark):
    rows = [("d1", ".txt", b"same", "c", "other")] * 3 + [("d2", ".txt", b"own", "c", "other")]
    files = spark.createDataFrame(rows, "document_id string, file_type string, content binary, company_id string, document_type string")
    assert sorted(r.document_id for r in process.once(files).collect()) == ["d1", "d2"]


def test_parsed_files_leave_in_frames_of_bounded_size(spark, monkeypatch):
    from ledgerleaf.sources import parsers

    monkeypatch.setattr(parsers, "FRAME_FILES", 3)
    monkeypatch.setattr(parsers, "FRAME_SIZE", 50)
    files = spark.range(40).select(
        F.col("id").cast("string").alias("document_id"), F.lit(".txt").alias("file_type"),
        F.repeat(F.lit("x"), (F.col("id") % 9 * 10).cast("int")).cast("binary").alias("content"),
    )
    found = {r.document_id: r.char_count for r in parsers.extract(files.coalesce(1)).collect()}
    assert found == {str(i): i % 9 * 10 for i in range(40)}
