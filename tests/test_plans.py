"""Properties of physical plans and behaviour on hot keys."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from ledgerleaf.operators import metrics, report, status
from ledgerleaf.registry import inputs
from ledgerleaf.sources import files

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_narrow_operators(spark):
    documents = inputs.classified(spark, SF_DIR)
    assert "Exchange" not in plan(documents)
    assert "text" not in plan(documents.select("document_id", "document_type")).split("ReadSchema")[1]
    assert "Exchange" not in plan(metrics.text_metrics(inputs.statement_text(spark, SF_DIR)))
    assert "Exchange" not in plan(files.page_text(inputs.table(spark, SF_DIR, "pages")))


def test_filters_reach_the_scan(spark):
    analyses = inputs.table(spark, SF_DIR, "orders").filter(F.col("o_custkey") == 7).select("o_orderkey")
    assert "EqualTo(o_custkey,7)" in plan(analyses)


def test_candidates_are_cut_before_the_shuffle(spark):
    text = plan(entry_point.queries()["similarity_topk"](spark, SF_DIR))
    assert text.index("Final") < text.index("Exchange hashpartitioning(_vector") < text.index("Partial")


def test_groups_are_not_gathered(spark):
    for name in ("documents_by_type", "storage_paths", "latest_analysis", "upsert_companies", "new_documents"):
        text = plan(entry_point.queries()[name](spark, SF_DIR))
        assert "Window" not in text and "collect_list" not in text


def test_shared_path(spark):
    """A path that most documents share: one keeps it, all others get their own."""
    frame = spark.range(3000).select(
        F.format_string("%08d", "id").alias("document_id"), F.lit("c").alias("company_id"),
        F.when(F.col("id") % 3 < 2, "scan.v1.pdf").otherwise(F.concat(F.lit("f"), "id")).alias("filename"),
        F.lit("in/x").alias("relative_path"),
    )
    placed = status.storage_paths(frame, "/s").select("storage_path").collect()
    paths = {row["storage_path"] for row in placed}
    assert len(paths) == len(placed) == 3000
    assert {"/s/c/in/scan.v1.pdf", "/s/c/in/scan.v1_00000001.pdf", "/s/c/in/f2"} <= paths


def test_copies(spark):
    arrived = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("key"))
    known = spark.range(0, 300).select(F.col("id").alias("key"))
    assert status.new_rows(arrived, known, "key").count() == 3000 - 100 + 1


def test_equal_times_page_without_gaps(spark):
    rows = spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 2).alias("time"))
    seen = [r["key"] for i in range(10) for r in report.newest(rows, "time", "key", 10, 10 * i).collect()]
    assert sorted(seen) == list(range(100))


def test_best_per_period(spark):
    rows = [("a", "c", "d", "Q1 2024", "revenue", 1.0, 0.6), ("b", "c", "d", "Q1 2024", "revenue", 2.0, 0.8)]
    frame = spark.createDataFrame(rows, "metric_id string, company_id string, document_id string, period string, metric_name string, value double, confidence_score double")
    best = metrics.best_per_period(frame).first()
    assert (best["value"], best["confidence_score"]) == (2.0, 0.8)
    assert metrics.confident(frame, 0.7).count() == 1
