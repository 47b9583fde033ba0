"""Reports over the tables. Companies are joined without a hint: Spark broadcasts them while their measured
size allows it and otherwise splits skewed companies at run time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.constants import DOCUMENT_TYPES, OTHER_TYPE
from ledgerleaf.functions.numbers import fixed
from ledgerleaf.functions.text import title_case

ALL_TYPES = (*DOCUMENT_TYPES, OTHER_TYPE)


def type_distribution(documents: DataFrame) -> DataFrame:
    return (
        documents.groupBy("document_type")
        .agg(F.count("*").alias("n_documents"), F.avg("classification_confidence").alias("avg_confidence"))
        .orderBy(F.desc("n_documents"), "document_type")
    )


def processing_stats(documents: DataFrame) -> DataFrame:
    return (
        documents.groupBy("document_type")
        .agg(
            F.count("*").alias("total_documents"),
            F.count_if("processed").alias("processed"),
            F.count_if(F.col("processing_error").isNotNull()).alias("errors"),
            F.avg("page_count").alias("avg_pages"),
        )
        .orderBy(F.desc("total_documents"), "document_type")
    )


def financial_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("company_id").agg(
        F.count("*").alias("metric_count"),
        F.avg("revenue").alias("avg_revenue"),
        F.avg("burn_rate").alias("avg_burn_rate"),
        F.avg("runway_months").alias("avg_runway"),
    )


def ingestion_summary(documents: DataFrame, types: Sequence[str] = ALL_TYPES) -> DataFrame:
    """Documents found per company and a map type -> count of the types that occur."""
    counts = [F.count_if(F.col("document_type") == name).alias(name) for name in types]
    counted = documents.groupBy("company_id").agg(F.count("*").alias("documents_found"), *counts)
    entries = F.array(*[F.struct(F.lit(name).alias("key"), F.col(name).alias("value")) for name in types])
    return counted.select(
        "company_id",
        "documents_found",
        F.map_from_entries(F.filter(entries, lambda entry: entry["value"] > 0)).alias("document_types"),
    )


def run_summary(status: DataFrame, chunks: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: documents, processed ones, chunks and metrics of a run."""
    return _one_row(
        {
            "documents": (status, F.count("*")),
            "processed": (status, F.count_if("processed")),
            "chunks": (chunks, F.count("*")),
            "metrics": (metrics, F.count("*")),
        }
    )


def _one_row(measures: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Global aggregates of several frames side by side, without joining them."""
    parts = [
        frame.agg(measure.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
        for name, (frame, measure) in measures.items()
    ]
    return reduce(DataFrame.unionByName, parts).agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in measures]
    )


def system_stats(companies: DataFrame, documents: DataFrame, analyses: DataFrame) -> DataFrame:
    processed = F.coalesce(F.col("processed"), F.lit(False)).cast("int")
    return _one_row(
        {
            "total_companies": (companies, F.count("*")),
            "total_documents": (documents, F.count("*")),
            "processed_pct": (documents, F.avg(processed) * 100),
            "total_analyses": (analyses, F.count("*")),
        }
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            frame.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, frame in tables.items()
        ],
    )


def with_company_name(rows: DataFrame, companies: DataFrame) -> DataFrame:
    return rows.join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")


def documents_with_company(documents: DataFrame, companies: DataFrame) -> DataFrame:
    """Documents with their company's name, newest upload first."""
    columns = (
        "company_id", "company_name", "filename", "document_type", "classification_confidence", "file_size_bytes",
        "uploaded_at",
    )
    return (
        with_company_name(documents, companies)
        .orderBy(F.desc("uploaded_at"), "document_id")
        .select(*columns)
    )


def newest(rows: DataFrame, time: str, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows newest first, a page of them if ``limit`` is given; ``key`` decides between equal times."""
    ordered = rows.orderBy(F.desc(time), key)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def latest_chunks(chunks: DataFrame, companies: DataFrame, limit: int = 10) -> DataFrame:
    """The newest chunks with their company's name. Only they are joined."""
    return with_company_name(newest(chunks, "created_at", "chunk_id", limit), companies).select(
        "company_id", "company_name", "document_type", "text", "chunk_index", "created_at"
    )


def recent_analyses(analyses: DataFrame, companies: DataFrame, limit: int = 5) -> DataFrame:
    return with_company_name(newest(analyses, "analyzed_at", "analysis_id", limit), companies).select(
        "company_name", F.upper("recommendation").alias("recommendation"), "analyzed_at"
    )


def latest_per_company(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each company, combined before the shuffle."""
    row = F.struct(*analyses.columns)
    return (
        analyses.groupBy("company_id")
        .agg(F.max_by(row, F.struct("analyzed_at", "analysis_id")).alias("_latest"))
        .select("_latest.*")
    )


def company_list(companies: DataFrame) -> DataFrame:
    return companies.select(
        "company_id",
        "name",
        "industry",
        F.concat("name", F.lit(" ("), F.coalesce("industry", F.lit("N/A")), F.lit(")")).alias("display_name"),
    )


def document_list(documents: DataFrame) -> DataFrame:
    """Documents with a status word and their size in MB."""
    return documents.select(
        "company_id",
        "document_id",
        "filename",
        "document_type",
        F.when(F.coalesce("processed", F.lit(False)), "Processed").otherwise("Pending").alias("status"),
        fixed(F.col("file_size_bytes") / 1048576, 1).cast("double").alias("size_mb"),
    )


def documents_by_type(documents: DataFrame) -> DataFrame:
    """``document_list`` under a heading with the type and its count per company.

    Counts come from an aggregate that is joined back, so no group of documents is gathered.
    """
    keys = ["company_id", "document_type"]
    counts = documents.groupBy(*keys).agg(F.count("*").alias("n_documents"))
    heading = F.concat(title_case("document_type"), F.lit(" ("), F.col("n_documents").cast("string"), F.lit(")"))
    return document_list(documents).join(counts, keys).withColumn("heading", heading)


def documents_per_company(documents: DataFrame) -> DataFrame:
    return documents.groupBy("company_id").agg(F.count("*").alias("total_documents"))


def company_rollup(companies: DataFrame, documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Companies with ``total_documents`` and ``last_analyzed`` brought up to date."""
    analysed = analyses.groupBy("company_id").agg(F.max("analyzed_at").alias("last_analyzed"))
    kept = [name for name in companies.columns if name not in ("total_documents", "last_analyzed")]
    return (
        companies.select(*kept)
        .join(documents_per_company(documents), "company_id", "left")
        .join(analysed, "company_id", "left")
        .withColumn("total_documents", F.coalesce("total_documents", F.lit(0)))
    )


def rollup(companies: DataFrame, counts: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """Companies with ``total_documents``, summed from counts by day, and ``last_analyzed``, the latest of what they had and
    of ``analyses``."""
    totals = counts.groupBy("company_id").agg(F.sum("n_documents").cast("int").alias("_total"))
    joined = companies.join(totals, "company_id", "left")
    latest = F.col("last_analyzed")
    if analyses is not None:
        seen = analyses.groupBy("company_id").agg(F.max("analyzed_at").alias("_latest"))
        joined, latest = joined.join(seen, "company_id", "left"), F.greatest("last_analyzed", "_latest")
    made = {"total_documents": F.coalesce("_total", F.lit(0)), "last_analyzed": latest}
    return joined.withColumns(made).select(*companies.columns)


def financial_sums(metrics: DataFrame, *keys: str) -> DataFrame:
    """Sums and counts from which ``financial_summary`` follows; those of several deliveries can be added."""
    measures = {"revenue": "revenue", "burn_rate": "burn_rate", "runway": "runway_months"}
    return metrics.groupBy("company_id", *keys).agg(
        F.count(F.lit(1)).alias("metric_count"),
        *[F.sum(column).alias(f"sum_{name}") for name, column in measures.items()],
        *[F.count(column).alias(f"n_{name}") for name, column in measures.items()],
    )


def summary_of_sums(sums: DataFrame) -> DataFrame:
    """``financial_summary`` from sums of deliveries."""
    names = ("revenue", "burn_rate", "runway")
    return sums.groupBy("company_id").agg(
        F.sum("metric_count").alias("metric_count"),
        *[F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}")).alias(f"avg_{name}") for name in names],
    )
