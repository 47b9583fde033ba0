"""Ingestion: folders or fetched pages of many companies to registered, classified documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.operators.classify import classify
from ledgerleaf.operators.report import ingestion_summary
from ledgerleaf.operators.status import new_rows, storage_paths
from ledgerleaf.session import cut, stored
from ledgerleaf.sinks import tables
from ledgerleaf.sources import files


def classified_folder(
    spark: SparkSession,
    base: str,
    companies: DataFrame,
    storage: str | None = None,
    hash_content: bool = False,
    with_content: bool = False,
) -> DataFrame:
    """Classified ``documents`` rows of all files below ``<base>/<folder>/`` for ``companies`` (``folder, name``).

    ``with_content`` adds the bytes, as ``process_documents`` takes them. Id, company and type all follow
    from the path, so bytes are parsed where they are read.
    """
    known = companies.select(F.col("folder").alias("company_folder"), ids.company_id("name").alias("_company"))
    found = files.company_files(spark, base).join(known, "company_folder")
    documents = classify(files.manifest(found, "_company", hash_content=hash_content, with_content=with_content))
    if storage is None:
        return documents
    placed = storage_paths(documents, storage)
    return placed.withColumn("file_path", F.col("storage_path")).drop("storage_path")


def ingest_folders(
    spark: SparkSession, base: str, companies: DataFrame, database: str, hash_content: bool = False
) -> DataFrame:
    """Register companies (``folder, name`` and any of their columns) and their files.

    Returns the summary per company: documents found, how many of them are new, and their types.
    """
    tables.register_companies(
        companies.withColumn("company_id", ids.company_id("name")).drop("folder"), f"{database}.companies"
    )
    # Listed once, whatever the steps below need of it.
    documents = stored(classified_folder(spark, base, companies, hash_content=hash_content), "manifest")
    existing = spark.table(f"{database}.documents")
    fresh = new_rows(documents.select("document_id", "company_id"), existing, "document_id")
    counted = fresh.groupBy("company_id").agg(F.count("*").alias("documents_registered"))
    names = companies.select(ids.company_id("name").alias("company_id"), F.col("name").alias("company_name"))
    summary = (
        names.join(ingestion_summary(documents), "company_id", "left")
        .join(counted, "company_id", "left")
        .select(
            "company_id",
            "company_name",
            F.coalesce("documents_found", F.lit(0)).alias("documents_found"),
            F.coalesce("documents_registered", F.lit(0)).alias("documents_registered"),
            "document_types",
        )
    )
    # The summary has a row per company; it is fixed before the registration changes what is new.
    summary = cut(summary)
    tables.register_documents(documents, f"{database}.documents")
    tables.update_rollup(spark, database, documents)
    return summary


def classified_payloads(fetched: DataFrame, company: str, with_content: bool = False, **columns: object) -> DataFrame:
    """Classified ``documents`` rows of fetched payloads (``url, content`` and the company id column ``company``; see
    ``files.payload_files`` for other ``columns``). ``with_content`` adds the bytes, as ``process_documents`` takes them."""
    return classify(files.payload_files(fetched, company, with_content=with_content, **columns), path="source_url")


def ingest_fetched(fetched: DataFrame, company: str, database: str, **columns: object) -> int:
    """Register fetched payloads; returns how many are new. Payloads are read once, for their ids."""
    documents = stored(classified_payloads(fetched, company, **columns), "manifest")
    return tables.register_documents(documents, f"{database}.documents")
