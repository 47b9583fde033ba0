"""Work lists, registration and status of documents and companies, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.text import base_name, file_stem, parent_path


def work_list(documents: DataFrame) -> DataFrame:
    """Documents still to be processed; failed ones stay on the list."""
    return documents.filter(~F.coalesce(F.col("processed"), F.lit(False))).select(
        "document_id", "company_id", "filename", "file_path", "document_type", "file_type"
    )


def new_rows(arrived: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Arrived rows with a key not seen before, one of each. Copies are combined before the shuffle, which
    the join then shares."""
    return arrived.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*arrived.columns)


def upsert_companies(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """One row per company: the latest ``updated_at``, an arrived row before an existing one, and the
    earliest ``created_at``."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        arrived.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    columns = [name for name in both.columns if name != "_new"]
    latest = F.max_by(F.struct(*columns), F.struct("updated_at", "_new", "name"))
    return (
        both.groupBy("company_id")
        .agg(latest.alias("_latest"), F.min("created_at").alias("_created"))
        .select(*[F.col("_created").alias(c) if c == "created_at" else F.col(f"_latest.{c}").alias(c) for c in columns])
    )


def status_merge(documents: DataFrame, results: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Documents with the outcome of a batch (``document_id, success, error, page_count, has_tables,
    has_charts``).

    A success sets the counts and clears an earlier error; a failure records its error and leaves the
    document unprocessed, so that it is tried again.
    """
    outcome = results.select(
        "document_id",
        F.col("success").alias("_success"),
        F.col("error").alias("_error"),
        *[F.col(name).alias(f"_{name}") for name in ("page_count", "has_tables", "has_charts")],
    )
    done = F.coalesce(F.col("_success"), F.lit(False))
    failed = F.coalesce(~F.col("_success"), F.lit(False))
    stamp = F.current_timestamp() if processed_at is None else processed_at
    updates = {
        "processed": F.when(done, True).otherwise(F.col("processed")),
        "processed_at": F.when(done, stamp).otherwise(F.col("processed_at")),
        "processing_error": F.when(failed, F.col("_error")).when(~done, F.col("processing_error")),
    }
    for name in ("page_count", "has_tables", "has_charts"):
        updates[name] = F.when(done, F.col(f"_{name}")).otherwise(F.col(name))
    return documents.join(outcome, "document_id", "left").withColumns(updates).select(*documents.columns)


def storage_paths(documents: DataFrame, base: str) -> DataFrame:
    """Add ``storage_path``: ``<base>/<company>/<subfolder>/<file>``.

    Of documents with the same path the smallest id keeps it; the others get the first eight characters
    of their id behind the stem. The smallest id is an aggregate joined back, so a path that a third of
    all documents share is no single task.
    """
    folder = parent_path(F.coalesce(F.col("relative_path"), F.lit("")))
    place = F.concat_ws("/", F.lit(base), F.col("company_id"), F.nullif(folder, F.lit("")))
    placed = documents.withColumn("_folder", place).withColumn("_path", F.concat_ws("/", "_folder", "filename"))
    first = placed.groupBy("_path").agg(F.min("document_id").alias("_first"))
    suffix = F.expr("substring(filename, length(_stem) + 1)")
    renamed = F.concat(F.col("_folder"), F.lit("/"), F.col("_stem"), F.lit("_"), F.substring("document_id", 1, 8), suffix)
    return (
        placed.join(first, "_path")
        .withColumn("_stem", file_stem(base_name("filename")))
        .withColumn("storage_path", F.when(F.col("document_id") == F.col("_first"), F.col("_path")).otherwise(renamed))
        .select(*documents.columns, "storage_path")
    )
