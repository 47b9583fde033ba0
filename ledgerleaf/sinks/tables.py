"""Managed tables: creation, keyed appends and replacement.

Every write is keyed by deterministic ids, so a run that is repeated after a failure adds nothing twice.

Files are written to a folder of their own first and only then become part of a table, by one statement to the catalog:
an append is a new partition (its ``delivery``), a replacement points the table, or the days it touches, to the new
files. A run that breaks off before leaves the table as it was, and who reads a table meanwhile reads the files that it
pointed to; ``vacuum`` deletes the folders that no table points to any more.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import schemas
from ledgerleaf.operators.report import rollup, table_counts
from ledgerleaf.operators.status import new_rows, status_merge, upsert_companies
from ledgerleaf.session import stored, write_buckets

KEYS = {
    "companies": "company_id",
    "documents": "document_id",
    "financial_metrics": "metric_id",
    "document_chunks": "chunk_id",
    "chunk_embeddings": "chunk_id",
    "investment_analysis": "analysis_id",
}


def create_tables(
    spark: SparkSession, database: str, names: Iterable[str] = tuple(schemas.TABLES), buckets: int = 64
) -> None:
    """Create the database and those of the tables that are missing, chunks and vectors in ``buckets``: as many as tasks
    are to read them.

    Documents are partitioned by upload day, so that a status update rewrites the days it touches. No
    table is partitioned by company: a few huge and very many tiny partitions would be the result.
    Readers that filter by company profit from sorted files instead (see ``append``). The other large tables are
    partitioned by delivery, one for each run.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        # Files cannot enforce NOT NULL; ``quality.check_columns`` reports it.
        columns = re.sub(r"\s+NOT NULL", "", schemas.TABLES[name])
        partition = f"PARTITIONED BY ({schemas.PARTITIONS[name]})" if name in schemas.PARTITIONS else ""
        if name in schemas.BUCKETS:
            partition += f" CLUSTERED BY ({', '.join(schemas.BUCKETS[name])}) INTO {buckets} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet {partition}")


def drop_tables(spark: SparkSession, database: str, names: Iterable[str] = tuple(schemas.TABLES)) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def count_tables(spark: SparkSession, database: str) -> DataFrame:
    """Number of rows of every table of the database."""
    names = [table.name for table in spark.catalog.listTables(database)]
    return table_counts({name: spark.table(f"{database}.{name}") for name in names})


def new_delivery() -> str:
    """Name of an append; later ones sort behind earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _partition(table: str) -> str | None:
    return schemas.PARTITIONS.get(table.rsplit(".", 1)[-1])


def _described(spark: SparkSession, field: str, *described: str) -> str:
    rows = spark.sql(" ".join(described)).collect()
    return next(row[1] for row in rows if row[0].strip(": ") == field)


def _place(spark: SparkSession, *described: str) -> str:
    return _described(spark, "Location", *described).rstrip("/")


def _versions(spark: SparkSession, database: str) -> str:
    return f"{_place(spark, 'DESCRIBE DATABASE', database)}/versions"


def _new_version(spark: SparkSession, table: str) -> str:
    database, _, name = table.rpartition(".")
    return f"{_versions(spark, database or spark.catalog.currentDatabase())}/{name}-{uuid.uuid4().hex}"


def _clause(values: Mapping[str, object]) -> str:
    return "PARTITION (" + ", ".join(f"{name} = '{value}'" for name, value in values.items()) + ")"


def _point(spark: SparkSession, table: str, places: Mapping[str | None, str]) -> None:
    """Make a table (None), or partitions of it, consist of the files at new places."""
    column = _partition(table)
    known = set() if column is None else partitions(spark, table)
    added = []
    for value, place in places.items():
        if value is None:
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
        elif value in known:
            spark.sql(f"ALTER TABLE {table} {_clause({column: value})} SET LOCATION '{place}'")
        else:
            added.append(f"{_clause({column: value})} LOCATION '{place}'")
    if added:
        spark.sql(f"ALTER TABLE {table} ADD {' '.join(added)}")


def partitions(spark: SparkSession, table: str) -> set[str]:
    """Values of a table's partition column, as the catalog has them; no file is read."""
    return {row[0].split("=", 1)[1] for row in spark.sql(f"SHOW PARTITIONS {table}").collect()}


def vacuum(spark: SparkSession, database: str) -> int:
    """Delete the folders below the database that no table points to; returns how many. Only for times when nobody writes,
    or still reads what was there before the last write."""
    used = set()
    for table in spark.catalog.listTables(database):
        name = f"{database}.{table.name}"
        used.add(_place(spark, "DESCRIBE TABLE EXTENDED", name))
        column = _partition(name)
        for value in partitions(spark, name) if column else ():
            used.add(_place(spark, "DESCRIBE TABLE EXTENDED", name, _clause({column: value})))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_versions(spark, database))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [status.getPath() for status in system.listStatus(path)] if system.exists(path) else []
    names = {place.rsplit("/versions/", 1)[-1].split("/", 1)[0] for place in used}
    unused = [folder for folder in folders if folder.getName() not in names]
    for folder in unused:
        system.delete(folder, True)
    return len(unused)


def _fitted(df: DataFrame, table: DataFrame, but: str | None = None) -> DataFrame:
    """Columns of the table in its order, ``but`` one; derived ones are computed, missing ones become NULL."""

    def column(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        return F.expr(schemas.DERIVED[name]) if name in schemas.DERIVED else F.lit(None)

    fields = [field for field in table.schema.fields if field.name != but]
    return df.select(*[column(field.name).cast(field.dataType).alias(field.name) for field in fields])


def append(df: DataFrame, table: str, delivery: str | None = None) -> int:
    """Append all rows; returns how many. Rows are sorted by company within files where there is one, so
    that a filter on a company skips most row groups. A table of deliveries gets one more, whole or not at all."""
    spark = df.sparkSession
    by_delivery = _partition(table) == "delivery"
    fitted = _fitted(df, spark.table(table), "delivery" if by_delivery else None)
    if "company_id" in fitted.columns:
        fitted = fitted.sortWithinPartitions("company_id")
    if not by_delivery:
        seen = Observation()
        fitted.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(table)
        return seen.get["n"]
    place = _new_version(spark, table)
    _write(fitted, place, table)
    # Numbers of rows are in the files' footers.
    rows = spark.read.schema(fitted.schema).parquet(place).count()
    if rows:
        _point(spark, table, {delivery or new_delivery(): place})
    return rows


def _write(df: DataFrame, place: str, table: str, by: Iterable[str] = ()) -> None:
    keys = schemas.BUCKETS.get(table.rsplit(".", 1)[-1])
    if keys is None:
        df.write.partitionBy(*by).parquet(place)
        return
    buckets = int(_described(df.sparkSession, "Num Buckets", "DESCRIBE TABLE EXTENDED", table))
    # Each row is moved once, here.
    write_buckets(df.repartition(buckets, *keys), place, keys, buckets, by)


def _written(df: DataFrame, place: str, table: str) -> dict[str, str]:
    """Write rows by the table's partition column; its values and where the files of each are."""
    column = _partition(table)
    _write(df, place, table, [column])
    found = df.sparkSession.read.schema(df.schema).parquet(place).select(F.col(column).cast("string")).distinct()
    return {row[0]: f"{place}/{column}={row[0]}" for row in found.collect()}


def append_by_delivery(df: DataFrame, table: str) -> None:
    """Append rows that name the delivery they belong to; all of these become visible together. A delivery that the table
    has already is replaced."""
    spark = df.sparkSession
    place = _new_version(spark, table)
    _point(spark, table, _written(_fitted(df, spark.table(table)), place, table))


def append_new(df: DataFrame, table: str, key: str | None = None, delivery: str | None = None) -> int:
    """Append the rows whose key the table does not have yet, one of each; returns how many.

    Hashes of keys are compared first, so ``df`` is read twice. Only rows whose hash occurs more than once are shuffled and
    compared by their keys: of a run that is not repeated, none.
    """
    spark = df.sparkSession
    key = key or KEYS[table.rsplit(".", 1)[-1]]
    hashed = F.xxhash64(key)
    hashes = df.select(hashed.alias("_hash"), F.lit(True).alias("_arrived")).unionByName(
        spark.table(table).select(hashed.alias("_hash"), F.lit(False).alias("_arrived"))
    )
    again = hashes.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_arrived").alias("_arrived"))
    again = stored(again.filter("_arrived AND _n > 1").select("_hash"), "hashes")
    if again.isEmpty():
        return append(df, table, delivery)
    rows = df.withColumn("_hash", hashed)
    met = new_rows(rows.join(again, "_hash", "left_semi").select(*df.columns), spark.table(table), key)
    return append(rows.join(again, "_hash", "left_anti").select(*df.columns).unionByName(met), table, delivery)


def without_stored(df: DataFrame, table: str, key: str) -> DataFrame:
    """The rows of ``df`` (a stored frame) whose key the table does not have. Only keys are compared; other columns
    are shuffled only if some keys are there already, as after a run that broke off."""
    known = df.sparkSession.table(table).select(key)
    repeated = df.select(key).distinct().join(known, key, "left_semi")
    return df if repeated.isEmpty() else df.join(repeated, key, "left_anti")


def append_documents(df: DataFrame, table: str, delivery: str | None = None) -> int:
    """Append the rows of the documents the table has no rows of yet; returns how many.

    An append is one delivery, so a document's rows are there as a whole or not at all.
    """
    return append(without_stored(df, table, "document_id"), table, delivery)


def replace(df: DataFrame, table: str, partitions_only: bool = False) -> None:
    """Replace a table, or only the days that occur in ``df``, by rows that may be derived from it.

    The rows are complete before the table, or one day after the other, points to them.
    """
    spark = df.sparkSession
    place = _new_version(spark, table)
    column = _partition(table)
    fitted = _fitted(df, spark.table(table))
    if column is None:
        fitted.write.parquet(place)
        _point(spark, table, {None: place})
        return
    places = _written(fitted, place, table)
    _point(spark, table, places)
    for value in set() if partitions_only else partitions(spark, table) - set(places):
        spark.sql(f"ALTER TABLE {table} DROP {_clause({column: value})}")


def register_companies(companies: DataFrame, table: str) -> None:
    """Insert or update companies (see ``upsert_companies``)."""
    existing = companies.sparkSession.table(table)
    stamped = companies.withColumns(
        {
            "created_at": F.coalesce("created_at", F.current_timestamp())
            if "created_at" in companies.columns
            else F.current_timestamp(),
            "updated_at": F.coalesce("updated_at", F.current_timestamp())
            if "updated_at" in companies.columns
            else F.current_timestamp(),
        }
    )
    replace(upsert_companies(existing, stamped), table)


def register_documents(documents: DataFrame, table: str) -> int:
    return append_new(documents, table)


def pending(spark: SparkSession, database: str, source: str, consumer: str) -> list[str]:
    """Deliveries of the table ``source`` that ``consumer`` has not taken yet, by the catalog and the list of cursors."""
    taken = spark.table(f"{database}.cursors").filter(F.col("consumer") == consumer).select("taken").collect()
    return sorted(partitions(spark, f"{database}.{source}") - {row[0] for row in taken})


def take(spark: SparkSession, database: str, consumer: str, deliveries: Iterable[str]) -> None:
    """Note deliveries as taken. What a consumer does with them is done before and may be repeated."""
    rows = [(consumer, name) for name in deliveries]
    append(spark.createDataFrame(rows, "consumer string, taken string"), f"{database}.cursors")


def mark_documents(results: DataFrame, table: str) -> None:
    """Record the outcome of a batch in the documents table: one pass over the days it touches."""
    documents = results.sparkSession.table(table)
    touched = documents.join(results.select("document_id"), "document_id", "left_semi").select("upload_day").distinct()
    days = [row["upload_day"] for row in touched.collect()]
    if days:
        replace(status_merge(documents.filter(F.col("upload_day").isin(days)), results), table, partitions_only=True)


def update_counts(spark: SparkSession, database: str, documents: DataFrame | None = None) -> None:
    """Count the documents of each company on the days that occur in ``documents`` (all days, if None): a day's counts are
    replaced as a whole, so counting one again changes nothing."""
    stored_documents = spark.table(f"{database}.documents")
    if documents is not None:
        days = documents.select(F.expr(schemas.DERIVED["upload_day"]).alias("day")).distinct().collect()
        if not days:
            return
        stored_documents = stored_documents.filter(F.col("upload_day").isin(*[row["day"] for row in days]))
    counts = stored_documents.groupBy("company_id", "upload_day").agg(F.count(F.lit(1)).alias("n_documents"))
    replace(counts, f"{database}.document_counts", partitions_only=True)


def update_rollup(spark: SparkSession, database: str, documents: DataFrame | None = None, analyses: DataFrame | None = None) -> None:
    """Bring ``total_documents`` and ``last_analyzed`` of all companies up to date in their table after a run.

    Only the days of the run's ``documents`` are counted again, and of ``analyses`` only the run's own are looked at; the
    rest is in the counts by day and in the companies. ``documents`` None counts all days.
    """
    if documents is not None or analyses is None:
        update_counts(spark, database, documents)
    latest = spark.table(f"{database}.investment_analysis") if analyses is None and documents is None else analyses
    rolled = rollup(spark.table(f"{database}.companies"), spark.table(f"{database}.document_counts"), latest)
    replace(rolled, f"{database}.companies")


def save_analyses(analyses: DataFrame, dimensions: DataFrame, database: str) -> int:
    """Append new analyses and their dimensions; dimensions first, so that no analysis lacks them."""
    spark = analyses.sparkSession
    known = spark.table(f"{database}.analysis_dimensions").select("analysis_id").distinct()
    append(dimensions.join(known, "analysis_id", "left_anti"), f"{database}.analysis_dimensions")
    return append_new(analyses, f"{database}.investment_analysis")


class StoredReplies:
    """Replies of a generator, kept by the content of their prompts and the model that gave them: what was asked once is not
    asked again, by whichever run. Each run adds one delivery."""

    def __init__(self, spark: SparkSession, table: str, model: str) -> None:
        self.spark, self.table, self.model = spark, table, model

    def known(self) -> DataFrame:
        rows = self.spark.table(self.table).filter(F.col("model") == self.model)
        return rows.select("prompt_key", "reply")

    def add(self, replies: DataFrame) -> int:
        """Keep new replies (``prompt_key, reply``); of two runs that asked the same at once either reply may be used."""
        return append(replies.withColumns({"model": F.lit(self.model), "asked_at": F.current_timestamp()}), self.table)
