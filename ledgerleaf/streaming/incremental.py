"""Incremental processing: newly arrived documents run through the batch operators as micro-batches.

The stream's checkpoint remembers which input was taken. Documents that are delivered again are recognised by the ids in
the stream's state, which holds each for a horizon of time after it first arrived: no batch reads what the stream has
stored. Only where the state cannot know, for what other checkpoints stored in the same place and for documents that say
they are older than the horizon, ids are compared with the stored ones. One partition per batch makes repeated batches
harmless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerleaf.operators import metrics
from ledgerleaf.operators.chunk import chunk
from ledgerleaf.operators.classify import classify

DocumentsOf = Callable[[DataFrame], DataFrame]

# Files of a micro-batch, whose texts are written before its other tables are made of them.
FILES_PER_BATCH = 1000
# How long ids are kept in the state of a stream.
HORIZON = "7 days"


def _stored_ids(spark: SparkSession, path: str, but: Callable[[str], bool]) -> DataFrame | None:
    """Ids of the documents stored by batches, without those whose label meets ``but``; None if there are none. Which
    batches there are is seen from the folders."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []
    wanted = [name for name in names if name.startswith("batch=") and not but(name.removeprefix("batch="))]
    return spark.read.schema("document_id STRING").parquet(*(f"{path}/{name}" for name in wanted)) if wanted else None


def process_batch(
    arrived: DataFrame, target: str, label: str, stream: str | None = None, old: Column | None = None, unique: bool = False
) -> None:
    """Classify, chunk and measure a batch of ``document_id, company_id, filename, relative_path, text``.

    Documents that another batch has stored are left out. ``stream`` begins the labels of batches of which the caller
    knows the documents: their ids are read only for the rows that are ``old``, if there are any. ``unique`` says that no
    id occurs twice. Each batch owns the partition ``batch=<label>`` of every table and overwrites it, so a batch that
    broke off is repeated without checking chunk by chunk; its texts are written first and read from there by what follows.
    """
    spark = arrived.sparkSession

    def own(name: str) -> bool:
        return stream is not None and name.startswith(f"{stream}-")

    # Only ids are compared; texts move if some of them did arrive before, or twice.
    compared = [(arrived, _stored_ids(spark, f"{target}/documents", lambda name: name == label or own(name)))]
    if stream is not None and old is not None and not arrived.filter(old).isEmpty():
        known = _stored_ids(spark, f"{target}/documents", lambda name: name == label or not own(name))
        compared.append((arrived.filter(old), known))
    fresh = arrived
    for rows, known in compared:
        if known is not None:
            repeated = rows.select("document_id").distinct().join(known, "document_id", "left_semi")
            if not repeated.isEmpty():
                fresh = fresh.join(repeated, "document_id", "left_anti")
    if not unique and not arrived.groupBy("document_id").count().filter("count > 1").isEmpty():
        fresh = fresh.dropDuplicates(["document_id"])
    classified = classify(fresh)
    texts = f"{target}/texts/batch={label}"
    classified.write.mode("overwrite").parquet(texts)
    batch = spark.read.schema(classified.schema).parquet(texts)
    chunks = chunk(batch.select("document_id", "company_id", "document_type", "text"))
    found = metrics.text_metrics(batch.filter(F.col("document_type") == "financial"))
    for name, rows in (("chunks", chunks), ("metrics", found), ("documents", batch.drop("text"))):
        rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={label}")


def incremental(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    documents_of: DocumentsOf = lambda rows: rows,
    files_per_batch: int | None = FILES_PER_BATCH,
    horizon: str = HORIZON,
    created_at: str | None = None,
) -> StreamingQuery:
    """Start a run over what has arrived at ``source`` (parquet) since the last run, and end with it.

    ``documents_of`` projects source rows to the columns ``process_batch`` takes. Ids are kept for ``horizon`` after they
    arrived. If documents may be delivered again later than that, ``created_at`` names a column with their time: those
    created before the horizon are compared with the stored ones.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    # Batch numbers count within a checkpoint.
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    old = None if created_at is None else F.col(created_at) < F.current_timestamp() - F.expr(f"INTERVAL {horizon}")

    def handle(batch: DataFrame, number: int) -> None:
        process_batch(batch.drop("_arrived"), target, f"{stream}-{number}", stream, old, unique=True)

    # Arrival is the time of the batch, so no row is too late for the state.
    arrived = documents_of(reader.parquet(source)).withColumn("_arrived", F.current_timestamp())
    first = arrived.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["document_id"])
    return (
        first.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
