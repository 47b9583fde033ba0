"""Processing: registered files to text, chunks, metrics, status and embeddings, all documents in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import schemas
from ledgerleaf.functions.constants import CHUNK_OVERLAP, CHUNK_SIZE
from ledgerleaf.operators import metrics, report, retrieve
from ledgerleaf.operators.chunk import chunk, heading_offsets, page_at, title_at
from ledgerleaf.operators.generate import Generator
from ledgerleaf.operators.pages import extracted_pages
from ledgerleaf.operators.report import run_summary
from ledgerleaf.operators.status import work_list
from ledgerleaf.session import stored
from ledgerleaf.sinks import tables
from ledgerleaf.sources import parsers


# Ids of at most this many unprocessed documents are broadcast to pick their files.
MAX_SHARED_DOCUMENTS = 1_000_000
UNREADABLE = "File could not be read"


def sized_list(listed: DataFrame, max_shared: int = MAX_SHARED_DOCUMENTS) -> DataFrame:
    """A narrow list, marked for broadcast if it is counted to be short enough: texts and file bytes then stay where they
    are read. A longer one is met in a shuffle join."""
    return F.broadcast(listed) if listed.limit(max_shared + 1).count() <= max_shared else listed


def files_to_do(files: DataFrame, todo: DataFrame, max_shared: int = MAX_SHARED_DOCUMENTS) -> DataFrame:
    """Files of the work list, and no others."""
    return files.join(sized_list(todo.select("document_id"), max_shared), "document_id", "left_semi")


def once(files: DataFrame) -> DataFrame:
    """Each document once: the same payload may have been fetched several times. Only ids are compared; of documents that
    occur more than once the bytes are shuffled."""
    repeated = files.groupBy("document_id").count().filter("count > 1").select("document_id")
    if repeated.isEmpty():
        return files
    copies = files.join(repeated, "document_id", "left_semi").dropDuplicates(["document_id"])
    return files.join(repeated, "document_id", "left_anti").unionByName(copies)


def document_metrics(
    extracted: DataFrame, fn: Generator | None = None, document_type: str = "financial"
) -> DataFrame:
    """Long metrics of the financial documents: from tables, prose and, with ``fn``, a text generator."""
    financial = extracted.filter(F.col("success") & (F.col("document_type") == document_type))
    texts = financial.select("document_id", "company_id", F.col("full_text").alias("text"))
    parts = [metrics.table_metrics(parsers.extracted_cells(financial)), metrics.text_metrics(texts)]
    if fn is not None:
        parts.append(metrics.model_metrics(texts, fn))
    return metrics.combine(*parts)


def document_chunks(extracted: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of the readable documents, with company, type, page and section."""
    texts = extracted.filter("success").select(
        "document_id", "company_id", "document_type", "page_count", "has_tables", F.col("full_text").alias("text"),
        "page_starts", heading_offsets("full_text").alias("headings"),
    )
    places = {"page_number": page_at("page_starts"), "section_title": title_at("headings")}
    cut = chunk(texts, size=size, overlap=overlap, places=places, drop=("page_starts", "headings"))
    return cut.withColumn("created_at", F.current_timestamp())


def _extracted(
    todo: DataFrame, files: DataFrame | None, pages: DataFrame | None, parser_registry: dict[str, parsers.Parser] | None
) -> DataFrame:
    """Texts of the listed documents, from files or, where a document is given page by page, from its pages."""
    keep = ("company_id", "document_type")
    parts = []
    empty = todo.sparkSession.createDataFrame([], ", ".join(f"{name} STRING" for name in keep) + ", " + schemas.EXTRACTED)
    if pages is not None:
        given = pages.drop(*keep).join(sized_list(todo.select("document_id", *keep)), "document_id")
        parts.append(extracted_pages(given, keep))
        todo = todo.join(pages.select("document_id").distinct(), "document_id", "left_anti")
    if files is not None:
        parts.append(parsers.extract(once(files_to_do(files, todo)), parser_registry, keep=keep))
    return reduce(DataFrame.unionByName, parts, empty)


def unreadable(todo: DataFrame, listed: DataFrame, extracted: DataFrame) -> DataFrame:
    """Error rows for the documents of the work list that were ``listed`` as files and of which no bytes arrived: files that
    were deleted since, torn or locked. Only ids are compared."""
    keep = ("company_id", "document_type")
    absent = todo.select("document_id", *keep).join(extracted.select("document_id"), "document_id", "left_anti")
    lost = absent.join(listed.select("document_id").distinct(), "document_id", "left_semi")
    made = {"success": F.lit(False), "error": F.lit(UNREADABLE)}
    return lost.withColumns(made).select("document_id", *keep, "success", "error")


def process_documents(
    spark: SparkSession,
    database: str,
    files: DataFrame | None = None,
    parser_registry: dict[str, parsers.Parser] | None = None,
    fn: Generator | None = None,
    embed: retrieve.Embedder = retrieve.hashed_embedding,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    pages: DataFrame | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Process the unprocessed documents among ``files`` (``document_id, company_id, document_type, file_type,
    content``, see ``classified_folder``) and ``pages`` (``document_id, page, text, n_images``).

    Files are parsed where they are read; pages are brought together by document. The texts are written to the shared
    folder once and read by each of the following steps. Chunks, their embeddings and metrics are saved before the
    status, so a run that breaks off is simply repeated: documents whose rows were saved are recognised by their ids,
    which alone are compared. Each chunk and vector is moved once, to its bucket. A file whose bytes do not arrive is
    an error of its document, which stays on the list for the next run. Returns the run's summary.
    """
    todo = work_list(spark.table(f"{database}.documents"))
    extracted = stored(_extracted(todo, files, pages, parser_registry), "extracted")
    if listed is not None:
        lost = stored(unreadable(todo, listed, extracted), "lost")
        extracted = extracted.unionByName(lost, allowMissingColumns=True)
    chunks = stored(document_chunks(extracted, size, overlap), "chunks")
    found = stored(metrics.to_wide(document_metrics(extracted, fn)), "metrics")

    tables.append_documents(chunks, f"{database}.document_chunks")
    sync_embeddings(spark, database, embed)
    tables.append_new(found, f"{database}.financial_metrics")
    update_periods(spark, database)
    results = extracted.select("document_id", "success", "error", "page_count", "has_tables", "has_charts")
    tables.mark_documents(results, f"{database}.documents")
    return run_summary(extracted.select(F.col("success").alias("processed")), chunks, found)


def update_periods(spark: SparkSession, database: str) -> int:
    """Bring growth, ratios and sums of companies up to date with the deliveries of metrics that were not taken yet; returns
    how many deliveries. Only these, and the shares of the companies in them, are read; merging a delivery again changes
    nothing."""
    waiting = tables.pending(spark, database, "financial_metrics", "periods")
    if not waiting:
        return 0
    arrived = spark.table(f"{database}.financial_metrics").filter(F.col("delivery").isin(*waiting))
    share = F.pmod(F.xxhash64("company_id"), F.lit(schemas.SHARES)).cast("int")
    touched = [row[0] for row in arrived.select(share.alias("share")).distinct().collect()]
    periods = spark.table(f"{database}.period_metrics").filter(F.col("share").isin(*touched))
    known = periods.select("company_id", "period", *metrics.PERIOD_BASES)
    merged = metrics.merged_periods(known.unionByName(metrics.wide_periods(arrived)))
    grown = metrics.period_growth(merged).withColumn("share", share)
    tables.replace(grown, f"{database}.period_metrics", partitions_only=True)
    sums = report.financial_sums(arrived, "delivery")
    tables.append_by_delivery(sums, f"{database}.metric_sums")
    tables.take(spark, database, "periods", waiting)
    return len(waiting)


def pending_embeddings(
    spark: SparkSession, database: str, embed: retrieve.Embedder = retrieve.hashed_embedding
) -> DataFrame | None:
    """Vectors of the deliveries of chunks that have none yet, or None. Which these are follows from the catalog: no
    stored row is compared, and only files of these deliveries are read."""
    chunks = f"{database}.document_chunks"
    waiting = tables.partitions(spark, chunks) - tables.partitions(spark, f"{database}.chunk_embeddings")
    if not waiting:
        return None
    rows = spark.table(chunks).filter(F.col("delivery").isin(*sorted(waiting)))
    vectors = embed(rows.select("chunk_id", "company_id", "text", "delivery"), "text", "embedding").drop("text")
    return retrieve.with_slots(vectors, rows, ("delivery", "company_id"))


def sync_embeddings(
    spark: SparkSession, database: str, embed: retrieve.Embedder = retrieve.hashed_embedding
) -> int:
    """Embed the deliveries of chunks that have no vectors yet; returns how many deliveries. Their vectors become visible
    together, as deliveries of the same names, which are thereby done."""
    missing = pending_embeddings(spark, database, embed)
    if missing is None:
        return 0
    before = len(tables.partitions(spark, f"{database}.chunk_embeddings"))
    tables.append_by_delivery(missing, f"{database}.chunk_embeddings")
    return len(tables.partitions(spark, f"{database}.chunk_embeddings")) - before
