"""Document files as manifest rows, and their content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.functions.constants import SUPPORTED_EXTENSIONS
from ledgerleaf.functions.text import base_name, file_suffix, html_text, html_title, strip, url_filename


def _relative_to(base: str, path: Column) -> Column:
    """Path below ``base``. Spark reports absolute URIs, so the part up to the base's own path is cut."""
    plain = base.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    return F.regexp_extract(path, r"\Q" + plain + r"\E/(.*)$", 1)


def scan_files(
    spark: SparkSession,
    folder: str,
    recursive: bool = True,
    extensions: Sequence[str] = SUPPORTED_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Files of a folder: ``path, relative_path, filename, file_type, file_size_bytes, modified_at, content``.

    Select no ``content`` and no file is opened. ``max_bytes`` is checked on the listing, too. A missing
    folder gives no rows; unreadable files are skipped.
    """
    folder = folder.rstrip("/")
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    exists = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
    files = reader.load(folder) if exists else spark.createDataFrame(
        [], "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    )
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    named = files.select(
        "path",
        _relative_to(folder, F.col("path")).alias("relative_path"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    ).withColumns({"filename": base_name("relative_path"), "file_type": file_suffix(base_name("relative_path"))})
    return named.filter(F.col("file_type").isin(*extensions))


def company_files(spark: SparkSession, base: str, **options) -> DataFrame:
    """Files of many companies at once, below ``<base>/<company folder>/``: adds ``company_folder``."""
    files = scan_files(spark, base, recursive=True, **options)
    inside = files.filter(F.col("relative_path").contains("/"))
    return inside.withColumn("company_folder", F.substring_index("relative_path", "/", 1)).withColumn(
        "relative_path", F.expr("substring(relative_path, length(company_folder) + 2)")
    )


def manifest(
    files: DataFrame,
    company_id: Column | str,
    uploaded_at: Column | None = None,
    hash_content: bool = False,
    with_content: bool = False,
) -> DataFrame:
    """Unclassified ``documents`` rows of scanned files.

    Ids follow the file's bytes with ``hash_content``, else its size and modification time, which needs
    the listing only.
    """
    version = (
        F.sha2("content", 256)
        if hash_content
        else F.concat_ws("/", F.col("file_size_bytes"), F.unix_micros("modified_at"))
    )
    return files.select(
        ids.document_id(company_id, "relative_path", version).alias("document_id"),
        (F.col(company_id) if isinstance(company_id, str) else company_id).alias("company_id"),
        "filename",
        F.col("path").alias("file_path"),
        "relative_path",
        F.lit(None).cast("string").alias("source_url"),
        "file_type",
        "file_size_bytes",
        F.lit(False).alias("processed"),
        (F.current_timestamp() if uploaded_at is None else uploaded_at).alias("uploaded_at"),
        *(["content"] if with_content else []),
    )


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file, one per line, trimmed, blank lines left out."""
    return spark.read.text(path).select(strip("value").alias("url")).filter(F.length("url") > 0)


def fetched_manifest(
    fetched: DataFrame,
    company_id: Column | str,
    url: str = "url",
    content: str = "content",
    disposition: str | None = None,
    uploaded_at: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Unclassified ``documents`` rows of fetched payloads (``url, content``); failed fetches (NULL) give none."""
    company = F.col(company_id) if isinstance(company_id, str) else company_id
    stamped = F.current_timestamp() if uploaded_at is None else uploaded_at
    name = url_filename(url, disposition, stamped)
    return fetched.filter(F.col(content).isNotNull()).withColumn("filename", name).select(
        ids.document_id(company, url, F.sha2(F.col(content).cast("binary"), 256)).alias("document_id"),
        company.alias("company_id"),
        "filename",
        F.col(url).alias("file_path"),
        F.lit(None).cast("string").alias("relative_path"),
        F.col(url).alias("source_url"),
        file_suffix("filename").alias("file_type"),
        F.octet_length(content).cast("long").alias("file_size_bytes"),
        F.lit(False).alias("processed"),
        stamped.alias("uploaded_at"),
        *keep,
    )


# Extensions by media type, as far as there are parsers for them.
MEDIA_TYPES = {
    "text/html": ".html",
    "application/xhtml+xml": ".html",
    "text/plain": ".txt",
    "text/markdown": ".md",
    "text/csv": ".csv",
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
}


def media_suffix(content: Column, named: Column, declared: Column | None = None) -> Column:
    """Extension that picks a payload's parser: by its declared media type, by how its bytes begin, or by its name."""
    head = F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1"))
    begins = (
        F.when(head.startswith("%pdf-"), ".pdf")
        .when(head.rlike(r"^[^\x21-\x7e]*(?:<!doctype\s+html|<html|<head|<body)"), ".html")
    )
    if declared is None:
        return F.coalesce(begins, named)
    known = F.create_map(*[F.lit(part) for pair in MEDIA_TYPES.items() for part in pair])
    return F.coalesce(known[F.lower(F.trim(F.substring_index(declared, ";", 1)))], begins, named)


def payload_files(
    fetched: DataFrame,
    company_id: Column | str,
    url: str = "url",
    content: str = "content",
    disposition: str | None = None,
    declared: str | None = None,
    uploaded_at: Column | None = None,
    with_content: bool = False,
) -> DataFrame:
    """Fetched payloads in the form that ``manifest`` gives files: their ``file_type`` is the parser they need, which the
    media type (column ``declared``, if any) or the bytes tell better than a URL. ``with_content`` adds the bytes."""
    rows = fetched.withColumn("_bytes", F.col(content).cast("binary"))
    extra = {"file_type": media_suffix(F.col("_bytes"), F.col("file_type"), None if declared is None else F.col(declared))}
    found = fetched_manifest(rows, company_id, url, content, disposition, uploaded_at, keep=("_bytes", *([declared] if declared else ())))
    named = [c for c in found.columns if c not in ("_bytes", declared)]
    made = found.withColumns(extra).select(*named, F.col("_bytes").alias("content"))
    return made if with_content else made.drop("content")


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the markup of web pages by ``title`` and ``text``."""
    return pages.withColumns({"title": html_title(html), "text": html_text(html)}).drop(html)


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole text files, one row each, with ``line_count``; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    decoded = files.select("path", decode_utf8("content").alias("text"))
    return decoded.withColumn("line_count", F.regexp_count("text", F.lit("\n")) + 1)


def decode_utf8(content: Column | str) -> Column:
    """Bytes as text without those that are no UTF-8."""
    raw = F.col(content) if isinstance(content, str) else content
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    )
