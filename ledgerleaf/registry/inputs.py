"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.operators.chunk import chunk
from ledgerleaf.operators.classify import classify
from ledgerleaf.session import spread

_TITLES = (
    "Q1_2024_P&L", "balance sheet 2024", "Series A Pitch", "Architecture_Overview", "Cap Table", "Terms_of_Service",
    "Product_Roadmap", "API documentation", "notes", "Investor Deck", "user story backlog", "scan",
)
_EXTENSIONS = (".xlsx", ".pdf", ".PDF", ".docx", ".md", ".csv", ".txt", ".pptx", ".doc", ".xls")
_FOLDERS = ("financials/", "pitch_deck/", "technical/", "legal/", "product/", "misc/2024/", "")
_STATEMENT_ROWS = (
    "Total Revenue", "Gross Margin", "Net income", "Cash balance", "EBITDA margin", "Headcount (FTE)", "Monthly burn",
)
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _seconds_after_start(number: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + number)


def start_of(number: str) -> Column:
    """A time that follows the number."""
    return _seconds_after_start(F.col(number).cast("long"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_of(table(spark, sf_dir, "documents"))


def manifest_of(documents: DataFrame) -> DataFrame:
    """Documents with company, file name, folder and processing state."""
    doc = F.col("doc_id")
    return (
        documents
        .withColumn("filename", F.concat(_pick(_TITLES, doc), F.lit("_"), doc.cast("string"), _pick(_EXTENSIONS, doc)))
        .select(
            "doc_id",
            doc.cast("string").alias("document_id"),
            ids.company_id("source").alias("company_id"),
            "filename",
            F.concat(_pick(_FOLDERS, doc), F.col("filename")).alias("relative_path"),
            F.lower(_pick(_EXTENSIONS, doc)).alias("file_type"),
            F.col("n_chars").alias("file_size_bytes"),
            _seconds_after_start(doc).alias("uploaded_at"),
            (doc % 5 != 0).alias("processed"),
            F.when(doc % 20 == 0, "Unsupported file type: .pptx").alias("processing_error"),
            F.ceil(F.col("n_chars") / 3000.0).cast("int").alias("page_count"),
            "text",
        )
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(manifest(spark, sf_dir))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(first.alias("first_doc"))
        .select(
            ids.company_id("source").alias("company_id"),
            F.col("source").alias("name"),
            F.when(F.length("source") % 2 == 0, "SaaS").otherwise("FinTech").alias("industry"),
            _pick(("seed", "series_a", "growth"), F.col("first_doc")).alias("stage"),
            _seconds_after_start(F.col("first_doc")).alias("created_at"),
        )
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement tables in long form: one per supplier, one column per quarter."""
    item = table(spark, sf_dir, "lineitem")
    per_quarter = item.groupBy(
        F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")
    ).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    period = F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(" "), F.col("y").cast("string"))
    n = F.col("n").cast("string")
    values = (
        F.concat(F.lit("$"), F.floor(F.col("cents") / 100000).cast("string"), F.lit("K")),
        F.concat((F.col("n") % 90).cast("string"), F.lit("%")),
        F.concat(F.lit("("), n, F.lit(",000)")),
        F.concat((F.col("n") * 3).cast("string"), F.lit(".5M")),
        F.lit("n/a"),
        n,
        F.concat(F.lit("€"), n, F.lit("k")),
    )
    rows = F.array(
        *[
            F.struct(
                period.alias("col_name"), (F.col("y") * 4 + F.col("q")).alias("col_index"), F.lit(i).alias("row_index"), F.lit(label).alias("row_label"), value.alias("value")
            )
            for i, (label, value) in enumerate(zip(_STATEMENT_ROWS, values))
        ]
    )
    filled = per_quarter.select("s", F.inline(rows))
    notes = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("s"),
        F.lit("Comment").alias("col_name"),
        F.lit(1).alias("col_index"),
        F.lit(7).alias("row_index"),
        F.lit("Notes").alias("row_label"),
        F.lit("see annex").alias("value"),
    )
    return filled.unionByName(notes).select(
        F.concat(F.lit("stmt_"), F.col("s").cast("string")).alias("document_id"),
        ids.company_id(F.concat(F.lit("s"), (F.col("s") % 20).cast("string"))).alias("company_id"),
        F.lit(0).alias("table_index"),
        "row_index",
        "col_index",
        "row_label",
        "col_name",
        "value",
    )


def statement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose with metrics, one update per order."""
    key = F.col("o_orderkey")

    def s(column: Column) -> Column:
        return column.cast("string")

    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ord_"), s(key)).alias("document_id"),
        ids.company_id(F.concat(F.lit("s"), s(F.col("o_custkey") % 20))).alias("company_id"),
        F.concat(
            F.lit("Update. Revenue: $"), s(F.round("o_totalprice").cast("long")),
            _pick(("K", " M", "b", ""), key),
            F.lit(". Burn rate: 1,"), s(key % 900 + 100), F.lit(".5K; runway: "), s(key % 24 + 1),
            _pick((" months", " years"), key),
            F.lit(". Gross margin: "), s(key % 100), F.lit("%. CAC: $"), s(key % 50 + 50),
            F.lit(". LTV "), s(key % 7 * 100),
            F.when(key % 5 == 0, ". Cash on hand: 12,000. Sales: 7").otherwise(""),
            F.lit("."),
        ).alias("text"),
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw scoring reply per supplier and dimension; some fenced, some unusable."""
    from ledgerleaf.functions.constants import DIMENSIONS

    listed = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.lit(spec["weight"]).alias("weight"), F.lit(i).alias("ord"))
            for i, (name, spec) in enumerate(DIMENSIONS.items())
        ]
    )
    key, order = F.col("company_id"), F.col("ord")
    tenths = (key * 37 + order * 53) % 101
    body = F.concat(
        F.lit('{"score": '), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"),
        F.lit(', "reasoning": "r'), order.cast("string"), F.lit('", "key_findings": ["a'), order.cast("string"),
        F.lit('", "b", "c"]}'),
    )
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").alias("company_id"), F.inline(listed))
        .withColumn(
            "reply",
            F.when((key + order) % 11 == 0, "no json here").when(key % 2 == 0, fenced).otherwise(body),
        )
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a turn is a page under a heading."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.concat(F.lit("# "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text")).alias(
            "text"
        ),
        (F.col("turn") % 3).cast("int").alias("n_images"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two analyses per supplier that differ in time; key and time follow the supplier."""
    key = F.col("s_suppkey")
    runs = F.array(*[F.struct(F.lit(i).alias("run")) for i in range(2)])
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", "s_acctbal", F.inline(runs))
        .select(
            F.concat(key.cast("string"), F.lit("_"), F.col("run").cast("string")).alias("analysis_id"),
            ids.company_id(F.concat(F.lit("src"), (key % 20).cast("string"))).alias("company_id"),
            _pick(("strong_buy", "buy", "hold", "pass", "sell"), key + F.col("run")).alias("recommendation"),
            F.round(F.abs("s_acctbal") / 1000, 2).alias("overall_score"),
            _seconds_after_start(key * 7 % 1000 * 60 + F.col("run")).alias("analyzed_at"),
        )
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, with company and type."""
    documents = classify(spread(manifest(spark, sf_dir).select(
        "document_id", "company_id", "filename", "relative_path", "text", "uploaded_at"
    )))
    chunks = chunk(documents.select("document_id", "company_id", "document_type", "uploaded_at", "text"))
    return chunks.withColumnRenamed("uploaded_at", "created_at")


# Bytes of text that are counted at once.
_COUNTED = 1_000_000


def letter_counts(texts: pa.Array) -> pa.Array:
    """How often each letter a-z occurs in each text, counted by byte: in UTF-8 they are no part of other characters."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begins, ends = offsets[:-1], offsets[1:]
    counts = np.zeros((len(texts), 26))
    for at in range(offsets[0], offsets[-1], _COUNTED):
        stop = min(at + _COUNTED, offsets[-1])
        first, last = np.searchsorted(ends, [at, stop - 1], side="right")
        own = slice(first, last + 1)
        row = np.repeat(np.arange(last + 1 - first), np.minimum(ends[own], stop) - np.maximum(begins[own], at))
        letter = data[at:stop] - np.uint8(ord("a"))
        known = letter < 26
        counts[own] += np.bincount(row[known] * 26 + letter[known], minlength=(last + 1 - first) * 26).reshape(-1, 26)
    bounds = np.arange(0, counts.size + 1, 26, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(counts.ravel()))


def letter_embedding(df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
    """How often each letter a-z occurs: a plain embedder whose results SQL can reproduce."""
    count = F.arrow_udf(letter_counts, "array<double>")
    return df.withColumn(out, count(F.lower(F.coalesce(F.col(text), F.lit("")))))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean embedding of every label: one question vector per label, derived from the whole table."""
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg("x").alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(ordered.alias("v")).select(
        F.col("label").cast("string").alias("query_id"), "label", F.col("v.x").alias("embedding")
    )
