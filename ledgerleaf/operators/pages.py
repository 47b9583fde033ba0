"""Documents given page by page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import schemas

PAGE_BREAK = "\n\n"
_PAGES_PER_BLOCK = 256


def page_counts(pages: DataFrame) -> DataFrame:
    """``page_count, char_count, has_charts`` per document, without bringing its pages together.

    Pages (``document_id, page, text, n_images``) are joined with a blank line, which counts too.
    """
    return pages.groupBy("document_id").agg(
        F.count("*").cast("int").alias("page_count"),
        (F.sum(F.length(F.coalesce("text", F.lit("")))) + (F.count("*") - 1) * len(PAGE_BREAK)).alias("char_count"),
        (F.max("n_images") > 0).alias("has_charts"),
    )


def _in_page_order(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _running(lengths: Column) -> Column:
    """Start offset of each part, given the length of each."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lengths,
        begin,
        lambda state, length: F.struct(
            (state["at"] + length + len(PAGE_BREAK)).cast("int").alias("at"),
            F.concat(state["starts"], F.array(state["at"])).alias("starts"),
        ),
        lambda state: state["starts"],
    )


def page_blocks(pages: DataFrame, pages_per_block: int = _PAGES_PER_BLOCK, keep: Sequence[str] = ()) -> DataFrame:
    """Text of consecutive pages, at most ``pages_per_block`` to a row, with the document's columns in ``keep``.

    The group is a block of one document, so its size is bounded however many pages a document has.
    """
    return (
        pages.withColumn("block", F.floor((F.col("page") - 1) / pages_per_block).cast("int"))
        .withColumn("text", F.coalesce("text", F.lit("")))
        .groupBy("document_id", "block")
        .agg(
            _in_page_order("page", "text").alias("_pages"),
            (F.max("n_images") > 0).alias("has_charts"),
            *[F.any_value(name).alias(name) for name in keep],
        )
        .select(
            "document_id",
            "block",
            *keep,
            F.size("_pages").alias("page_count"),
            F.array_join(F.col("_pages.text"), PAGE_BREAK).alias("text"),
            _running(F.transform("_pages", lambda page: F.length(page["text"]))).alias("starts"),
            "has_charts",
        )
    )


def page_documents(pages: DataFrame, pages_per_block: int = _PAGES_PER_BLOCK, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``full_text, page_count, page_starts, has_charts`` and the columns in ``keep``.

    Pages first come together in bounded blocks; the second step handles one row per block. A document's
    text is one value in the result, so it must fit into one string.
    """
    blocks = page_blocks(pages, pages_per_block, keep)
    joined = blocks.groupBy("document_id").agg(
        _in_page_order("block", "text", "starts").alias("_blocks"),
        F.sum("page_count").cast("int").alias("page_count"),
        F.max("has_charts").alias("has_charts"),
        *[F.any_value(name).alias(name) for name in keep],
    )
    offsets = _running(F.transform("_blocks", lambda block: F.length(block["text"])))
    return joined.withColumn("_offsets", offsets).select(
        "document_id",
        F.array_join(F.col("_blocks.text"), PAGE_BREAK).alias("full_text"),
        "page_count",
        F.flatten(
            F.transform(
                "_blocks",
                lambda block, i: F.transform(block["starts"], lambda start: start + F.get("_offsets", i)),
            )
        ).alias("page_starts"),
        "has_charts",
        *keep,
    )


def extracted_pages(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Documents given page by page in the form of extracted files (``schemas.EXTRACTED``)."""
    made = {"success": F.lit(True), "file_type": F.lit("pages"), "has_tables": F.lit(False), "table_count": F.lit(0), "char_count": F.length("full_text")}
    joined = page_documents(pages, keep=keep).withColumns(made)
    return joined.select(
        *keep,
        *[
            (F.col(name) if name in joined.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in schemas.EXTRACTED_FIELDS.items()
        ],
    )
