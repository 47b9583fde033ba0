"""Exact length histogram: documents counted by encoded length, and suffix sums that answer every context limit.

Defined cases: null and empty texts have the end token only; an empty table has no rows, and no quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import slices
from ledgerleaf.llm.packing import encoder


def encoded_lengths(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """Rows (length, documents): tokens of a text with its end, and how many documents have as many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "text"):
            out = [len(encode(x or "")) // 4 + 1 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["length"])

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "length long")
    return rows.groupBy("length").agg(F.count(F.lit(1)).alias("documents"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with ``longer_documents`` and ``longer_tokens`` (of this length and above), and what follows for
    it as a context limit: ``documents_within`` (not cut) and ``tokens_kept``.

    Its rows are distinct lengths, not documents, so one ordered window over them is small.
    """
    above = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("documents") * F.col("length")
    sums = histogram.withColumns({"longer_documents": F.sum("documents").over(above), "longer_tokens": F.sum(tokens).over(above)})
    return sums.withColumns(
        {
            "documents_within": F.max("longer_documents").over(every) - F.col("longer_documents") + F.col("documents"),
            "tokens_kept": F.max("longer_tokens").over(every) - F.col("longer_tokens") + F.col("longer_documents") * F.col("length"),
        }
    )


def truncated_totals(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row (context_limit): tokens kept if every document is cut there, tokens lost, documents cut."""
    total = sums.agg(F.coalesce(F.max("longer_tokens"), F.lit(0)).alias("total"))
    first = sums.join(F.broadcast(limits), F.col("length") > F.col("context_limit")).groupBy("context_limit").agg(
        F.max("longer_documents").alias("cut"), F.max("longer_tokens").alias("tokens")
    )
    lost = limits.join(first, "context_limit", "left").select(
        "context_limit",
        F.coalesce("cut", F.lit(0)).alias("documents_cut"),
        (F.coalesce("tokens", F.lit(0)) - F.coalesce("cut", F.lit(0)) * F.col("context_limit")).alias("tokens_lost"),
    )
    whole = total.first()[0]
    return lost.withColumn("tokens_kept", F.lit(whole) - F.col("tokens_lost"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Rows (share, length): the smallest length that at least this share of the documents does not exceed."""
    n = sums.agg(F.max("longer_documents")).first()[0] or 0
    within = F.col("documents_within")
    return sums.agg(*(F.min(F.when(within >= share * n, F.col("length"))).alias(f"q{i}") for i, share in enumerate(shares))).select(
        F.inline(F.array(*(F.struct(F.lit(float(share)).alias("share"), F.col(f"q{i}").alias("length")) for i, share in enumerate(shares))))
    )
