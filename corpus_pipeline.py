"""From documents to packed training sequences, stage by stage; each stage works on all that the one before kept.

Defined cases: null, empty and unlettered texts, and texts mostly in scripts that no text with a language has, leave in the
first stage; texts in several learned languages stay. Rows with null or equal ids are documents of their own: of equal
ones, as of all near duplicates, one stays. Texts that repeated strings leave empty stay, and are packed as their end
token alone. Other columns pass through all stages but the last, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import decontaminate, langid, minhash, packing, substrings
from ledgerleaf.llm.common import in_fold, stored, table
from ledgerleaf.llm.queries import tokenizer_path

# A document goes if less than this share of its letters is in a script that a learned language has.
LEAST_KNOWN = 0.5

# Words of a repeated string: a passage of over 50 words has this many of its own, also if both ends are joined to others.
REPEATED_WORDS = 49


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, as seen by a model of the other documents' languages."""
    model = langid.train(docs.where(~in_fold(F.col("doc_id"), 4, 2)))
    found, (label, _, known) = langid.identify(docs, model, with_spans=False, with_known=True)
    return found.where((F.col(label) != langid.UNKNOWN) & (F.col(known) >= LEAST_KNOWN)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of bytes or words that occur more than once. Documents with benchmark passages
    keep these, which several may share, as the next stage finds them by their passages."""
    found, at = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    cut = substrings.cut_repeats(docs, words=REPEATED_WORDS, spared=found.where(F.size(at["starts"]) > 0))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its sequence and place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# SQL has no tokenizer: tests compare the stages with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
