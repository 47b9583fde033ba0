"""Registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import (
    chat, decontaminate, hardnegatives, hmm, langid, lengths, lexical, minhash, neighbours, oracles, packing, quality, sharding, substrings,
)
from ledgerleaf.llm.common import in_fold, stored, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), in_fold(F.col("doc_id"), 5, 1))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, labels, in_fold(F.col("doc_id"), 4, 2))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.fold(chat.turn_events(given.unionByName(added))))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~held_out))
    found, (label, score) = langid.identify(docs.select("doc_id", "text"), model, with_spans=False)
    return found.select("doc_id", held_out.alias("held_out"), F.col(label).alias("lang_pred"), F.col(score).alias("score"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.length(text).cast("long") + 1
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"))
    placed, (shard, grown, digits) = sharding.place(stored(rows.withColumn("law", F.lit("key")), "digests"))
    numbered, _ = sharding.number(placed, shard, [digits, "doc_id", "size", "text_crc32"])
    return numbered.drop(digits)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hardnegatives.mine(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_scores": op1_hmm_scores,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_nn_descent": op6_nn_descent,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_jump_sharding": op12_jump_sharding,
    "op13_hard_negatives": op13_hard_negatives,
}

# Scores of trained models and token ids of a tokenizer are beyond SQL; tests compare those with brute force.
ORACLES: dict[str, str] = {
    "op3_decontamination": oracles.DECONTAMINATION,
    "op5_minhash_dedup": oracles.NEAR_DUPLICATES,
    "op6_nn_descent": oracles.NEAREST,
    "op7_suffix_array_dedup": oracles.REPEATED_STRINGS,
    "op8_chat_formatting": oracles.CHAT,
    "op11_lexical_search": oracles.LEXICAL,
    "op12_jump_sharding": oracles.SHARDS,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
