"""Questions answered from retrieved chunks, in batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.constants import ANSWER_TOP_K, NO_ANSWER
from ledgerleaf.functions.text import as_col, strip
from ledgerleaf.operators.generate import Generator, Replies, extractive_reply, generate
from ledgerleaf.operators.retrieve import Embedder, hashed_embedding, retrieve
from ledgerleaf.session import stored_buckets


def context(retrieved: DataFrame) -> DataFrame:
    """``context, num_sources, sources`` of each question, its chunks in rank order.

    At most ``k`` chunks were retrieved for a question, so the lists are short.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "document_id", "document_type", "text", "score")))
    grouped = retrieved.groupBy("question_id").agg(ranked.alias("_ranked"))
    block = F.transform(
        "_ranked",
        lambda row: F.concat(
            F.lit("[Document "),
            row["rank"].cast("string"),
            F.lit(" - "),
            F.coalesce(row["document_type"], F.lit("unknown")),
            F.lit("]\n"),
            F.coalesce(row["text"], F.lit("")),
        ),
    )
    sources = F.transform(
        "_ranked",
        lambda row: F.struct(
            row["document_id"].alias("document_id"),
            row["document_type"].alias("document_type"),
            row["text"].alias("text"),
            row["score"].alias("score"),
        ),
    )
    return grouped.select(
        "question_id",
        F.array_join(block, "\n\n").alias("context"),
        F.size("_ranked").alias("num_sources"),
        sources.alias("sources"),
    )


def answer_prompt(question: Column | str, text: Column | str) -> Column:
    return F.concat(
        F.lit("Answer the question from the excerpts of a company's documents and from nothing else. "
              "Be brief, cite figures, and say so if the excerpts do not suffice.\n\nQuestion: "),
        as_col(question),
        F.lit("\n\nExcerpts:\n"),
        as_col(text),
        F.lit("\n\nAnswer:"),
    )


def ask(
    questions: DataFrame,
    chunks: DataFrame,
    fn: Generator = extractive_reply,
    embed: Embedder = hashed_embedding,
    k: int = ANSWER_TOP_K,
    include_sources: bool = True,
    embeddings: DataFrame | None = None,
    replies: Replies | None = None,
) -> DataFrame:
    """Answer ``questions`` (``question_id, company_id, question``): adds ``answer, num_sources, confidence,
    error`` and, with ``include_sources``, ``sources``. Question ids are unique; ``replies`` keeps the generator's replies
    for later runs.

    A question without any chunk keeps its row, with a fixed answer and confidence 0.
    """
    contexts = context(retrieve(questions, chunks, embed, k, embeddings))
    prompted = questions.join(contexts, "question_id", "left").withColumn(
        "_prompt", F.when(F.col("context").isNotNull(), answer_prompt("question", "context"))
    )
    # Read for the prompts and again for the answers: the search runs once, and contexts stay where they are.
    prompted = stored_buckets(prompted, "prompts", ["question_id"])
    answered = generate(prompted, "_prompt", fn, "_reply", "error", row_id="question_id", replies=replies)
    has_sources = F.col("context").isNotNull()
    empty = F.array().cast("array<struct<document_id:string,document_type:string,text:string,score:double>>")
    columns = [
        *[F.col(name) for name in questions.columns],
        F.when(has_sources, strip("_reply")).otherwise(NO_ANSWER).alias("answer"),
        F.coalesce("num_sources", F.lit(0)).alias("num_sources"),
        F.when(~has_sources, F.lit(0.0)).alias("confidence"),
        F.col("error"),
    ]
    if include_sources:
        columns.append(F.coalesce("sources", empty).alias("sources"))
    return answered.select(*columns)


def questions_for(companies: DataFrame, questions: Sequence[str]) -> DataFrame:
    """The same questions for every company, as ``question_id, company_id, question``."""
    listed = F.array(
        *[F.struct(F.lit(i).alias("number"), F.lit(text).alias("question")) for i, text in enumerate(questions)]
    )
    return companies.select("company_id", F.inline(listed)).select(
        F.concat_ws("_", "company_id", F.col("number").cast("string")).alias("question_id"), "company_id", "question"
    )


def compare_companies(
    question: str, companies: DataFrame, chunks: DataFrame, fn: Generator = extractive_reply,
    embed: Embedder = hashed_embedding, k: int = ANSWER_TOP_K, embeddings: DataFrame | None = None,
) -> DataFrame:
    """One question put to many companies in one job, without sources."""
    return ask(
        questions_for(companies, [question]), chunks, fn, embed, k, include_sources=False, embeddings=embeddings
    )


def source_preview(answers: DataFrame, sources: int = 3, chars: int = 100) -> DataFrame:
    """First sources of each answer, one row each, with the beginning of their text for display."""
    return answers.select("question_id", F.posexplode(F.slice("sources", 1, sources)).alias("position", "source")).select(
        "question_id",
        (F.col("position") + 1).alias("position"),
        F.coalesce("source.document_type", F.lit("document")).alias("document_type"),
        F.substring("source.text", 1, chars).alias("preview"),
    )
