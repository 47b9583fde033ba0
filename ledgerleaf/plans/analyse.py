"""Analysis of all companies: one retrieval for every question, then three batched generator passes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.constants import DIMENSION_TOP_K, DIMENSIONS, OVERVIEW_QUESTION, OVERVIEW_TOP_K
from ledgerleaf.functions.numbers import fixed
from ledgerleaf.functions.text import strip
from ledgerleaf.operators import answer, metrics, report, score
from ledgerleaf.operators.generate import Generator, generate
from ledgerleaf.operators.retrieve import Embedder, hashed_embedding
from ledgerleaf.session import stored
from ledgerleaf.sinks import tables


def dimension_prompt(dimension: Column, questions: Column) -> Column:
    """Prompt over the answered questions (array of ``question, answer``) of a dimension."""
    lines = F.transform(
        questions, lambda q: F.concat(F.lit("Q: "), q["question"], F.lit("\nA: "), F.coalesce(q["answer"], F.lit("")))
    )
    return F.concat(
        F.lit("Judge a company's "),
        F.replace(dimension, F.lit("_"), F.lit(" ")),
        F.lit(" from these answers:\n\n"),
        F.array_join(lines, "\n\n"),
        F.lit(
            '\n\nReply with one JSON object: "score" is a number from 0 (poor) over 5 (average) to 10 (excellent), '
            '"reasoning" explains it in two or three sentences, "key_findings" lists two or three findings.'
        ),
    )


def judge_dimensions(
    companies: DataFrame,
    chunks: DataFrame,
    answer_fn: Generator,
    judge_fn: Generator,
    embed: Embedder = hashed_embedding,
    embeddings: DataFrame | None = None,
    dimensions: Mapping[str, Mapping] = DIMENSIONS,
    k: int = DIMENSION_TOP_K,
) -> DataFrame:
    """Scored dimensions of every company. All questions of all companies are answered in one job."""
    questions = score.dimension_questions(companies, dimensions)
    answered = answer.ask(
        questions.select("question_id", "company_id", "question", "dimension", "ord", "weight", "question_number"),
        chunks, answer_fn, embed, k, include_sources=False, embeddings=embeddings,
    )
    listed = F.array_sort(F.collect_list(F.struct("question_number", "question", "answer")))
    prompts = (
        answered.groupBy("company_id", "dimension", "ord", "weight")
        .agg(listed.alias("_questions"))
        .withColumn("_prompt", dimension_prompt(F.col("dimension"), F.col("_questions")))
        .drop("_questions")
    )
    judged = generate(stored(prompts, "dimensions"), "_prompt", judge_fn, "reply", "_error")
    return score.parse_dimensions(judged.drop("_prompt", "_error"))


def summary_prompt(overview: Column) -> Column:
    """Prompt over the columns of a scorecard."""
    strengths = F.transform(
        "top_dimensions", lambda d: F.concat(F.lit("- "), d["dimension"], F.lit(": "), fixed(d["score"], 1), F.lit("/10"))
    )
    return F.concat(
        F.lit("Write the executive summary of an investment memo in three or four sentences.\n\nOverview: "),
        F.coalesce(overview, F.lit("N/A")),
        F.lit("\nScore: "),
        fixed("overall_score", 1),
        F.lit("/10\nRecommendation: "),
        F.upper("recommendation"),
        F.lit("\nStrengths:\n"),
        F.array_join(strengths, "\n"),
        F.lit("\n\nSummary:"),
    )


def executive_summaries(cards: DataFrame, overviews: DataFrame, fn: Generator) -> DataFrame:
    """Add ``executive_summary`` to scorecards; ``overviews`` has ``company_id, overview``. A generator error
    gives a fixed sentence."""
    prompted = cards.join(overviews, "company_id", "left").withColumn("_prompt", summary_prompt(F.col("overview")))
    fallback = F.concat(
        F.lit("Investment analysis for "), F.col("company_id"), F.lit(". Overall score: "), fixed("overall_score", 1),
        F.lit("/10. Recommendation: "), F.upper("recommendation"), F.lit("."),
    )
    written = generate(prompted, "_prompt", fn, "_reply", "_error")
    return written.withColumn("executive_summary", F.coalesce(strip("_reply"), fallback)).drop(
        "_prompt", "_reply", "_error", "overview"
    )


def assemble(
    cards: DataFrame,
    metrics_wide: DataFrame,
    documents: DataFrame,
    analyzed_at: Column | None = None,
    analyzed_by: str = "system",
) -> DataFrame:
    """Complete analyses: scorecards with their financial narrative, metric profile and document count."""
    profile = score.metric_profile(metrics_wide)
    names = [name for name in profile.columns if name != "company_id"]
    stamped = F.current_timestamp() if analyzed_at is None else analyzed_at
    counted = report.documents_per_company(documents).withColumnRenamed("total_documents", "_documents")
    joined = cards.join(profile.withColumn("_profiled", F.lit(True)), "company_id", "left").join(
        counted, "company_id", "left"
    )
    narrated = joined.withColumns(
        {
            "financial_analysis": score.financial_narrative(F.coalesce("_profiled", F.lit(False))),
            "documents_analyzed": F.coalesce("_documents", F.lit(0)).cast("int"),
            "financial_metrics": F.struct(*names),
            "analyzed_at": stamped,
            "analyzed_by": F.lit(analyzed_by),
        }
    ).drop(*names, "_profiled", "_documents")
    return narrated.withColumn(
        "analysis_id", F.md5(F.concat_ws("|", "company_id", F.col("analyzed_at").cast("string")))
    )


def analyse(
    companies: DataFrame,
    chunks: DataFrame,
    metrics_wide: DataFrame,
    documents: DataFrame,
    answer_fn: Generator,
    judge_fn: Generator,
    summary_fn: Generator,
    embed: Embedder = hashed_embedding,
    embeddings: DataFrame | None = None,
    analyzed_at: Column | None = None,
) -> DataFrame:
    """Analyses of all ``companies``, with their dimensions as a list."""
    dimensions = judge_dimensions(companies, chunks, answer_fn, judge_fn, embed, embeddings)
    overview = answer.compare_companies(
        OVERVIEW_QUESTION, companies, chunks, answer_fn, embed, OVERVIEW_TOP_K, embeddings
    ).select("company_id", F.col("answer").alias("overview"))
    cards = executive_summaries(stored(score.scorecard(dimensions), "scorecards"), overview, summary_fn)
    return assemble(cards, metrics_wide, documents, analyzed_at)


def analysis_dimensions(analyses: DataFrame) -> DataFrame:
    """The dimensions of analyses as rows of their table."""
    return analyses.select("analysis_id", "company_id", F.inline("dimensions")).select(
        "analysis_id", "company_id", "dimension", (F.col("weight") / 100).alias("weight"), "score", "reasoning",
        "key_findings",
    )


def analyse_companies(
    spark: SparkSession,
    database: str,
    answer_fn: Generator,
    judge_fn: Generator,
    summary_fn: Generator,
    embed: Embedder = hashed_embedding,
) -> int:
    """Analyse every company of the database and save the results; returns the number of analyses."""
    analyses = stored(
        analyse(
            spark.table(f"{database}.companies"),
            spark.table(f"{database}.document_chunks"),
            spark.table(f"{database}.financial_metrics").drop("delivery").unionByName(
                metrics.derived_rows(spark.table(f"{database}.period_metrics")), allowMissingColumns=True
            ),
            spark.table(f"{database}.documents"),
            answer_fn, judge_fn, summary_fn, embed,
            spark.table(f"{database}.chunk_embeddings"),
        ),
        "analyses",
    )
    saved = tables.save_analyses(analyses, analysis_dimensions(analyses), database)
    tables.update_rollup(spark, database, analyses=analyses)
    return saved
