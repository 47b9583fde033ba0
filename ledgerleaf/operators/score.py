"""Scoring of companies on weighted dimensions and everything the memo takes from the scores.

The dimensions of a company come together once, in a list of as many entries as there are dimensions;
all the rest are columns over that list.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.constants import (
    CONFIDENCE_VARIANCE,
    DILIGENCE_CEILING,
    DIMENSIONS,
    FEW_FINANCIALS,
    LIST_LIMIT,
    LOWEST_RECOMMENDATION,
    NEUTRAL_REASONING,
    NEUTRAL_SCORE,
    NO_FINANCIALS,
    OPPORTUNITY_FINDINGS,
    OPPORTUNITY_FLOOR,
    PROFILE_AVERAGES,
    PROFILE_MAXIMA,
    RECOMMENDATION_FLOORS,
    STEP_DILIGENCE,
    STEPS_BUY_FIRST,
    STEPS_BUY_LAST,
    STEPS_HOLD,
    STEPS_PASS,
    TOP_DIMENSIONS,
)
from ledgerleaf.functions.numbers import fixed, plain_number
from ledgerleaf.functions.text import as_col, title_case

_STRICT_JSON = {"allowSingleQuotes": "false"}


def dimension_table(spark: SparkSession, dimensions: Mapping[str, Mapping] = DIMENSIONS) -> DataFrame:
    """Dimensions as rows: ``dimension, ord, weight`` (hundredths) and ``questions``."""
    rows = [(name, i, spec["weight"], spec["questions"]) for i, (name, spec) in enumerate(dimensions.items())]
    return spark.createDataFrame(rows, "dimension string, ord int, weight int, questions array<string>")


def dimension_questions(companies: DataFrame, dimensions: Mapping[str, Mapping] = DIMENSIONS) -> DataFrame:
    """Every question of every dimension for every company: a fixed number of rows per company."""
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("dimension"),
                F.lit(i).alias("ord"),
                F.lit(spec["weight"]).alias("weight"),
                F.lit(q).alias("question_number"),
                F.lit(text).alias("question"),
            )
            for i, (name, spec) in enumerate(dimensions.items())
            for q, text in enumerate(spec["questions"])
        ]
    )
    return companies.select("company_id", F.inline(listed)).withColumn(
        "question_id", F.concat_ws("_", "company_id", "dimension", F.col("question_number").cast("string"))
    )


def parse_reply(reply: Column | str) -> Column:
    """``score, reasoning, key_findings`` of a reply that holds a JSON object, bare or in a code fence.

    Missing fields take a neutral score, '' and no findings; a reply without a usable object takes the
    neutral result as a whole.
    """
    text = as_col(reply)
    body = (
        F.when(text.contains("```json"), F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1))
        .when(text.contains("```"), F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1))
        .otherwise(text)
    )
    # As the only element of an array the object may have nothing behind it.
    alone = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    parsed = F.from_json(body, "score STRING, reasoning STRING, key_findings ARRAY<STRING>", _STRICT_JSON)
    keys = F.json_object_keys(body)
    score = F.when(F.array_contains(keys, "score"), plain_number(parsed["score"])).otherwise(NEUTRAL_SCORE)
    usable = F.coalesce(alone, F.lit(False)) & keys.isNotNull() & score.isNotNull()
    return F.struct(
        F.when(usable, score).otherwise(NEUTRAL_SCORE).alias("score"),
        F.when(usable, F.coalesce(parsed["reasoning"], F.lit(""))).otherwise(NEUTRAL_REASONING).alias("reasoning"),
        F.when(usable, F.coalesce(parsed["key_findings"], F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>"))
        .alias("key_findings"),
    )


def parse_dimensions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replace ``reply`` by its ``score, reasoning, key_findings``."""
    parsed = replies.withColumn("_parsed", parse_reply(reply))
    return parsed.drop(reply).select(*[c for c in replies.columns if c != reply], "_parsed.*")


def recommendation(score: Column | str) -> Column:
    value = as_col(score)
    result = F.lit(LOWEST_RECOMMENDATION)
    for name, floor in reversed(RECOMMENDATION_FLOORS):
        result = F.when(value >= floor, name).otherwise(result)
    return result


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(value) for value in values])


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def _of_dimension(name: str, field: str) -> Column:
    return F.try_element_at(F.filter("dimensions", lambda d: d["dimension"] == name), F.lit(1))[field]


def scorecard(dimensions: DataFrame, keys: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """One row per company from ``dimension, ord, weight`` (hundredths), ``score, reasoning, key_findings``."""
    entry = F.struct("ord", "dimension", "weight", "score", "reasoning", "key_findings")
    listed = dimensions.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("dimensions"))

    scores = F.transform("dimensions", lambda d: d["score"])
    weighted = F.transform("dimensions", lambda d: d["score"] * d["weight"])
    scored = listed.withColumn("overall_score", F.round(_add(weighted) / 100.0, 9)).withColumn(
        "_mean", _add(scores) / F.size("dimensions")
    )
    spread = F.transform("dimensions", lambda d: (d["score"] - F.col("_mean")) * (d["score"] - F.col("_mean")))
    variance = _add(spread) / F.size("dimensions")

    strong = F.filter("dimensions", lambda d: d["score"] >= OPPORTUNITY_FLOOR)
    opportunities = F.flatten(F.transform(strong, lambda d: F.slice(d["key_findings"], 1, OPPORTUNITY_FINDINGS)))
    weak = F.transform(
        F.filter("dimensions", lambda d: d["score"] < DILIGENCE_CEILING),
        lambda d: F.concat(F.lit(STEP_DILIGENCE), F.replace(d["dimension"], F.lit("_"), F.lit(" "))),
    )
    steps = (
        F.when(
            F.col("recommendation").isin("strong_buy", "buy"),
            F.concat(_strings(*STEPS_BUY_FIRST), weak, _strings(*STEPS_BUY_LAST)),
        )
        .when(F.col("recommendation") == "hold", _strings(*STEPS_HOLD))
        .otherwise(_strings(*STEPS_PASS))
    )
    by_score = F.array_sort(
        F.transform(
            "dimensions",
            lambda d: F.struct((-d["score"]).alias("_down"), d["ord"], d["dimension"], d["score"]),
        )
    )
    top = F.transform(
        F.slice(by_score, 1, TOP_DIMENSIONS),
        lambda d: F.struct(d["dimension"].alias("dimension"), d["score"].alias("score")),
    )
    return (
        scored.withColumn("recommendation", recommendation("overall_score"))
        .withColumns(
            {
                "confidence_level": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - variance / CONFIDENCE_VARIANCE)),
                "market_analysis": F.coalesce(_of_dimension("market_opportunity", "reasoning"), F.lit("")),
                "competitive_moat": F.coalesce(_of_dimension("competitive_moat", "reasoning"), F.lit("")),
                "team_assessment": F.coalesce(_of_dimension("team_quality", "reasoning"), F.lit("")),
                "key_risks": F.coalesce(
                    _of_dimension("risk_factors", "key_findings"), F.array().cast("array<string>")
                ),
                "key_opportunities": F.slice(opportunities, 1, LIST_LIMIT),
                "next_steps": F.slice(steps, 1, LIST_LIMIT),
                "top_dimensions": top,
            }
        )
        .drop("_mean")
    )


def metric_profile(metrics: DataFrame) -> DataFrame:
    """Average metrics and largest headcount of every company, from the wide metrics table."""
    return metrics.groupBy("company_id").agg(
        *[F.avg(name).alias(name) for name in PROFILE_AVERAGES],
        *[F.max(name).alias(name) for name in PROFILE_MAXIMA],
    )


def financial_narrative(has_profile: Column | None = None) -> Column:
    """Sentences on the columns of ``metric_profile``; zero and NULL both count as not given."""

    def given(*names: str) -> Column:
        result = F.lit(True)
        for name in names:
            result = result & F.coalesce(F.col(name) != 0, F.lit(False))
        return result

    parts = F.array_compact(
        F.array(
            F.when(given("revenue"), F.concat(F.lit("Revenue: $"), fixed("revenue", thousands=True))),
            F.when(
                given("revenue_growth_rate"),
                F.concat(F.lit("Growth rate: "), fixed(F.col("revenue_growth_rate") * 100, 1), F.lit("%")),
            ),
            F.when(
                given("burn_rate", "runway_months"),
                F.concat(
                    F.lit("Burn rate: $"), fixed("burn_rate", thousands=True), F.lit("/month. Runway: "),
                    fixed("runway_months", 1), F.lit(" months"),
                ),
            ),
            F.when(given("ltv_cac_ratio"), F.concat(F.lit("LTV/CAC: "), fixed("ltv_cac_ratio", 1), F.lit("x"))),
        )
    )
    text = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise(FEW_FINANCIALS)
    return text if has_profile is None else F.when(has_profile, text).otherwise(NO_FINANCIALS)


def dimension_view(dimensions: DataFrame) -> DataFrame:
    """Dimensions as shown to readers: a heading with the score, the reasoning and one row per finding."""
    heading = F.concat(title_case("dimension"), F.lit(": "), fixed("score", 1), F.lit("/10"))
    return dimensions.select("*", heading.alias("heading"), F.posexplode_outer("key_findings").alias("position", "finding")).drop(
        "key_findings"
    )


def memo_view(analyses: DataFrame) -> DataFrame:
    """Analyses as shown to readers: rounded score, upper-case recommendation, confidence in percent and
    numbered steps."""
    steps = F.transform("next_steps", lambda step, i: F.concat((i + 1).cast("string"), F.lit(". "), step))
    return analyses.withColumns(
        {
            "score_label": F.concat(fixed("overall_score", 1), F.lit("/10")),
            "recommendation_label": F.upper("recommendation"),
            "confidence_label": F.concat(fixed(F.col("confidence_level") * 100), F.lit("%")),
            "numbered_steps": steps,
        }
    )
