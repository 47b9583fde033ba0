"""Financial metrics from statement cells, prose and generator replies.

All extractors give the long form ``metric_id, company_id, document_id, period, metric_name, value,
confidence_score``, one row per metric, so that they can be united and turned wide in one narrow step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import ids
from ledgerleaf.functions.constants import (
    METRIC_COLUMNS,
    METRIC_ROW_KEYWORDS,
    MIN_TABLE_ROWS,
    MODEL_CONFIDENCE,
    MODEL_METRIC_FIELDS,
    PERIOD_PATTERNS,
    TABLE_CONFIDENCE,
    TEXT_CONFIDENCE,
    TEXT_METRICS,
)
from ledgerleaf.functions.numbers import is_period, parse_amount, period_key, suffix_multiplier
from ledgerleaf.functions.text import as_col
from ledgerleaf.operators.generate import generate
from ledgerleaf.session import stored

LONG_COLUMNS = (
    "metric_id", "company_id", "document_id", "period", "metric_name", "value", "confidence_score",
)
_INT_METRICS = ("headcount", "active_users")


def metric_of_label(
    label: Column | str, keywords: Mapping[str, Sequence[str]] = METRIC_ROW_KEYWORDS, word_boundary: bool = False
) -> Column:
    """Metric of a statement row, or NULL. Keywords match inside words unless ``word_boundary``."""
    lowered = F.lower(as_col(label))

    def matches(words: Sequence[str]) -> Column:
        if word_boundary:
            return lowered.rlike("(?U)" + "|".join(rf"\b\Q{word}\E\b" for word in words))
        return reduce(Column.__or__, [lowered.contains(word) for word in words])

    name = F.lit(None).cast("string")
    for metric in reversed(list(keywords)):
        name = F.when(matches(keywords[metric]), metric).otherwise(name)
    return name


def grid_cells(grid: DataFrame, table_keys: Sequence[str] = ("document_id", "table_index")) -> DataFrame:
    """Cells with ``row_label`` and ``col_name`` from a grid (``row_index, col_index, value``).

    Row 0 heads the columns and column 0 labels the rows. Both lookups are joins, so that one huge
    table spreads over many tasks.
    """
    keys = list(table_keys)
    heads = grid.filter(F.col("row_index") == 0).select(*keys, "col_index", F.col("value").alias("col_name"))
    labels = grid.filter((F.col("col_index") == 0) & (F.col("row_index") > 0)).select(
        *keys, "row_index", F.col("value").alias("row_label")
    )
    body = grid.filter(F.col("row_index") > 0)
    return body.join(labels, [*keys, "row_index"], "left").join(heads, [*keys, "col_index"], "left")


def table_metrics(
    cells: DataFrame,
    keywords: Mapping[str, Sequence[str]] = METRIC_ROW_KEYWORDS,
    periods: Iterable[str] = PERIOD_PATTERNS,
    min_rows: int = MIN_TABLE_ROWS,
    word_boundary: bool = False,
) -> DataFrame:
    """Metrics of cells ``company_id, document_id, table_index, row_index, col_index, row_label, col_name, value``.

    ``min_rows`` counts the heading row, so the default keeps every table that has a cell at all and
    needs no shuffle; a larger one counts the rows of each table first.
    """
    if min_rows > MIN_TABLE_ROWS:
        table = ["document_id", "table_index"]
        large = (
            cells.groupBy(*table).agg((F.max("row_index") + 2).alias("_rows")).filter(F.col("_rows") >= min_rows)
        )
        cells = cells.join(large.select(*table), table, "left_semi")
    # Both fields are plain columns, which Spark compiles and computes once, and a condition within the generator leaves
    # out cells without them: a filter would be pushed down and compute them twice, a lambda would interpret them.
    read = {"_name": metric_of_label("row_label", keywords, word_boundary), "_amount": parse_amount("value")}
    known = F.col("_name").isNotNull() & F.col("_amount").isNotNull()
    kept = F.when(known, F.array(F.struct(F.col("_name").alias("metric_name"), F.col("_amount").alias("value"))))
    place = ("company_id", "document_id", "table_index", "row_index", "col_index", "col_name")
    return (
        cells.filter(is_period("col_name", periods))
        .select(*place, *[column.alias(name) for name, column in read.items()])
        .select(*place, F.inline(kept))
        .select(
            # Two columns may have the same heading.
            ids.joined_id("document_id", "table_index", "row_index", "col_index", "col_name").alias("metric_id"),
            "company_id",
            "document_id",
            F.col("col_name").alias("period"),
            "metric_name",
            "value",
            F.lit(TABLE_CONFIDENCE).alias("confidence_score"),
        )
    )


def _number_form(spec: Mapping[str, str]) -> tuple[str, str]:
    """Pattern of the number with two groups (number, what follows), by the metric's number form."""
    if spec["number"] == "money":
        # A suffix letter counts only where no other letter follows: "7 months" is 7, "3 b" is 3e9.
        return r"\$?([\d,]+(?:\.\d+)?)", r"(?:\s*([KMB])(?![A-Za-z]))?"
    return r"(\d+(?:\.\d+)?)", spec["after"]


def _matches(name: str, spec: Mapping) -> Column:
    """Array of all matches of one pattern in ``_text``. The text is searched once, and only if a stem
    occurs in ``_upper``; the groups are taken from the short matches."""
    number, after = _number_form(spec)
    pattern = rf"(?iU)(?:{spec['names']})[\s:]+{number}{after}"

    def record(match: Column, ordinal: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(spec["column"]).alias("metric_name"),
            ordinal.alias("ordinal"),
            F.regexp_extract(match, pattern, 1).alias("number"),
            F.upper(F.regexp_extract(match, pattern, 2)).alias("after"),
        )

    found = F.transform(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)), record)
    stems = [F.col("_upper").contains(stem) for stem in spec.get("stems", ())]
    if not stems:
        return found
    nothing = F.array().cast("array<struct<name:string,metric_name:string,ordinal:int,number:string,after:string>>")
    return F.when(reduce(Column.__or__, stems), found).otherwise(nothing)


def text_metrics(
    documents: DataFrame,
    text: str = "text",
    patterns: Mapping[str, Mapping] = TEXT_METRICS,
) -> DataFrame:
    """Metrics of prose, every match of every pattern in the whole text.

    Values are in base units: K/M/B applied, runway in months, margins as fractions.
    """
    searched = documents.select("company_id", "document_id", F.col(text).alias("_text")).withColumn(
        "_upper", F.upper("_text")
    )
    found = F.concat(*[_matches(name, spec) for name, spec in patterns.items()])
    unit = F.col("_m.after")
    return (
        searched.select("company_id", "document_id", F.explode(found).alias("_m"))
        .withColumn(
            "value",
            F.replace(F.col("_m.number"), F.lit(","), F.lit("")).try_cast("double")
            * F.when(unit.startswith("YEAR"), 12.0).otherwise(suffix_multiplier(unit))
            / F.when(unit == "%", 100.0).otherwise(1.0),
        )
        .filter(F.col("value").isNotNull())
        .select(
            ids.joined_id("document_id", "_m.name", "_m.ordinal").alias("metric_id"),
            "company_id",
            "document_id",
            F.lit(None).cast("string").alias("period"),
            F.col("_m.metric_name").alias("metric_name"),
            "value",
            F.lit(TEXT_CONFIDENCE).alias("confidence_score"),
        )
    )


def metric_prompt(text: Column | str, max_chars: int | None = None) -> Column:
    """Prompt over a whole text, or its first ``max_chars`` characters if a caller wants only these."""
    fields = ",\n".join(f'  "{name}": <{what}>' for name, what in MODEL_METRIC_FIELDS.items())
    return F.concat(
        F.lit(
            "Find the financial metrics in the text below. Reply with one JSON object of this form, "
            "with null for what is not there. Amounts are in dollars, margins are fractions.\n{\n" + fields + "\n}\n\n"
            "Text:\n"
        ),
        as_col(text) if max_chars is None else F.substring(as_col(text), 1, max_chars),
        F.lit("\n\nJSON:"),
    )


def model_metrics(
    documents: DataFrame,
    fn: Callable[[list[str]], list[str]],
    text: str = "text",
    max_chars: int | None = None,
) -> DataFrame:
    """Metrics a text generator finds, one row per non-null field; replies that are no JSON object give none.

    Each document is asked about where it is read, and its reply written once: no text is shuffled.
    """
    fields = ", ".join(f"{name} DOUBLE" for name in MODEL_METRIC_FIELDS)
    asked = generate(
        documents.select("company_id", "document_id", metric_prompt(text, max_chars).alias("_prompt")),
        "_prompt", fn, "_reply", "_error", distinct=False,
    )
    asked = stored(asked.drop("_prompt"), "replies")
    parsed = asked.filter(F.col("_error").isNull()).withColumn("_json", F.from_json("_reply", fields))
    named = F.array(
        *[
            F.struct(F.lit(name).alias("metric_name"), F.col(f"_json.{name}").alias("value"))
            for name in MODEL_METRIC_FIELDS
        ]
    )
    return (
        parsed.select("company_id", "document_id", F.explode(named).alias("_m"))
        .filter(F.col("_m.value").isNotNull())
        .select(
            F.concat_ws("_", "document_id", F.lit("llm"), F.col("_m.metric_name")).alias("metric_id"),
            "company_id",
            "document_id",
            F.lit(None).cast("string").alias("period"),
            F.col("_m.metric_name").alias("metric_name"),
            F.col("_m.value").alias("value"),
            F.lit(MODEL_CONFIDENCE).alias("confidence_score"),
        )
    )


def combine(*extracted: DataFrame) -> DataFrame:
    """All metrics of all extractors, duplicates kept."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), extracted)


# Groups that a task holds while it combines rows.
_HELD = 16384
_GROUP = ["company_id", "period", "metric_name"]


def best_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group's rows the one with the largest confidence and id, null before all, of as many groups as are held at
    once. Rows without a number for confidence pass as they are."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        odd = pc.fill_null(pc.is_nan(rows["confidence_score"]), False)
        yield from rows.filter(odd).to_batches()
        rows = rows.filter(pc.invert(odd))
        rows = rows if held is None else pa.concat_tables([held, rows])
        ranked = rows.take(pc.sort_indices(rows, [("confidence_score", "ascending"), ("metric_id", "ascending")], null_placement="at_start"))
        numbered = ranked.select(_GROUP).append_column("_row", pa.array(range(len(ranked)), pa.int64()))
        last = numbered.group_by(_GROUP, use_threads=False).aggregate([("_row", "max")])["_row_max"]
        held = ranked.take(last)
        if len(held) > _HELD:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def best_per_period(long: DataFrame) -> DataFrame:
    """The most trusted value of each company, period and metric; equal trust falls to the larger id.

    Tasks combine their rows batch by batch first: an aggregate over the texts of ids would sort all rows of a task.
    """
    rank = F.struct("confidence_score", "metric_id")
    rows = long.select(*_GROUP, "metric_id", "value", "confidence_score")
    return rows.mapInArrow(best_rows, rows.schema).groupBy(*_GROUP).agg(
        F.max_by("value", rank).alias("value"), F.max("confidence_score").alias("confidence_score")
    )


def confident(long: DataFrame, threshold: float = 0.0) -> DataFrame:
    return long.filter(F.col("confidence_score") >= threshold)


def _metric_column(name: str, value: Column) -> Column:
    return value.cast("int").alias(name) if name in _INT_METRICS else value.alias(name)


def to_wide(long: DataFrame, extracted_at: Column | None = None) -> DataFrame:
    """The metrics table: one record per long row, with its value in its metric's column. No shuffle."""
    return long.select(
        "metric_id",
        "company_id",
        "document_id",
        F.col("period").alias("period_start"),
        F.col("period").alias("period_end"),
        *[
            _metric_column(name, F.when(F.col("metric_name") == name, F.col("value")))
            for name in METRIC_COLUMNS
        ],
        (F.current_timestamp() if extracted_at is None else extracted_at).alias("extracted_at"),
        "confidence_score",
    )


def period_profile(long: DataFrame, keys: Sequence[str] = ("company_id", "period")) -> DataFrame:
    """Metrics side by side, the largest value of each per company and period."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric_name") == name, F.col("value"))).alias(name) for name in METRIC_COLUMNS]
    )


def _ratio(top: str, bottom: str) -> Column:
    both = (F.col(top) != 0) & (F.col(bottom) != 0)
    return F.when(both, F.try_divide(F.col(top), F.col(bottom)))


def derived_metrics(profile: DataFrame) -> DataFrame:
    """Replace ``ltv_cac_ratio`` and ``runway_months`` by ratios of the base metrics where both are given."""
    return profile.withColumns(
        {
            "ltv_cac_ratio": F.coalesce(_ratio("ltv", "cac"), F.col("ltv_cac_ratio")),
            "runway_months": F.coalesce(_ratio("cash_balance", "burn_rate"), F.col("runway_months")),
        }
    )


def revenue_growth(profile: DataFrame) -> DataFrame:
    """Add ``period_key`` and the growth of revenue over the company's previous dated period.

    ``profile`` has one row per company and period, so a company's window is as long as its calendar.
    """
    dated = profile.withColumn("period_key", period_key("period")).filter(
        F.col("period_key").isNotNull() & F.col("revenue").isNotNull()
    )
    previous = F.lag("revenue").over(Window.partitionBy("company_id").orderBy("period_key", "period"))
    return dated.withColumn("previous_revenue", previous).withColumn(
        "revenue_growth_rate",
        F.when(F.col("previous_revenue") != 0, (F.col("revenue") - F.col("previous_revenue")) / F.col("previous_revenue")),
    )


# Metrics of a period from which growth and ratios follow.
PERIOD_BASES = ("revenue", "recurring_revenue", "cash_balance", "burn_rate", "cac", "ltv")


def wide_periods(wide: DataFrame) -> DataFrame:
    """Bases of each company and period of the metrics table, the largest value of each: those of several deliveries are
    merged by taking the largest again."""
    return merged_periods(wide.select("company_id", F.col("period_start").alias("period"), *PERIOD_BASES))


def merged_periods(periods: DataFrame) -> DataFrame:
    return periods.groupBy("company_id", "period").agg(*[F.max(name).alias(name) for name in PERIOD_BASES])


def period_growth(periods: DataFrame) -> DataFrame:
    """Add ``period_key``, growth of revenue over the latest earlier dated period that has one, and the ratios of bases.

    A late period reopens the one behind it, as all periods of a company are matched again; they are as many as its
    calendar has. Undated periods have no growth and are nobody's predecessor.
    """
    dated = periods.withColumn("period_key", period_key("period"))
    known = F.when(F.col("period_key").isNotNull(), F.col("revenue"))
    earlier = Window.partitionBy("company_id").orderBy("period_key", "period").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(known, ignorenulls=True).over(earlier)
    growth = F.when(F.col("period_key").isNotNull() & (F.col("_before") != 0), (F.col("revenue") - F.col("_before")) / F.col("_before"))
    return dated.withColumn("_before", before).withColumns(
        {
            "revenue_growth_rate": growth,
            "ltv_cac_ratio": _ratio("ltv", "cac"),
            "runway_months": _ratio("cash_balance", "burn_rate"),
        }
    ).drop("_before")


def derived_rows(periods: DataFrame) -> DataFrame:
    """Growth and LTV/CAC of each company and period as rows of the metrics table."""
    derived = periods.filter(F.col("revenue_growth_rate").isNotNull() | F.col("ltv_cac_ratio").isNotNull())
    return derived.select(
        ids.joined_id("company_id", "period", F.lit("derived")).alias("metric_id"), "company_id",
        F.col("period").alias("period_start"), F.col("period").alias("period_end"), "revenue_growth_rate", "ltv_cac_ratio",
    )
