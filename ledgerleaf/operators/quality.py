"""Constraint checks as reports. Each table is read once for all its column checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, broken: Mapping[tuple[str, str], Column]) -> DataFrame:
    """One row per check with the number of rows that break it."""
    names = list(broken)
    counted = df.agg(*[F.count_if(broken[name]).alias(f"_{i}") for i, name in enumerate(names)])
    entries = F.array(
        *[
            F.struct(
                F.lit(check).alias("check"), F.lit(column).alias("column_name"), F.col(f"_{i}").alias("n_violations")
            )
            for i, (check, column) in enumerate(names)
        ]
    )
    return counted.select(F.inline(entries))


def check_columns(
    df: DataFrame,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    domains: Mapping[str, Sequence[str]] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Violations per check: values outside a closed range or a domain (NULL breaks neither), and missing ones."""
    broken: dict[tuple[str, str], Column] = {}
    for name, (low, high) in (ranges or {}).items():
        broken["range", name] = ~F.col(name).between(low, high)
    for name, values in (domains or {}).items():
        broken["domain", name] = ~F.col(name).isin(*values)
    for name in required:
        broken["required", name] = F.col(name).isNull()
    return _counts(df, broken)


def violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The rows that break a range."""
    broken = F.lit(False)
    for name, (low, high) in ranges.items():
        broken = broken | F.coalesce(~F.col(name).between(low, high), F.lit(False))
    return df.filter(broken)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)
