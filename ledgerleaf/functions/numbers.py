"""Number and period expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions.constants import PERIOD_PATTERNS
from ledgerleaf.functions.text import as_col, strip

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def plain_number(value: Column | str) -> Column:
    """Text as DOUBLE if it is a plain number: a bare cast would also take '5d' or '5f'."""
    trimmed = strip(value)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def suffix_multiplier(suffix: Column | str) -> Column:
    upper = F.upper(as_col(suffix))
    return F.when(upper == "K", 1e3).when(upper == "M", 1e6).when(upper == "B", 1e9).otherwise(1.0)


def parse_amount(value: Column | str) -> Column:
    """'$1.2M', '(1,234)', '25%', '3b' to a number; anything else to NULL."""
    # "(" becomes a minus sign, the other listed characters vanish.
    bare = F.translate(strip(value), "($€£,)", "-")
    suffix = F.upper(F.right(bare, F.lit(1)))
    has_suffix = suffix.isin("K", "M", "B")
    digits = F.when(has_suffix, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    percent = plain_number(F.replace(bare, F.lit("%"), F.lit(""))) / 100.0
    return F.when(bare.contains("%"), percent).otherwise(plain_number(digits) * suffix_multiplier(suffix))


def is_period(heading: Column | str, patterns: Iterable[str] = PERIOD_PATTERNS) -> Column:
    return as_col(heading).rlike("(?iU)" + "|".join(f"(?:{pattern})" for pattern in patterns))


def period_key(label: Column | str, pivot_year: int = 70) -> Column:
    """First day of the labelled period; NULL for rolling labels such as YTD or TTM.

    Understands 'Q1 2024', '2023-Q1', 'FY24', 'FY 2024', 'Mar 2024' and bare years. Years of two digits from
    ``pivot_year`` on are of the 20th century, those before it of the 21st.
    """
    text = F.upper(as_col(label))
    quarter = F.coalesce(
        F.nullif(F.regexp_extract(text, r"Q([1-4])\s*\d{4}", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"\d{4}\s*-?\s*Q([1-4])", 1), F.lit("")),
    )
    months = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
    month = F.regexp_extract(text, "(" + "|".join(months) + r")\s*\d{4}", 1)
    month_number = F.nullif(F.array_position(F.array(*[F.lit(m) for m in months]), month), F.lit(0))
    year = F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit(""))
    two_digits = F.nullif(F.regexp_extract(text, r"FY\s*(\d{2})(?!\d)", 1), F.lit(""))
    century = F.when(two_digits.try_cast("int") >= pivot_year, "19").otherwise("20")
    short_year = F.concat(century, two_digits)
    first_month = F.coalesce((quarter.try_cast("int") - 1) * 3 + 1, month_number.cast("int"), F.lit(1))
    return F.make_date(F.coalesce(year, short_year).try_cast("int"), first_month, F.lit(1))


def fixed(value: Column | str, digits: int = 0, thousands: bool = False) -> Column:
    """Decimal text, rounding halves to even on the binary value; ``format_string`` rounds them up."""
    text = F.format_number(as_col(value), digits)
    return text if thousands else F.replace(text, F.lit(","), F.lit(""))
