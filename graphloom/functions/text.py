"""How results are written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_decimals(value: Column, decimals: int = 6) -> Column:
    """A number with so many decimals; ``nan`` for what is null or no number."""
    return F.when(value.isNull() | F.isnan(value), F.lit("nan")).otherwise(F.format_string(f"%.{decimals}f", value))


def markdown_cell(value: Column) -> Column:
    """A cell of a Markdown table: bars are escaped, line ends become spaces, null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")


def utc_text(moment: Column) -> Column:
    """ISO 8601 in UTC; such texts sort as the moments do."""
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
