"""Comparison of two results (id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(expected: DataFrame, got: DataFrame) -> DataFrame:
    return expected.select("id", F.col("value").alias("expected")).join(got.select("id", F.col("value").alias("got")), "id", "full")


def result_diff(expected: DataFrame, got: DataFrame, first: int = 20) -> DataFrame:
    """(id, expected, got): the ``first`` ids whose values differ."""
    return _both(expected, got).where(~F.col("expected").eqNullSafe(F.col("got"))).orderBy("id").limit(first)


def core_diff(expected: DataFrame, got: DataFrame, k: int) -> DataFrame:
    """One row: mismatches, where all values below ``k`` count as equal."""
    below = (F.col("expected") < k) & (F.col("got") < k)
    same: Column = F.col("expected").eqNullSafe(F.col("got")) | F.coalesce(below, F.lit(False))
    return _both(expected, got).agg(F.count_if(~same).alias("mismatches"), F.count("*").alias("compared"))


def close_diff(expected: DataFrame, got: DataFrame, absolute: float = 1e-2, relative: float = 1e-4) -> DataFrame:
    """One row: mismatches beyond ``absolute + relative * |expected|``, and the largest absolute and relative errors."""
    error = F.abs(F.col("expected") - F.col("got"))
    wrong = ~F.coalesce(error <= F.lit(absolute) + F.lit(relative) * F.abs("expected"), F.lit(False))
    relative_error = F.try_divide(error, F.abs("expected"))
    return _both(expected, got).agg(F.count_if(wrong).alias("mismatches"), F.max(error).alias("max_abs_error"), F.max(relative_error).alias("max_rel_error"))
