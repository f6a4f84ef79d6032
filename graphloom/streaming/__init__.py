"""Structured Streaming forms of the operators that can be kept up to date edge by edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degree_stream(edges: DataFrame) -> DataFrame:
    """(id, outdegree, indegree) of all edges so far, from a stream of (src, dst); for ``update`` or ``complete`` mode."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("outdegree"), F.sum("e.i").alias("indegree"))


def check_stream(checks: DataFrame, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Evidence of rounds by window, from a stream of (ts, iter, dmr_error, monotonic_error, sum_abs_delta, count_update).

    Rows later than ``late`` are left out; with ``append`` mode a window comes once, when it can change no more.
    """
    by = checks.withWatermark("ts", late).groupBy(F.window("ts", every))
    return by.agg(
        F.max("iter").alias("last_iter"), F.bool_or("dmr_error").alias("dmr_error"), F.bool_or("monotonic_error").alias("monotonic_error"),
        F.sum("sum_abs_delta").alias("sum_abs_delta"), F.sum("count_update").alias("count_update"),
    ).select(F.col("window.start").alias("window_start"), "last_iter", "dmr_error", "monotonic_error", "sum_abs_delta", "count_update")
