"""Evidence that an iterative run went right: criticality, redundant recomputation, monotonicity and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import Graph

#: Weights, threshold and the number of lanes that share their idle ones.
ALPHA, BETA, THRESHOLD, BLOCK = 0.5, 0.5, 0.3, 256


def max_outdegree(graph: Graph) -> DataFrame:
    """One row; at least 1, so that scores can divide by it."""
    return graph.degrees().agg(F.greatest(F.coalesce(F.max("outdegree"), F.lit(1)), F.lit(1).cast("long")).alias("max_outdegree"))


def _value_term(kind: str, value: Column) -> Column:
    if kind == "distance":
        return F.try_divide(F.lit(1.0), value + 1)
    if kind == "rank":
        return F.abs(value)
    return F.lit(1.0) / (F.abs(value) + 1)


def criticality(graph: Graph, values: DataFrame, kind: str = "integer", alpha: float = ALPHA, beta: float = BETA, threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, critical) from ``values(id, value)``.

    ``kind``: ``distance`` weighs near vertices, ``integer`` small absolute values, ``rank`` large absolute values.
    """
    degrees = graph.degrees().select("id", "outdegree").crossJoin(F.broadcast(max_outdegree(graph)))
    term = _value_term(kind, F.col("value").cast("double"))
    score = F.lit(alpha) * F.col("outdegree") / F.col("max_outdegree") + F.lit(beta) * term
    return values.join(degrees, "id").select("id", score.alias("score")).withColumn("critical", F.col("score") >= threshold)


def dmr_coverage(lanes: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """(id, covered) for the critical rows of ``lanes(id, active, critical)``.

    A block's idle lanes, padding of the last block included, recompute as many of its critical vertices, by rising id.
    """
    rows = lanes.withColumn("block", F.floor(F.col("id") / block))
    last = (size - 1) // block
    padding = (last + 1) * block - size
    idle = rows.groupBy("block").agg((F.count_if(~F.col("active")) + F.when(F.first("block") == last, F.lit(padding)).otherwise(F.lit(0))).alias("idle"))
    critical = rows.where("active and critical").withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("id")))
    return critical.join(idle, "block").select("id", (F.col("nth") <= F.col("idle")).alias("covered"))


def dmr_compare(primary: DataFrame, redundant: DataFrame, absolute: float | None = None) -> DataFrame:
    """(id, mismatch) of ``primary(id, value)`` against an independent recomputation of some ids.

    Integers must be equal; with ``absolute``, floats must be finite and differ by no more.
    """
    both = redundant.select("id", F.col("value").alias("again")).join(primary, "id", "left")
    if absolute is None:
        wrong = ~F.col("value").eqNullSafe(F.col("again"))
    else:
        infinite = F.lit(float("inf"))
        odd = F.col("value").isNull() | F.isnan("value") | F.isnan("again") | (F.abs("value") == infinite) | (F.abs("again") == infinite)
        wrong = odd | (F.abs(F.col("value") - F.col("again")) > absolute)
    return both.select("id", wrong.alias("mismatch"))


def monotonic_violations(before: DataFrame, after: DataFrame, rising: bool) -> DataFrame:
    """One row: how many of (id, value) moved against the direction that the program allows."""
    both = before.select("id", F.col("value").alias("old")).join(after, "id")
    wrong = F.col("value") < F.col("old") if rising else F.col("value") > F.col("old")
    return both.agg(F.count_if(wrong).alias("violations"), F.bool_or(wrong).alias("monotonic_error"))


def trend_check(checks: DataFrame) -> DataFrame:
    """One row: the first round whose mean change exceeds that of the round before, among rounds that changed anything."""
    rounds = checks.where("count_update > 0").withColumn("avg_delta", F.col("sum_abs_delta") / F.col("count_update"))
    rounds = rounds.withColumn("before", F.lag("avg_delta").over(Window.orderBy("iter")))
    return rounds.agg(F.min(F.when(F.col("avg_delta") > F.col("before"), F.col("iter"))).alias("first_trend_iter"))


def merge_checks(rank_checks: DataFrame) -> DataFrame:
    """(iter, checked, dmr_error, monotonic_error, sum_abs_delta, count_update): rounds that every rank completed count."""
    return rank_checks.groupBy("iter").agg(
        F.bool_and("done").alias("checked"), F.bool_or("dmr_error").alias("dmr_error"), F.bool_or("monotonic_error").alias("monotonic_error"),
        F.sum("sum_abs_delta").alias("sum_abs_delta"), F.sum("count_update").alias("count_update"),
    )


def check_report(merged: DataFrame) -> DataFrame:
    """One row: rounds checked and skipped, and the first round of each kind of error."""
    done = F.col("checked")
    return merged.agg(
        F.count_if(done).alias("checked"), F.count_if(~done).alias("skipped"),
        F.min(F.when(done & F.col("dmr_error"), F.col("iter"))).alias("first_dmr_iter"),
        F.min(F.when(done & F.col("monotonic_error"), F.col("iter"))).alias("first_monotonic_iter"),
    ).crossJoin(trend_check(merged.where("checked")))
