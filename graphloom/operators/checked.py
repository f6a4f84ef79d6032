"""Vertex programs that check themselves: redundant recomputation, monotonicity and changes, observed inside every round.

A round pulls a new value for every active vertex from its in-edges. Active vertices of a high criticality score are
computed once more, from the raw edges and the values before the round, as far as the idle lanes of their block reach; a
result that differs is an error. What a round changed, and whether a value went the wrong way, is counted over the rows
that the round writes, in the same job. All vertices are active in the first round, later the out-neighbours of those that
changed. Errors are reported, never repaired.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import Graph, remove, scratch
from ..plans.fixpoint import MAX_ROUNDS, stopped
from . import detection, traversal


@dataclass(frozen=True)
class Program:
    """How a vertex program pulls: ``pulls`` are the aggregates over in-edges (columns theirs, share) that ``update`` uses.

    ``rising``: the only direction in which values may move; None: both. ``calls``: whether a row's change activates its
    out-neighbours; ``counts``: whether it counts as a change. ``living``: dead vertices send nothing and are never active.
    """

    kind: str
    start: Callable[[Graph], DataFrame]
    pull: Callable[[], Column]
    update: Callable[[Column, Column], Column]
    calls: Column
    counts: Column
    rising: bool | None
    living: Column = field(default_factory=lambda: F.lit(True))


def bfs_program(source: int) -> Program:
    start = lambda graph: graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0)).otherwise(F.lit(traversal.UNREACHABLE)).alias("value"))
    nearer = F.col("value") < F.col("old")
    return Program("distance", start, lambda: F.min("theirs") + 1, lambda old, got: F.least(old, F.coalesce(got, old)), nearer, nearer, rising=False)


def cc_program() -> Program:
    larger = F.col("value") > F.col("old")
    return Program("integer", lambda graph: graph.vertices.select("id", F.col("id").alias("value")), lambda: F.max("theirs"), lambda old, got: F.greatest(old, F.coalesce(got, old)), larger, larger, rising=True)


def kcore_program(k: int, only_deaths: bool = False) -> Program:
    """``only_deaths``: changes count where a vertex dies, else wherever a recount differs."""
    died, differs = (F.col("value") < k) & F.col("lived"), F.col("value") != F.col("old")
    start = lambda graph: graph.degrees().select("id", F.col("indegree").alias("value"))
    return Program("integer", start, lambda: F.count("theirs"), lambda old, got: F.coalesce(got, F.lit(0)), died, died if only_deaths else differs, rising=False, living=F.col("lived") & (F.col("value") >= k))


def pagerank_program(alpha: float = traversal.ALPHA, tolerance: float = traversal.TOLERANCE) -> Program:
    def start(graph: Graph) -> DataFrame:
        return graph.vertices.select("id", F.lit(1.0 / max(graph.vertices.count(), 1)).alias("value"))

    delta = F.abs(F.col("value") - F.col("old"))
    return Program("rank", start, lambda: F.sum(F.col("theirs") / F.col("outdegree")), lambda old, got: F.lit(1 - alpha) + F.lit(alpha) * F.coalesce(got, F.lit(0.0)), delta >= tolerance, delta != 0, rising=None)


#: What a round reports, in this order.
EVIDENCE = "iter int, active long, critical long, covered long, dmr_errors long, monotonic_errors long, count_update long, sum_abs_delta double"


def run_checked(
    graph: Graph, program: Program, alpha: float = detection.ALPHA, beta: float = detection.BETA, threshold: float = detection.THRESHOLD, block: int = detection.BLOCK,
    fault: Callable[[Column, Column, int], Column] | None = None, absolute: float | None = None, max_rounds: int = MAX_ROUNDS,
) -> tuple[DataFrame, list[dict]]:
    """((id, value, alive), history) of a program with its evidence round by round.

    ``fault(id, value, round)`` changes what the redundant lanes compute, to show that errors are found. ``absolute``: how
    far floats may differ that were summed in another order; None compares exactly.
    """
    degrees = graph.degrees().select("id", "outdegree")
    size, most = degrees.agg(F.count("*"), F.greatest(F.coalesce(F.max("outdegree"), F.lit(1)), F.lit(1))).first()
    start = program.start(graph).join(degrees, "id").select("id", "value", F.col("value").alias("old"), "outdegree", F.lit(True).alias("lived"), F.lit(True).alias("calls"))
    state, _ = scratch(start.withColumn("lived", F.lit(True)), "checked")
    edges = graph.edges.repartition("src").persist()
    last_block, padding = (size - 1) // block, -size % block
    by = Window.partitionBy("block")
    history: list[dict] = []

    def pulled(targets: DataFrame | None, values: DataFrame) -> DataFrame:
        rows = edges if targets is None else edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
        return rows.join(values.select(F.col("id").alias("src"), F.col("value").alias("theirs"), "outdegree"), "src").groupBy(F.col("dst").alias("id")).agg(program.pull().alias("got"))

    try:
        for round_no in range(1, max_rounds + 1):
            now = state.select("id", "value", "outdegree", F.col("lived").alias("alive")) if round_no == 1 else state.select("id", "value", "outdegree", program.living.alias("alive"))
            sending = now.where("alive")
            called = F.col("alive") & F.col("called").isNotNull()
            if round_no == 1:
                lanes = now.withColumn("active", F.lit(True))
            else:
                near = edges.join(state.where("calls").select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
                lanes = now.join(near, "id", "left").withColumn("active", called).drop("called")
            score = F.lit(alpha) * F.col("outdegree") / F.lit(most) + F.lit(beta) * detection._value_term(program.kind, F.col("value").cast("double"))
            lanes = lanes.withColumns({"critical": F.col("active") & (score >= threshold), "block": F.floor(F.col("id") / block)})
            idle = F.count_if(~F.col("active")).over(by) + F.when(F.col("block") == last_block, F.lit(padding)).otherwise(F.lit(0))
            nth = F.row_number().over(Window.partitionBy("block", "critical").orderBy("id"))
            lanes, seen = scratch(lanes.withColumn("covered", F.col("critical") & (nth <= idle)).drop("block"), "lanes", active=F.count_if("active"), critical=F.count_if("critical"), covered=F.count_if("covered"))
            if not seen["active"]:
                remove(lanes)
                break
            primary = pulled(lanes.where("active"), sending)
            again = lanes.where("covered").select("id", "value").join(pulled(lanes.where("covered"), sending), "id", "left").select("id", program.update(F.col("value"), F.col("got")).alias("again"))
            if fault is not None:
                again = again.withColumn("again", fault(F.col("id"), F.col("again"), round_no))
            both = lanes.join(primary, "id", "left").join(again, "id", "left")
            new = F.when(F.col("active"), program.update(F.col("value"), F.col("got"))).otherwise(F.col("value"))
            after = both.select("id", new.alias("value"), F.col("value").alias("old"), "outdegree", F.col("alive").alias("lived"), "active", "covered", "again")
            wrong = ~F.col("again").eqNullSafe(F.col("value")) if absolute is None else ~F.coalesce(F.abs(F.col("again") - F.col("value")) <= absolute, F.lit(False)) | F.isnan("again")
            after = after.select("*", (F.col("active") & program.calls).alias("calls"), (F.col("active") & program.counts).alias("moved"), (F.col("covered") & wrong).alias("differs"))
            against = F.lit(False) if program.rising is None else F.col("value") < F.col("old") if program.rising else F.col("value") > F.col("old")
            after, found = scratch(
                after.drop("again"), "checked", dmr_errors=F.count_if("differs"), monotonic_errors=F.count_if(F.col("active") & against), count_update=F.count_if("moved"),
                sum_abs_delta=F.coalesce(F.sum(F.when(F.col("moved"), F.abs(F.col("value") - F.col("old")))), F.lit(0)).cast("double"),
            )
            history.append({"iter": round_no, **seen, **found})
            remove(state)
            remove(lanes)
            state = after
        else:
            stopped("checked " + program.kind, max_rounds)
    finally:
        edges.unpersist()
    return state.select("id", "value", program.living.alias("alive")), history
