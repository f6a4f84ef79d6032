"""Vertex programs: hop distances, largest reaching label, directed k-core, active-set PageRank, coreness.

Rounds write what they change and nothing else (``Layers``), and join only the edges of vertices that changed
(``Adjacency``): hop distances and labels are monotone, the k-core subtracts the edges of newly dead vertices, and PageRank
sums over the in-edges of active vertices, which it selects first where they are few. ``checked`` has the same programs with
redundant recomputation inside the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import Adjacency, Fixpoint, Graph, Layers, scratch
from ..plans.fixpoint import MAX_ROUNDS, stopped

#: The distance of unreachable vertices, and PageRank's damping and tolerance.
UNREACHABLE = 100_000
ALPHA, TOLERANCE = 0.85, 1e-3
#: Active vertices that are sent to the edges at most, and the part of all vertices up to which it pays to select.
MOST_SENT, FEW = 500_000, 0.1

def _rows() -> Column:
    return F.count(F.lit(1))


def bfs(graph: Graph, source: int, max_rounds: int = MAX_ROUNDS, unreachable: int | None = UNREACHABLE) -> tuple[DataFrame, list[dict]]:
    """((id, distance), history). Each vertex is written in the round that reaches it."""
    graph.require_vertex(source)
    frontier = graph.vertices.sparkSession.createDataFrame([(source, 0)], "id long, distance int")
    reached, history = Layers("bfs"), []
    reached.add(frontier, 1)
    with Adjacency(graph.edges) as edges:
        for round_no in range(1, max_rounds + 1):
            near = edges.of(frontier.select(F.col("id").alias("src"))).select(F.col("dst").alias("id")).distinct()
            fresh = near.join(reached.rows().select("id"), "id", "left_anti").withColumn("distance", F.lit(round_no))
            frontier, found = scratch(fresh, "bfs", new=_rows())
            history.append({"iter": round_no, "new": found["new"]})
            if not found["new"]:
                break
            reached.add(frontier, found["new"])
        else:
            stopped("bfs", max_rounds)
    out = graph.vertices.join(reached.rows(), "id", "left")
    return out.select("id", F.coalesce("distance", F.lit(unreachable).cast("int")).alias("distance")), history


def max_labels(graph: Graph, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[dict]]:
    """((id, label), history): the largest vertex from which ``id`` is reached along directed edges, itself included."""
    labels, history = Layers("labels", lambda: [F.max("label").alias("label")]), []
    moved, found = scratch(graph.vertices.select("id", F.col("id").alias("label")), "labels", n=_rows())
    labels.add(moved, found["n"])
    with Adjacency(graph.edges.where("src <> dst")) as edges:
        for round_no in range(1, max_rounds + 1):
            heard = edges.of(moved.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id")).agg(F.max("label").alias("new"))
            old = labels.rows().join(heard, "id").groupBy("id").agg(F.max("label").alias("old"), F.max("new").alias("label"))
            rises = old.where("label > old").withColumn("delta", F.col("label") - F.col("old"))
            risen, found = scratch(rises, "labels", count_update=_rows(), sum_abs_delta=F.coalesce(F.sum("delta"), F.lit(0)))
            moved = risen.select("id", "label")
            history.append({"iter": round_no, **found})
            if not found["count_update"]:
                break
            labels.add(moved, found["count_update"])
        else:
            stopped("labels", max_rounds)
    return labels.settled(), history


def kcore(graph: Graph, k: int, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[dict]]:
    """((id, alive, support), history): vertices left when those with fewer than ``k`` living in-edges die, round by round.

    ``support`` counts living in-edges with multiplicity; it is null for dead vertices. A round's ``sum_abs_delta`` counts
    the support that living vertices lose, its ``death_delta`` that of the vertices which die of it.
    """
    supports, history = Layers("kcore", lambda: [F.min("support").alias("support")]), []
    metrics = {"rows": _rows(), "count_update": F.count_if(F.col("support") < k), "sum_abs_delta": F.coalesce(F.sum("delta"), F.lit(0)), "death_delta": F.coalesce(F.sum(F.when(F.col("support") < k, F.col("delta"))), F.lit(0))}
    start = graph.degrees().select("id", F.col("indegree").alias("support"), F.lit(0).cast("long").alias("delta"))
    with Adjacency(graph.edges) as edges:
        for round_no in range(1, max_rounds + 1):
            if round_no > 1:
                dead = last.where(F.col("support") < k).select(F.col("id").alias("src"))
                lost = edges.of(dead).groupBy(F.col("dst").alias("id")).agg(_rows().alias("delta"))
                alive = supports.rows().join(lost, "id").groupBy("id").agg(F.min("support").alias("support"), F.max("delta").alias("delta")).where(F.col("support") >= k)
                start = alive.withColumn("support", F.col("support") - F.col("delta"))
            last, found = scratch(start, "kcore", **metrics)
            history.append({"iter": round_no, **{name: found[name] for name in ("count_update", "sum_abs_delta", "death_delta")}})
            supports.add(last.select("id", "support"), found["rows"])
            if not found["count_update"]:
                break
        else:
            stopped("kcore", max_rounds)
    alive = F.col("support") >= k
    return supports.settled().select("id", alive.alias("alive"), F.when(alive, F.col("support")).alias("support")), history


def out_shares(graph: Graph) -> DataFrame:
    """(src, dst, share): parallel edges as one, with the part of its source's rank that it carries."""
    outdegrees = graph.edges.groupBy("src").agg(_rows().alias("outdegree"))
    return graph.edges.groupBy("src", "dst").agg(_rows().alias("times")).join(outdegrees, "src").select("src", "dst", (F.col("times") / F.col("outdegree")).alias("share"))


def pagerank(graph: Graph, alpha: float = ALPHA, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[dict]]:
    """((id, rank), history): unnormalized active-set PageRank on snapshots.

    An active vertex takes ``1 - alpha + alpha * sum(rank / outdegree)`` over its in-edges; others keep their rank. A change
    of ``tolerance`` or more activates the out-neighbours for the next round. The loop ends when none is active.
    """
    n = graph.vertices.count()
    ranks, history = Layers("pagerank", lambda: [F.max_by("rank", "at").alias("rank"), F.max("at").alias("at")]), []
    ranks.add(scratch(graph.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(0).alias("at")), "pagerank")[0], n)
    metrics = {"active": _rows(), "changed": F.count_if("changed"), "count_update": F.count_if(F.col("delta") != 0), "sum_abs_delta": F.coalesce(F.sum("delta"), F.lit(0.0))}
    active: DataFrame | None = graph.vertices
    with Adjacency(out_shares(graph)) as edges:
        for round_no in range(1, max_rounds + 1):
            now = ranks.settled()
            sent = now.select(F.col("id").alias("src"), "rank")
            if round_no > 1 and found["changed"] <= FEW * n:  # which vertices are active is worth a job of its own
                active, few = scratch(edges.of(last.where("changed").select(F.col("id").alias("src"))).select(F.col("dst").alias("id")).distinct(), "active", n=_rows())
                if few["n"] <= MOST_SENT:
                    active = F.broadcast(active)
                pulled = edges.of(sent).join(active.withColumnRenamed("id", "dst"), "dst", "left_semi")
                own = now.join(active, "id", "left_semi")
            else:
                sent = sent if round_no == 1 else sent.join(last.where("changed").select(F.col("id").alias("src"), F.lit(True).alias("calls")), "src", "left")
                pulled, own = edges.of(sent), now
            got = pulled.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("pulled"), (F.bool_or("calls") if "calls" in pulled.columns else F.lit(True)).alias("called"))
            both = own.join(got, "id", "left")
            if "calls" in pulled.columns:
                both = both.where("called")
            new = F.lit(1 - alpha) + F.lit(alpha) * F.coalesce("pulled", F.lit(0.0))
            moves = both.select("id", new.alias("rank"), F.abs(new - F.col("rank")).alias("delta"), (F.abs(new - F.col("rank")) >= tolerance).alias("changed"))
            last, found = scratch(moves, "pagerank", **metrics)
            if not found["active"]:
                break
            history.append({"iter": round_no, **found})
            ranks.add(last.select("id", "rank", F.lit(round_no).alias("at")), found["active"], whole=found["active"] == n)
            if not found["changed"]:
                break
        else:
            stopped("pagerank", max_rounds)
    return ranks.settled().select("id", "rank"), history


def core_numbers(graph: Graph, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[dict]]:
    """((id, core), history) of the undirected simple graph, by repeated H-indices of the neighbours' estimates.

    Estimates are counted per (vertex, value) before they are summed, so a hub's neighbours are never gathered.
    """
    simple = graph.simple()
    edges = simple.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(simple.select(F.col("v").alias("src"), F.col("u").alias("dst"))).repartition("src").persist()
    by = Window.partitionBy("id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)

    def step(state: DataFrame) -> DataFrame:
        values = edges.join(state.select(F.col("id").alias("src"), F.col("core").alias("theirs")), "src").select(F.col("dst").alias("id"), "theirs")
        values = values.join(state.select("id", "core"), "id").groupBy("id", "core", F.least("theirs", "core").alias("value")).agg(F.count("*").alias("n"))
        index = values.withColumn("above", F.sum("n").over(by)).groupBy("id", "core").agg(F.max(F.least("value", "above")).alias("new"))
        lone = state.where("core = 0").select("id", F.lit(0).cast("long").alias("core"), F.lit(False).alias("changed"))
        return index.select("id", F.col("new").cast("long").alias("core"), (F.col("new") != F.col("core")).alias("changed")).unionByName(lone)

    loop = Fixpoint(step, {"count_update": F.count_if("changed")}, lambda m: m["count_update"] > 0, max_rounds, "cores")
    try:
        degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core"))
        start = graph.vertices.join(degree, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"), F.lit(True).alias("changed"))
        state = loop.run(scratch(start, "cores")[0])
    finally:
        edges.unpersist()
    return state.select("id", "core"), loop.history


def history_frame(spark, history: list[dict], schema: str) -> DataFrame:
    """The rounds' evidence as a DataFrame; one row a round."""
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(h[n] for n in names) for h in history], schema)
