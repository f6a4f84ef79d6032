"""Structural statistics of directed multigraphs and of their undirected simple graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import Graph, scratch
from .traversal import core_numbers


def graph_summary(graph: Graph) -> DataFrame:
    """One row: V, E, dmax, davg of the directed multigraph without self-loops."""
    clean = Graph(graph.vertices, graph.edges.where("src <> dst"))
    return clean.degrees().agg(
        F.count("*").alias("v"), F.sum("outdegree").alias("e"), F.max("total_degree").alias("dmax"), F.try_divide(F.lit(2.0) * F.sum("outdegree"), F.count("*")).alias("davg")
    )


def simple_degrees(graph: Graph) -> DataFrame:
    """(id, degree) in the simple graph, for every vertex."""
    simple = graph.simple()
    ends = simple.select(F.col("u").alias("id")).unionByName(simple.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return graph.vertices.join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_summary_simple(graph: Graph) -> DataFrame:
    """One row: V, E, dmax, davg of the simple graph."""
    return simple_degrees(graph).agg(
        F.count("*").alias("v"),
        (F.sum("degree") / 2).cast("long").alias("e"),
        F.max("degree").alias("dmax"),
        F.try_divide(F.sum("degree").cast("double"), F.count("*")).alias("davg"),
    )


def _assortativity(pairs: DataFrame) -> DataFrame:
    """One row from the two end degrees ``j`` and ``k`` of every edge; null where the degrees do not vary."""
    j, k = F.col("j").cast("double"), F.col("k").cast("double")
    sums = pairs.agg(F.avg(j * k).alias("p"), F.avg((j + k) / 2).alias("m"), F.avg((j * j + k * k) / 2).alias("q"))
    return sums.select(F.try_divide(F.col("p") - F.col("m") * F.col("m"), F.nullif(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("r"))


def _with_end_degrees(edges: DataFrame, degrees: DataFrame, a: str, b: str) -> DataFrame:
    left = degrees.select(F.col("id").alias(a), F.col("d").alias("j"))
    right = degrees.select(F.col("id").alias(b), F.col("d").alias("k"))
    return edges.join(left, a).join(right, b)


def assortativity_directed(graph: Graph) -> DataFrame:
    clean = Graph(graph.vertices, graph.edges.where("src <> dst"))
    degrees = clean.degrees().select("id", F.col("total_degree").alias("d"))
    return _assortativity(_with_end_degrees(clean.edges, degrees, "src", "dst"))


def assortativity_simple(graph: Graph) -> DataFrame:
    return _assortativity(_with_end_degrees(graph.simple(), simple_degrees(graph).select("id", F.col("degree").alias("d")), "u", "v"))


def _oriented(graph: Graph) -> DataFrame:
    """Simple edges from the end of lower (degree, id) to the other: out-degrees stay below the square root of twice E."""
    ends = _with_end_degrees(graph.simple(), simple_degrees(graph).select("id", F.col("degree").alias("d")), "u", "v")
    forward = (F.col("j") < F.col("k")) | ((F.col("j") == F.col("k")) & (F.col("u") < F.col("v")))
    return ends.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("b"))


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c): each triangle once."""
    arcs = scratch(_oriented(graph), "arcs")[0]
    wedges = arcs.join(arcs.select("a", F.col("b").alias("c")), "a").where("b < c")
    closing = arcs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    return wedges.join(closing, ["b", "c"], "left_semi").select("a", "b", "c")


def triangle_count(graph: Graph) -> DataFrame:
    return triangles(graph).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    corners = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return graph.vertices.join(corners, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def edge_triangles(graph: Graph) -> DataFrame:
    """One row: mean and largest number of triangles that an edge is in."""
    sides = triangles(graph).select(F.explode(F.array(F.struct(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), F.struct(F.least("a", "c").alias("u"), F.greatest("a", "c").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")))).alias("e"))
    counted = sides.groupBy("e").agg(F.count("*").alias("n"))
    whole = graph.simple().select(F.struct("u", "v").alias("e")).join(counted, "e", "left")
    return whole.agg(F.try_divide(F.sum(F.coalesce("n", F.lit(0))).cast("double"), F.count("*")).alias("t_avg"), F.coalesce(F.max("n"), F.lit(0)).alias("t_max"))


def clustering_local(graph: Graph) -> DataFrame:
    """One row: mean local clustering over all vertices."""
    d = F.col("degree")
    local = F.when(d >= 2, F.lit(2.0) * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0))
    return simple_degrees(graph).join(triangles_per_vertex(graph), "id").agg(F.avg(local).alias("kappa_avg"))


def clustering_global(graph: Graph) -> DataFrame:
    """One row: three times the triangles over the connected triples; null without triples."""
    d = F.col("degree")
    triples = simple_degrees(graph).agg(F.sum((d * (d - 1) / 2).cast("long")).alias("triples"))
    return triangle_count(graph).crossJoin(triples).select(F.try_divide(F.lit(3.0) * F.col("triangles"), F.nullif("triples", F.lit(0))).alias("kappa"))


def clique_lower_bound(graph: Graph) -> DataFrame:
    """One row: size of the larger of two greedily grown cliques.

    A clique takes the first candidate, by falling degree and rising or falling id, and keeps the candidates that neighbour
    it. The loop reads one row a round, and runs as often as the clique is large.
    """
    spark = graph.vertices.sparkSession
    simple = graph.simple()
    both = scratch(simple.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(simple.select(F.col("v").alias("x"), F.col("u").alias("y"))), "clique-edges")[0]
    degrees = scratch(simple_degrees(graph), "clique-degrees")[0]
    best = 0
    for then in (F.asc("id"), F.desc("id")):
        candidates, size = degrees, 0
        while (first := candidates.orderBy(F.desc("degree"), then).select("id").first()) is not None:
            size += 1
            near = both.where(F.col("x") == first["id"]).select(F.col("y").alias("id"))
            candidates = scratch(candidates.join(near, "id", "left_semi"), "clique")[0]
        best = max(best, size)
    return spark.createDataFrame([(best,)], "omega_lb long")


def top_sources(graph: Graph, k: int = 10) -> DataFrame:
    """The ``k`` best traversal sources by out-degree, total degree, then smallest id."""
    clean = Graph(graph.vertices, graph.edges.where("src <> dst"))
    order: list[Column] = [F.desc("outdegree"), F.desc("total_degree"), F.asc("id")]
    best = clean.degrees().orderBy(*order).limit(k)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col("id").alias("vertex"), "outdegree", "indegree", "total_degree")


def source_metadata(graph: Graph, name: str) -> DataFrame:
    """One row that describes the graph and its best source."""
    best = top_sources(graph, 1)
    total = Graph(graph.vertices, graph.edges.where("src <> dst")).degrees().agg(F.count("*").alias("nodes"), F.sum("outdegree").alias("valid_edges"))
    every = graph.edges.agg(F.count("*").alias("edges"))
    return total.crossJoin(every).crossJoin(best).select(
        F.lit(name).alias("dataset"), "nodes", "edges", "valid_edges", F.col("vertex").alias("bfs_source"), F.col("outdegree").alias("bfs_source_outdegree"),
        F.col("indegree").alias("bfs_source_indegree"), F.col("total_degree").alias("bfs_source_total_degree"),
        F.try_divide(F.lit(2.0) * F.col("valid_edges"), F.col("nodes")).alias("avg_degree"), F.try_divide(F.col("valid_edges").cast("double"), F.col("nodes")).alias("avg_outdegree"),
    )


def describe(graphs: dict[str, Graph]) -> DataFrame:
    """One row a graph: all statistics of its simple graph, by name."""
    found = None
    for name, graph in graphs.items():
        row = graph_summary_simple(graph).withColumn("dataset", F.lit(name))
        core = core_numbers(graph)[0].agg(F.coalesce(F.max("core"), F.lit(0)).alias("k_max"))
        for one in (assortativity_simple(graph), triangle_count(graph), edge_triangles(graph), clustering_local(graph), clustering_global(graph), core, clique_lower_bound(graph)):
            row = row.crossJoin(one)  # one row each
        found = row if found is None else found.unionByName(row)
    return found
