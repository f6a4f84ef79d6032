"""Contiguous vertex ranges, ghosts and exchange plans for a number of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import Graph


def partition_ranges(spark: SparkSession, vertices: int, ranks: int) -> DataFrame:
    """(rank, start, size): balanced ranges of 0..vertices-1; the first ``vertices % ranks`` are larger by one."""
    base, more = divmod(vertices, ranks)
    rank = F.col("id").cast("int")
    start = F.col("id") * base + F.least("id", F.lit(more))
    return spark.range(ranks).select(rank.alias("rank"), start.cast("long").alias("start"), (F.lit(base) + F.when(F.col("id") < more, 1).otherwise(0)).cast("long").alias("size"))


def owner_of(vertex: Column, vertices: int, ranks: int) -> Column:
    """The rank whose range holds a vertex."""
    base, more = divmod(vertices, ranks)
    big = more * (base + 1)
    later = F.lit(more) + F.floor((vertex - big) / max(base, 1))
    return F.when(vertex < big, F.floor(vertex / (base + 1))).otherwise(later).cast("int")


def _cut(graph: Graph, vertices: int, ranks: int) -> DataFrame:
    edges = graph.edges.select("src", "dst", owner_of(F.col("src"), vertices, ranks).alias("src_rank"), owner_of(F.col("dst"), vertices, ranks).alias("dst_rank"))
    return edges.where("src_rank <> dst_rank")


def ghost_vertices(graph: Graph, vertices: int, ranks: int) -> DataFrame:
    """(rank, vertex): remote ends of a rank's edges, in either direction."""
    cut = _cut(graph, vertices, ranks)
    out = cut.select(F.col("src_rank").alias("rank"), F.col("dst").alias("vertex"))
    return out.unionByName(cut.select(F.col("dst_rank").alias("rank"), F.col("src").alias("vertex"))).distinct()


def partition_sizes(graph: Graph, vertices: int, ranks: int) -> DataFrame:
    """(rank, owned, ghosts, out_edges, in_edges)."""
    spark = graph.vertices.sparkSession
    ranges = partition_ranges(spark, vertices, ranks).select("rank", F.col("size").alias("owned"))
    ghosts = ghost_vertices(graph, vertices, ranks).groupBy("rank").agg(F.count("*").alias("ghosts"))
    outs = graph.edges.groupBy(owner_of(F.col("src"), vertices, ranks).alias("rank")).agg(F.count("*").alias("out_edges"))
    ins = graph.edges.groupBy(owner_of(F.col("dst"), vertices, ranks).alias("rank")).agg(F.count("*").alias("in_edges"))
    joined = ranges.join(ghosts, "rank", "left").join(outs, "rank", "left").join(ins, "rank", "left")
    return joined.select("rank", "owned", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ghosts", "out_edges", "in_edges")])


def activation_plan(graph: Graph, vertices: int, ranks: int) -> DataFrame:
    """(sender, owner, vertex): remote vertices that a rank's out-edges can activate, each once."""
    return _cut(graph, vertices, ranks).select(F.col("src_rank").alias("sender"), F.col("dst_rank").alias("owner"), F.col("dst").alias("vertex")).distinct()


def value_plan(graph: Graph, vertices: int, ranks: int) -> DataFrame:
    """(owner, receiver, vertex): owned vertices whose values other ranks hold as ghosts."""
    return ghost_vertices(graph, vertices, ranks).select(owner_of(F.col("vertex"), vertices, ranks).alias("owner"), F.col("rank").alias("receiver"), "vertex")


def exchange_volume(graph: Graph, vertices: int, ranks: int) -> DataFrame:
    """(sender, receiver, activations, vertex_values): entries a round sends at most, with displacements in sender order."""
    act = activation_plan(graph, vertices, ranks).groupBy("sender", F.col("owner").alias("receiver")).agg(F.count("*").alias("activations"))
    val = value_plan(graph, vertices, ranks).groupBy(F.col("owner").alias("sender"), "receiver").agg(F.count("*").alias("vertex_values"))
    both = act.join(val, ["sender", "receiver"], "full").select("sender", "receiver", F.coalesce("activations", F.lit(0)).alias("activations"), F.coalesce("vertex_values", F.lit(0)).alias("vertex_values"))
    before = F.sum("vertex_values").over(Window.partitionBy("sender").orderBy("receiver").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("displacement", F.coalesce(before, F.lit(0)))
