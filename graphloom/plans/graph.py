"""A directed multigraph as two DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Graph:
    """``vertices(id)`` and ``edges(src, dst)``; parallel edges and self-loops count, isolated vertices stay."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices = vertices.select(F.col("id").cast("long"))
        self.edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(vertices, edges)

    def symmetrize(self) -> Graph:
        """Every edge with its reverse."""
        return Graph(self.vertices, self.edges.unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))

    def simple(self) -> DataFrame:
        """Undirected edges (u < v), each once, without self-loops."""
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()

    def degrees(self) -> DataFrame:
        """(id, outdegree, indegree, total_degree), with multiplicity, for every vertex."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
            self.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
        )
        counted = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return self.vertices.join(counted, "id", "left").select("id", zero("o").alias("outdegree"), zero("i").alias("indegree"), (zero("o") + zero("i")).alias("total_degree"))

    def require_vertex(self, vertex: int) -> None:
        if self.vertices.where(F.col("id") == vertex).isEmpty():
            raise ValueError(f"vertex {vertex} is not in the graph")
