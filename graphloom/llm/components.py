"""Connected components of an undirected edge list, by minimum labels and pointer jumping.

Every round, each node takes the smallest label among itself and its neighbours (combined on the map side, so a node with
very many neighbours never meets in one task) and then its label's label. Rounds are written to the shared folder, which
cuts the lineage and survives lost executors; nothing but the number of changes reaches the driver.

Defined cases: edges with a null end join nothing and are left out, like those from a node to itself; edges may repeat and
stand in both directions; no edges give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label): every node of an edge with the smallest node of its component."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "cc-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "label")
        told = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).unionByName(heard)
        nearer = materialize(told.groupBy("node").agg(F.min("label").alias("label")), "cc-round")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = nearer.join(jump, "label").select("node", F.col("far").alias("label"))
        after = materialize(jumped, "cc-labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        forget(nearer)
        forget(labels)
        labels = after
        if not changed:
            forget(both)
            return labels
