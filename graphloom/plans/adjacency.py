"""Edges kept by source for the rounds of a loop, with sources of very many edges cut into salted blocks.

Partitioning by source alone would give one task all edges of a hub, every round. A source of more than ``most`` edges is
cut into blocks of about that many, by a hash of the target, and the rows that a round joins to it are copied to each block.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import scratch

#: Edges of a block.
BLOCK_EDGES = 1 << 20
#: Heavy sources that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 100_000


class Adjacency:
    """Cached edges (src, dst, ...); a context manager that lets them go at its end."""

    def __init__(self, edges: DataFrame, most: int = BLOCK_EDGES):
        counted = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        self.heavy, found = scratch(counted.select("src", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "hubs", n=F.count(F.lit(1)))
        self.n_heavy = found["n"]
        if self.n_heavy:
            block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int"))
            edges = edges.join(self._sent(), "src", "left").withColumn("block", block).drop("blocks").repartition("src", "block")
        else:
            edges = edges.repartition("src")
        self.edges = edges.persist(StorageLevel.MEMORY_AND_DISK)

    def _sent(self) -> DataFrame:
        return F.broadcast(self.heavy) if self.n_heavy <= MOST_SENT else self.heavy

    def __enter__(self) -> Adjacency:
        return self

    def __exit__(self, *_) -> None:
        self.edges.unpersist()

    def of(self, rows: DataFrame) -> DataFrame:
        """The edges whose source is in ``rows`` (src, ...), with the columns of both."""
        if not self.n_heavy:
            return self.edges.join(rows, "src")
        blocks = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        dealt = rows.join(self._sent(), "src", "left").withColumn("block", F.explode(blocks)).drop("blocks")
        return self.edges.join(dealt, ["src", "block"]).drop("block")
