"""Graphs derived from relational tables; each has one SQL text that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _consecutive(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    pairs = rows.select(F.col(value).cast("long").alias("src"), F.lead(value).over(Window.partitionBy(key).orderBy(*order)).cast("long").alias("dst"))
    return pairs.where("dst is not null and src <> dst")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Consecutive parts inside an order."""
    return Graph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), _consecutive(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber", "l_partkey"))


PART_NEXT_SQL = """SELECT src, dst FROM (SELECT CAST(l_partkey AS BIGINT) AS src, CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS BIGINT) AS dst
        FROM lineitem) WHERE dst IS NOT NULL AND src <> dst"""


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users whose events follow each other on a day."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return Graph(events.select(F.col("user_id").alias("id")).distinct(), _consecutive(events, "day", "user_id", "ts", "event_id"))


USERS_SQL = "SELECT DISTINCT CAST(user_id AS BIGINT) AS id FROM events"
USER_NEXT_SQL = """SELECT src, dst FROM (SELECT CAST(user_id AS BIGINT) AS src, CAST(lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS dst
        FROM events) WHERE dst IS NOT NULL AND src <> dst"""


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order and the next one of the same customer."""
    orders = table(spark, sf_dir, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(F.col("o_orderkey").cast("long").alias("src"), after.cast("long").alias("dst")).where("dst is not null")
    return Graph(orders.select(F.col("o_orderkey").alias("id")), edges)


ORDER_CHAIN_SQL = """SELECT src, dst FROM (SELECT CAST(o_orderkey AS BIGINT) AS src, CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS dst
        FROM orders) WHERE dst IS NOT NULL"""


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier ids read as one id space: self-loops and duplicates."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst"))


RAW_PAIRS_SQL = "SELECT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst FROM lineitem"
