"""MatrixMarket and edge-list text, id clean-up and compaction, and result files.

Readers take a DataFrame of lines ``(pos, value)``; ``read_lines`` makes one from files. ``pos`` orders lines as the files
do, so first appearances are defined without a global sort of the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.runs import joined_url
from ..plans import Graph, scratch


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a text file; positions rise through the file but are not dense."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")


def mtx_rows(lines: DataFrame) -> DataFrame:
    """(pos, first, second, third): the tokens of lines that are neither empty nor comments; commas count as spaces."""
    text = F.trim(F.translate("value", ",\t", "  "))
    parts = F.split(text, r"\s+")
    return lines.where((text != "") & ~F.startswith(text, F.lit("%"))).select("pos", *[F.get(parts, i).alias(n) for i, n in enumerate(("first", "second", "third"))])


def mtx_header(lines: DataFrame) -> DataFrame:
    """One row: rows, cols, nnz and the vertex count, the larger of rows and cols."""
    head = mtx_rows(lines).agg(F.min_by(F.struct("first", "second", "third"), "pos").alias("h"))
    number = lambda c: F.col(f"h.{c}").try_cast("long")
    return head.select(number("first").alias("n_rows"), number("second").alias("n_cols"), number("third").alias("nnz"), F.greatest(number("first"), number("second")).alias("n_vertices"))


def mtx_parse(lines: DataFrame) -> DataFrame:
    """(src, dst, weight) of the lines after the size line; a missing weight is 1."""
    rows = mtx_rows(lines)
    head = rows.agg(F.min("pos").alias("__head"))
    body = rows.crossJoin(F.broadcast(head)).where("pos > __head")
    return body.select(F.col("first").try_cast("long").alias("src"), F.col("second").try_cast("long").alias("dst"), F.coalesce(F.col("third").try_cast("double"), F.lit(1.0)).alias("weight"))


def rebase_ids(edges: DataFrame, base: int | str = "auto", vertices: int | None = None) -> DataFrame:
    """Edges with ids from 0. ``auto``: one-based if all ids are at least 1 and none exceeds ``vertices``."""
    if base == "auto":
        low, high = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        base = 1 if low is not None and low >= 1 and (vertices is None or high <= vertices) else 0
    return edges.withColumns({"src": F.col("src") - base, "dst": F.col("dst") - base})


def graph_from_mtx(lines: DataFrame, base: int | str = "auto") -> Graph:
    """A graph of all declared vertices; raises if the edges do not match the size line."""
    spark = lines.sparkSession
    head = mtx_header(lines).first()
    if head is None or head["nnz"] is None:
        raise ValueError("missing MatrixMarket size line")
    edges = rebase_ids(mtx_parse(lines), base, head["n_vertices"])
    found = edges.agg(F.count("*").alias("n"), F.count_if(~F.col("src").between(0, head["n_vertices"] - 1) | ~F.col("dst").between(0, head["n_vertices"] - 1) | F.col("src").isNull() | F.col("dst").isNull()).alias("bad")).first()
    if found["n"] != head["nnz"]:
        raise ValueError(f"{found['n']} edges, {head['nnz']} declared")
    if found["bad"]:
        raise ValueError(f"{found['bad']} edges with ids out of range")
    return Graph(spark.range(head["n_vertices"]), edges)


def edge_list_parse(lines: DataFrame) -> DataFrame:
    """(pos, src, dst): the first two integers of each line that is not a comment (#, %, //); commas count as spaces."""
    text = F.trim(F.translate("value", ",\t", "  "))
    parts = F.split(text, r"\s+")
    rows = lines.where((text != "") & ~text.rlike("^(#|%|//)")).select("pos", F.filter(parts, lambda x: x.rlike("^[+-]?[0-9]+$")).alias("ids"))
    return rows.where(F.size("ids") >= 2).select("pos", F.get("ids", 0).try_cast("long").alias("src"), F.get("ids", 1).try_cast("long").alias("dst"))


def clean_edges(edges: DataFrame, vertices: int | None = None) -> DataFrame:
    """Without self-loops, negative ids and, if ``vertices`` is given, ids out of range."""
    out = edges.where("src <> dst and src >= 0 and dst >= 0")
    return out if vertices is None else out.where((F.col("src") < vertices) & (F.col("dst") < vertices))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def compact_ids(edges: DataFrame) -> DataFrame:
    """(original_id, compact_id): ids from 0 in order of first appearance; a line's source comes before its target.

    Takes (pos, src, dst). First appearances are ranked by range partitions: each is numbered by itself and shifted by the
    sizes of those before it, so no single task sees all ids.
    """
    ends = clean_edges(edges).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("pos"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("id"), F.col("pos"), F.lit(1).alias("side")))).alias("e"))
    first = ends.select("e.*").groupBy("id").agg(F.min(F.struct("pos", "side")).alias("at"))
    ranged = scratch(first.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "compact")[0]
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("at")))
    return numbered.join(sizes.select("part", before.alias("base")), "part").select(F.col("id").alias("original_id"), (F.col("base") + F.col("nth") - 1).alias("compact_id"))


def compact_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) in compact ids, in no order."""
    ids = scratch(compact_ids(edges), "compact-ids")[0]
    left, right = ids.toDF("src", "__src"), ids.toDF("dst", "__dst")
    return clean_edges(edges).join(left, "src").join(right, "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst"))


def offsets(graph: Graph, by: str = "src") -> DataFrame:
    """(id, start, end): where each vertex's edges stand when edges are sorted by ``src`` (CSR) or ``dst`` (CSC)."""
    degree = F.col("outdegree" if by == "src" else "indegree")
    ranged = scratch(graph.degrees().select("id", degree.alias("d")).repartitionByRange("id").withColumn("part", F.spark_partition_id()), "offsets")[0]
    sizes = ranged.groupBy("part").agg(F.sum("d").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("d").over(Window.partitionBy("part").orderBy("id"))
    both = ranged.withColumn("inside", inside).join(sizes.select("part", before.alias("base")), "part")
    return both.select("id", (F.col("base") + F.col("inside") - F.col("d")).alias("start_at"), (F.col("base") + F.col("inside")).alias("end_at"))


def mtx_lines(graph: Graph, first_id: int = 0) -> DataFrame:
    """(pos, value): the graph as MatrixMarket text; position 0 and 1 are banner and size line, edges come after.

    ``first_id``: 1 writes ids from 1, as other readers expect.
    """
    spark = graph.vertices.sparkSession
    n, m = graph.vertices.count(), graph.edges.count()
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate pattern general"), (1, f"{n} {n} {m}")], "pos long, value string")
    return head.unionByName(graph.edges.select(F.lit(2).cast("long").alias("pos"), F.concat_ws(" ", F.col("src") + first_id, F.col("dst") + first_id).alias("value")))


def weighted_mtx_lines(lines: DataFrame) -> DataFrame:
    """(pos, value): an edge list's lines (pos, value) as MatrixMarket text, ids as they are and a missing weight 1.

    Lines that do not begin with two integers are left out; the size line counts ids up to the largest.
    """
    text = F.trim(F.translate("value", "\t", " "))
    parts = F.split(text, r"\s+")
    rows = lines.where((text != "") & ~text.rlike("^[#%/]")).select(F.get(parts, 0).try_cast("long").alias("src"), F.get(parts, 1).try_cast("long").alias("dst"), F.coalesce(F.get(parts, 2), F.lit("1")).alias("weight"))
    rows = rows.where("src is not null and dst is not null")
    n = F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0))
    head = rows.agg(F.concat_ws(" ", n, n, F.count("*")).alias("value")).select(F.lit(1).cast("long").alias("pos"), "value")
    banner = lines.sparkSession.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general")], "pos long, value string")
    return banner.unionByName(head).unionByName(rows.select(F.lit(2).cast("long").alias("pos"), F.concat_ws(" ", "src", "dst", "weight").alias("value")))


def write_values(values: DataFrame, path: str, decimals: int | None = None) -> None:
    """One line a vertex, by id: the text result file."""
    value = F.col("value").cast("string") if decimals is None else F.format_string(f"%.{decimals}f", F.col("value"))
    values.orderBy("id").select(value.alias("value")).write.mode("overwrite").text(path)


#: An anchor's start tag with the value of its href, in either quotes or none.
ANCHOR = r"""(?i)<a(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, page_url, url, place, n): what the anchors of each page link to, as whole URLs, where first and how often."""
    html = F.col(html_col).cast("string")
    found = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(i)).alias(f"h{i}") for i in (1, 2, 3)])
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("page_url"), F.posexplode(found).alias("place", "h"))
    href = F.trim(F.concat("h.h1", "h.h2", "h.h3"))
    links = rows.where(href != "").select("__id", "page_url", joined_url(F.col("page_url"), href).alias("url"), "place")
    return links.groupBy("__id", "page_url", "url").agg(F.min("place").alias("place"), F.count("*").alias("n")).withColumnRenamed("__id", id_col)
