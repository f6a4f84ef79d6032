"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level only looks at what the level before left in groups of two or more: lengths are counted first, prefix hashes are
computed for rows whose length repeats, and the full SHA-256 for rows whose (length, prefix hash) pair repeats. The counts
are combined on the map side, so the text itself is never shuffled to find copies, and hot groups never meet in one task.
Repeating lengths and pairs are sent to the scans if they were counted and are few; else rows of a repeating length hash
their text in the scan, for the alternative is to shuffle the text.

Defined cases: a null text counts as the empty text and equals it; a null doc_id ranks below every other; of rows that
repeat both doc_id and text exactly one stays; an empty table gives an empty result; extra columns are ignored by
``exact_groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, materialize, text_of

#: Code points that the prefix hash covers.
PREFIX = 256


def _with_length(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the texts' lengths, and whether another row has the same one; and the two columns' names."""
    size, same = free_name(docs, "__len"), free_name(docs, "__same")
    rows = docs.withColumn(size, F.octet_length(text_of(text_col)))
    lengths = materialize(rows.groupBy(size).agg(F.count("*").alias("n")).where("n > 1").select(size, F.lit(True).alias(same)), "exact-lengths")
    return rows.join(_if_few(lengths), size, "left"), size, same


def _if_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _marked(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, Column]:
    """``docs`` with a flag of rows whose length and prefix hash repeat; its name; and the full hash of such rows."""
    full = F.sha2(text_of(text_col), 256)
    rows, size, same = _with_length(docs, text_col)
    prefix, hit = free_name(docs, "__ph"), free_name(docs, "__hit")
    hashed = rows.withColumn(prefix, F.when(F.col(same), F.xxhash64(F.substring(text_of(text_col), 1, PREFIX))))
    pairs = hashed.where(F.col(prefix).isNotNull()).groupBy(size, prefix).agg(F.count("*").alias("n")).where("n > 1").select(size, prefix, F.lit(True).alias(hit))
    pairs = materialize(pairs, "exact-pairs")
    if pairs.count() <= BROADCAST_ROWS:
        return hashed.join(F.broadcast(pairs), [size, prefix], "left"), hit, full
    early = free_name(docs, "__early")  # the join moves the hashes, and AQE splits hot ones
    return hashed.withColumn(early, F.when(F.col(same), full)).join(pairs, [size, prefix], "left"), hit, F.col(early)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept and, if ``digest``, text_sha256."""
    marked, hit, full = _marked(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    single = marked.where(F.col(hit).isNull()).select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2(text_of("__text"), 256).alias("text_sha256"))
    same = marked.where(F.col(hit).isNotNull()).select(full.alias("__full"), "__id")
    same = materialize(same.groupBy("__full", "__id").agg(F.count("*").alias("__n")), "exact-copies")
    groups = materialize(same.groupBy("__full").agg(F.max("__id").alias("keep_id"), F.sum("__n").alias("group_size")), "exact-groups")
    several = same.join(groups, "__full").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    several = several.select("__id", "keep_id", "group_size", (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)).alias("kept"), F.col("__full").alias("text_sha256"))
    out = single.unionByName(several).withColumnRenamed("__id", id_col)
    return out if digest else out.drop("text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts; the largest ``id_col`` stays.

    Rows that no other row can equal pass through without a shuffle. Copies are reduced to one row per group before and
    after their shuffle, so a hot group never meets in one task.
    """
    columns = docs.columns
    marked, hit, full = _marked(docs, text_col)
    order = F.struct(F.col(id_col), *[F.col(c) for c, t in docs.dtypes if c not in (id_col, text_col) and "map<" not in t and "variant" not in t])
    one = marked.where(F.col(hit).isNotNull()).select(full.alias("full"), order.alias("order"), F.struct(*[F.col(c) for c in columns]).alias("row")).groupBy("full").agg(F.max_by("row", "order").alias("row"))
    return marked.where(F.col(hit).isNull()).select(columns).unionByName(one.select("row.*"))
