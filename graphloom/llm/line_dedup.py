"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

Documents arrive in batches of ascending doc_id. The runs hold each line key seen so far with the smallest doc_id that
holds it; a run is a table bucketed by key and sorted inside its buckets. A batch's keys are dealt to the same buckets and
merge-joined with the runs, which stay where they are: what no run has is the batch's own run of level 0, and ``FANOUT``
runs of a level are merged into one of the next, bucket by bucket. A line goes if a run or its own batch has its key under a
smaller doc_id.

Line keys travel as two 64-bit hashes and a position. A key that very many documents share is combined before its shuffle,
and the join that marks its lines is a plain equi-join that AQE can split. The places of lines that go are sent to the scan
of the texts if they were counted and are few; else both are shuffled by document. The runs of a call are deleted at its
end, if it was not given any to go on from.

Defined cases: a null text is one empty line; a null doc_id ranks after all others and never owns a key that a numbered
document holds; rows that share a doc_id count as one document; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch_path
from .common import SPACES, ascii_lower, forget, materialize, text_of

#: Keys shorter than this many code points are never dropped.
LEAST_CHARS = 10
#: Batches that one call deals its documents into, and runs of a level before they are compacted.
BATCHES, FANOUT = 4, 2
#: Keys of a bucket that are aimed at, as the first batch has them, and the most buckets.
BUCKET_KEYS, MOST_BUCKETS = 1 << 20, 50_000
#: Documents and places of lines that are sent to all workers at most.
SENT_DOCS, SENT_PLACES = 200_000, 2_000_000

KEY = ["__h1", "__h2"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__row"))


def _keyed_lines(rows: DataFrame) -> DataFrame:
    """Each line with a long enough key: its document, place and key hashes."""
    lines = F.transform(F.split(ascii_lower(F.col("__text")), "\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    hashed = F.transform(lines, lambda k: F.when(F.length(k) >= LEAST_CHARS, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))))
    out = rows.select("__id", "__row", F.posexplode(hashed).alias("__pos", "__k")).where("__k is not null")
    return out.select("__id", "__row", "__pos", F.col("__k.a").alias("__h1"), F.col("__k.b").alias("__h2"))


class SortedRuns:
    """Levelled runs of (key, smallest doc_id): bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: dict[int, list[str]] = {}

    def tables(self) -> list[str]:
        return [run for level in self.levels.values() for run in level]

    def keys(self, run: str) -> DataFrame:
        """(key, __own) of a run; its table may tell more, of keys that it does not own."""
        return self.spark.table(run).where("__fresh").select(*KEY, "__own")

    def all(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, map(self.keys, self.tables())) if self.tables() else None

    def write(self, rows: DataFrame) -> str:
        path = scratch_path(self.spark, "line-run")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name

    def drop(self, run: str) -> None:
        table = self.spark.table(run)
        self.spark.sql(f"DROP TABLE {run}")
        forget(table)

    def add(self, run: str) -> None:
        """Add a run of keys that no run has, and compact levels that are full."""
        level = 0
        while True:
            runs = self.levels.setdefault(level, [])
            runs.append(run)
            if len(runs) < self.fanout:
                return
            whole = reduce(DataFrame.unionByName, map(self.keys, runs))
            run = self.write(whole.withColumn("__fresh", F.lit(True)))
            for old in runs:
                self.drop(old)
            self.levels[level] = []
            level += 1


def _bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    cuts = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), cuts, 10_000)).first()[0]
    return sorted(set(found or []))


def _parts(rows: DataFrame, cuts: list[int]) -> list[DataFrame]:
    ends = [None, *cuts, None]
    out = []
    for low, high in zip(ends, ends[1:]):
        inside: Column = F.lit(True)
        if low is not None:
            inside = inside & (F.col("__id") > low)
        if high is not None:
            inside = inside & (F.col("__id") <= high)
        else:
            inside = inside | F.col("__id").isNull()
        out.append(rows.where(inside))
    return out


def _dropped(batch: DataFrame, runs: SortedRuns, batches: int) -> DataFrame:
    """Places of the batch's lines that go; adds the batch's new keys to ``runs``."""
    lines = _keyed_lines(batch)
    first = lines.groupBy(*KEY).agg(F.min("__id").alias("__own"), F.max(F.coalesce("__id", F.lit(2**63 - 1))).alias("__last"))
    first = materialize(first, "line-keys")
    if not runs.buckets:
        runs.buckets = min(max(8, first.count() * batches // BUCKET_KEYS), MOST_BUCKETS)
    seen = first.repartition(runs.buckets, *KEY)
    old = []
    for i, run in enumerate(runs.tables()):
        old.append(f"__old{i}")
        seen = seen.hint("merge").join(runs.keys(run).withColumnRenamed("__own", old[-1]), KEY, "left")
    fresh = F.col("__own").isNotNull()
    for name in old:
        fresh = fresh & F.col(name).isNull()
    run = runs.write(seen.select(*KEY, F.coalesce(*old, "__own").alias("__own"), "__last", fresh.alias("__fresh")))
    forget(first)
    shared = runs.spark.table(run).where("__own is not null and __last > __own").select(*KEY, "__own")
    hit = lines.join(shared, KEY).where("__id is null or __id > __own")
    gone = materialize(hit.groupBy("__id", "__row").agg(F.sort_array(F.collect_set("__pos")).alias("__gone")), "line-gone")
    runs.add(run)
    return gone


def _kept(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the ascending places ``gone``, cut out as slices between them."""
    n = F.size(gone)
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: _slice(lines, F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1), F.when(i == n, F.size(lines)).otherwise(F.get(gone, i))),
    )
    return F.flatten(pieces)


def _slice(lines: Column, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 1, end - start)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, runs: SortedRuns | None = None) -> DataFrame:
    """One row per input row: ``id_col``, kept_text, n_lines, n_dropped.

    Pass ``runs`` to go on from earlier calls, whose documents must have smaller ids.
    """
    rows = _rows(docs, id_col, text_col)
    known = runs or SortedRuns(docs.sparkSession)
    found = [_dropped(batch, known, batches) for batch in _parts(rows, _bounds(docs, id_col, batches))]
    if runs is None:
        for run in known.tables():
            known.drop(run)
    gone = reduce(DataFrame.unionByName, found).toDF("__g", "__r", "__gone")
    n, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()
    if n <= SENT_DOCS and places <= SENT_PLACES:
        gone = F.broadcast(gone)
    both = rows.join(gone, F.col("__id").eqNullSafe(F.col("__g")) & (F.col("__row") == F.col("__r")), "left")
    cut = both.select("__id", "__text", "__gone", F.split("__text", "\n").alias("__lines"))
    return cut.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(_kept(F.col("__lines"), F.col("__gone")), "\n")).alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
    )
