"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits share at least five of
them, the guaranteed minimum. Lists of single (position, byte) postings hold 1/256 of all fingerprints, so joining them
would be quadratic; instead the index is keyed by fixed sets of four positions. The fourteen sets are the planes
``{x : a.x = b}`` of the eight positions seen as 3-bit vectors: any three positions lie in such a plane, so every pair that
links shares all four bytes of the plane's complement, and is found. Within a list, a pair's shared positional bytes are
tallied, pairs below five are dropped, and the rest are verified by their Hamming distance.

Lists longer than ``LIST_LIMIT`` are not cut: their members are dealt on by the bits that are still open. Those bits are
split into four blocks; at most three can hold the differing bits, so each pair agrees on one block and meets again in the
longer key's list. When few enough bits are open, a list has no more members than those bits have values. Lists yield
spanning forests, never all pairs, and equal fingerprints are one member.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer than three words are one shingle;
repeated rows get a row each; a null doc_id never names a component unless all its documents have none; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, byte_slices, free_name, materialize, text_of
from .components import connected_components

SHINGLE, SEED, MAX_DISTANCE, LEAST_BYTES = 3, 42, 3, 5
#: Members of a list that are compared directly; longer lists are dealt on.
LIST_LIMIT = 1024
#: Shingles whose bits are summed at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash of a text, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, total = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        hashes = np.array(list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(part, part[1:], part[2:])), repeat(SEED))), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __row, __fp): one row per input row; a hash of the text and the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2):
            found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64), pa.int64())], ["__id", "__row", "__fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_of(text_col)).alias("__row"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, "__id long, __row long, __fp long")


def _planes() -> list[int]:
    """Byte masks of the fourteen complements of planes."""
    masks = []
    for a in range(1, 8):
        for b in (0, 1):
            inside = [x for x in range(8) if bin(a & x).count("1") % 2 == b]
            masks.append(sum(0xFF << (8 * x) for x in inside))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(mask: int) -> list[int]:
    """The bits that are open under a mask, in exactly four blocks, each added to the mask."""
    still = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in still[k::4]) for k in range(4)]


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as stars, of the pairs that share five bytes and differ in at most three bits."""
    n, edges = len(values), []
    todo = np.arange(n)
    bytes_of = values.view(np.uint8).reshape(-1, 8)
    while len(todo):
        root, todo = todo[0], todo[1:]
        front = [root]
        while front and len(todo):
            at = front.pop()
            shared = (bytes_of[todo] == bytes_of[at]).sum(axis=1) >= LEAST_BYTES
            near = shared & (np.bitwise_count(values[todo] ^ values[at]) <= MAX_DISTANCE)
            for x in todo[near]:
                edges.append((int(root), int(x)))
                front.append(x)
            todo = todo[~near]
    return edges


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        values = np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64)
        ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
        a, b, start = [], [], 0
        for end in ends:
            own = np.sort(values[start:end].view(np.int64)).view(np.uint64)
            start = end
            for x, y in _forest(own):
                a.append(own[x])
                b.append(own[y])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64), pa.int64()), pa.array(np.array(b, np.uint64).view(np.int64), pa.int64())], ["src", "dst"])


def fingerprint_links(unique: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(src, dst): enough links between distinct fingerprints ``__fp`` to join all that any chain of links joins."""
    if list_limit < 16:
        raise ValueError("list_limit must be 16 at least: lists that are dealt on need four open bits")
    masks = _planes()
    found = None
    level = unique.select("__fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.col("__fp").bitwiseAND(_signed(m)).alias("k")) for m in masks])).alias("__e"))
    level = level.select("__fp", F.col("__e.m").alias("__m"), F.col("__e.k").alias("__k"))
    while True:
        level = materialize(level, "simhash-index")
        # Members of a list are distinct fingerprints, so counting them takes no distinct.
        lengths = level.groupBy("__m", "__k").agg(F.count("*").alias("__n")).where("__n > 1")
        lengths = materialize(lengths, "simhash-lengths")
        short = level.join(lengths.where(F.col("__n") <= list_limit).drop("__n"), ["__m", "__k"])
        short = materialize(short, "simhash-lists")
        links = short.groupBy("__m", "__k").agg(F.collect_list("__fp").alias("__l")).select("__l").mapInArrow(_link_lists, "src long, dst long")
        found = links if found is None else found.unionByName(links)
        long = lengths.where(F.col("__n") > list_limit)
        over = [m % (1 << 64) for (m,) in long.select("__m").distinct().collect()]  # of the fixed masks: a few hundred at most
        if not over:
            return found
        further = F.create_map(*[x for m in over for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)) for b in _blocks(m)]))])
        dealt = level.join(long.drop("__n"), ["__m", "__k"]).select("__fp", F.explode(further[F.col("__m")]).alias("__m"))
        level = dealt.withColumn("__k", F.col("__fp").bitwiseAND(F.col("__m")))


def _labelled(prints: DataFrame, list_limit: int) -> DataFrame:
    """(__fp, __first, __label): distinct fingerprints with their smallest id and their component's label."""
    unique = materialize(prints.groupBy("__fp").agg(F.min("__id").alias("__first")), "simhash-unique")
    parts = connected_components(fingerprint_links(unique, list_limit)).select(F.col("node").alias("__fp"), "label")
    return materialize(unique.join(parts, "__fp", "left").select("__fp", "__first", F.coalesce("label", "__fp").alias("__label")), "simhash-labels")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits) and component_id."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    labelled = _labelled(prints, list_limit)
    names = materialize(labelled.groupBy("__label").agg(F.min("__first").alias("component_id")), "simhash-names")
    classes = materialize(labelled.join(names, "__label").select("__fp", "component_id"), "simhash-classes")
    return prints.join(classes, "__fp").select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of one id the text that hashes lowest.

    What goes is taken out by an anti-join, so that texts stay where they are if the rows that go are few. Rows that repeat
    both id and text are reduced to one apart from the others.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-prints")
    labelled = _labelled(prints, list_limit).select("__fp", "__label")
    keys = [free_name(docs, name) for name in ("none", "key", "row")]
    own = prints.select("__fp", F.col("__id").isNull().alias("none"), F.coalesce("__id", F.lit(0)).alias("id"), F.col("__row").alias("row"))
    counted = own.groupBy("__fp", "none", "id", "row").agg(F.count("*").alias("n")).join(labelled, "__fp")
    best = counted.groupBy("__label").agg(F.min(F.struct("none", "id", "row")).alias("best"))
    judged = counted.join(best, "__label").select("none", "id", "row", (F.struct("none", "id", "row") == F.col("best")).alias("stays"), "n")
    judged = materialize(judged.where("not stays or n > 1"), "simhash-judged")
    n, repeated = judged.agg(F.count("*"), F.count_if("stays")).first()
    out = judged.select("none", "id", "row").toDF(*keys)
    few = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    rows = docs.withColumns(dict(zip(keys, (F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(text_of(text_col))))))
    left = rows.join(few(out), keys, "left_anti")
    if repeated:
        again = rows.join(few(judged.where("stays").select("none", "id", "row").toDF(*keys)), keys, "left_semi")
        left = left.unionByName(again.dropDuplicates(keys))
    return left.select(docs.columns)
