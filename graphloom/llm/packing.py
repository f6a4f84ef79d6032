"""Best-fit packing by exact-complement hashing.

Documents are tokenized, given an end token, and cut into pieces of at most ``capacity`` tokens; only longer documents are
cut. How pieces share sequences depends on their lengths alone, so the planner works on the histogram of lengths, which has
at most ``capacity`` rows whatever the corpus. It opens a sequence with the largest length left and looks the gap up among
the single lengths, the pair sums and the triple sums that are still available; an exact complement closes the sequence.
Where there is none, the largest length that fits goes in and the gap is looked up again. A combination is consumed as
often as the counts allow at once, so the plan has few rows too.

The plan is applied without sorting or grouping documents: pieces are numbered within (task, length) while they are cut,
the tasks' counts are prefix-summed per length, and the resulting rank names the sequence and the place in it.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; ties in length are dealt in the
order of the stored pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, byte_slices, give_back, materialize
from .word_tokens import tokenizer_for

CAPACITY, END_TOKEN = 4096, 1
#: Bits of a piece's rank among those of its length.
RANK_BITS = 48
#: Documents whose pieces are handed on at a time.
AT_ONCE = 512


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ids) with ``__task`` and ``__nth`` within (task, length)."""
    own = docs.schema[id_col].dataType.simpleString()
    schema = f"__id {own}, piece int, start long, length long, ids_crc32 long, ids array<int>, __task int, __nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, task = tokenizer_for(tokenizer_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in byte_slices(batches, 1):
            found, begins = tokenizer.encode(batch.column(1))
            for low in range(0, batch.num_rows, AT_ONCE):
                rows = []
                for doc_id, a, b in zip(batch.column(0).slice(low, AT_ONCE).to_pylist(), begins[low : low + AT_ONCE], begins[low + 1 :]):
                    ids = np.append(found[a:b], np.uint32(END_TOKEN)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(part), zlib.crc32(part.data), part.astype(np.int32) if keep_ids else None, task, seen[len(part)]))
                        seen[len(part)] += 1
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["__id", "piece", "start", "length", "ids_crc32", "ids", "__task", "__nth"])
        tokenizer.forget()
        give_back()

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, schema)


class _Stock:
    """Lengths that are left, with lookups of exact single, pair and triple sums."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] = n

    def largest(self, most: int) -> int:
        found = np.flatnonzero(self.counts[: most + 1])
        return int(found[-1]) if len(found) else 0

    def pair(self, gap: int) -> tuple[int, ...]:
        """The most uneven two lengths that sum to ``gap``."""
        if gap < 2:
            return ()
        there = self.counts[1:gap] > 0
        both = np.flatnonzero(there & there[::-1])[::-1] + 1
        for a in both[both * 2 >= gap]:
            if a * 2 != gap or self.counts[a] > 1:
                return int(a), int(gap - a)
        return ()

    def complement(self, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that sum to ``gap`` exactly."""
        if self.counts[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        for a in np.flatnonzero(self.counts[: gap - 1])[::-1]:
            a = int(a)
            if a * 3 < gap:
                break
            self.counts[a] -= 1
            two = self.pair(gap - a)
            self.counts[a] += 1
            if two:
                return (a, *two)
        return ()


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how many, lengths): sequences that use every length as often as ``counts`` says."""
    stock, plan = _Stock(counts, capacity), []
    while first := stock.largest(capacity):
        taken, gap = [first], capacity - first
        stock.counts[first] -= 1
        while gap:
            more = stock.complement(gap)
            if not more:
                best = stock.largest(gap)
                if not best:
                    break
                more = (best,)
            for length in more:
                stock.counts[length] -= 1
                taken.append(length)
            gap -= sum(more)
        again = min((int(stock.counts[length]) // n for length, n in Counter(taken).items()), default=0)
        for length, n in Counter(taken).items():
            stock.counts[length] -= n * again
        plan.append((1 + again, tuple(taken)))
    return plan


@dataclass(frozen=True)
class _Slots:
    """The plan by length and rank, as arrays: rows of (first rank, pieces a sequence, first sequence, where its offsets begin)."""

    keys: np.ndarray  # length and first rank in one number, rising
    each: np.ndarray
    sequence: np.ndarray
    begins: np.ndarray
    offsets: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of the pieces of the given lengths and ranks."""
        key = length.astype(np.int64) << RANK_BITS | rank
        row = np.searchsorted(self.keys, key, "right") - 1
        nth, place = np.divmod(key - self.keys[row], self.each[row])
        return self.sequence[row] + nth, self.offsets[self.begins[row] + place]


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> _Slots:
    rank: Counter = Counter()
    rows, offsets, sequence = [], [], 0
    for times, lengths in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for length in lengths:
            places.setdefault(length, []).append(at)
            at += length
        for length, found in places.items():
            rows.append((length << RANK_BITS | rank[length], len(found), sequence, len(offsets)))
            rank[length] += times * len(found)
            offsets += found
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return _Slots(*table.T.copy(), np.array(offsets, np.int64))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces``, as stored, with sequence_id and offset."""
    spark = pieces.sparkSession
    tasks = materialize(pieces.groupBy("__task", "length").agg(F.count("*").alias("__n")), "pack-tasks")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # one row a length: at most ``capacity``
    slots = spark.sparkContext.broadcast(_slots(plan_sequences(counts, capacity)))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialize(tasks.select("__task", "length", F.coalesce(before, F.lit(0)).alias("__base")), "pack-bases")
    if bases.count() <= BROADCAST_ROWS:  # a task has ``capacity`` lengths at most; more tasks' rows are joined by a shuffle
        bases = F.broadcast(bases)
    ranked = pieces.join(bases, ["__task", "length"]).withColumn("__rank", F.col("__nth") + F.col("__base")).drop("__task", "__nth", "__base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(name)).to_numpy() for name in ("length", "__rank"))
            sequences, offsets = slots.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequences), pa.array(offsets)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "__rank")
    return ranked.mapInArrow(run, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset and, if ``keep_ids``, ids."""
    pieces = materialize(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, keep_ids), "pack-pieces")
    placed = place_pieces(pieces, capacity).select(F.col("__id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    return placed if keep_ids else placed.drop("ids")
