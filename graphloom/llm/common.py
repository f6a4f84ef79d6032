"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import remove as forget  # noqa: F401
from ..plans.fixpoint import scratch

#: The ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 500_000


#: Bytes of text that a Python worker has in pieces at a time; a longer text comes alone.
SLICE_BYTES = 4 << 20


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The copy outlives any executor, and later reads of it are deterministic.
    """
    return scratch(df, label)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts in ``column`` have ``most`` bytes together, or are one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, done + most, "right")), at + 1)
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def give_back() -> None:
    """Return what a Python worker has freed to the system at the end of a task, for its executor's other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII texts take the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; none: an empty array."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once and only where the result is."""
    return F.transform(F.array(value), body)[0]
