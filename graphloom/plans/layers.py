"""State that a loop writes as deltas: one small table a round, merged with its neighbours at doubling sizes.

A round writes what it changed and nothing else. A table is merged with the one before it when that is less than twice as
large, so there are about as many tables as the logarithm of the rows, a plan over them does not grow with the rounds, and
each row is rewritten as often at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixpoint import remove, scratch


class Layers:
    """Tables of rows by ``id``. ``newest`` are the aggregates that make one row of an id's; none: ids never repeat."""

    def __init__(self, label: str, newest: Callable[[], list[Column]] | None = None):
        self.label, self.newest = label, newest
        self.tables: list[tuple[DataFrame, int]] = []

    def add(self, table: DataFrame, rows: int, whole: bool = False) -> None:
        """Put ``table`` over the others; ``whole``: it has every id, so the others, which must be of ``scratch``, are deleted."""
        if whole:
            for old, _ in self.tables:
                remove(old)
            self.tables.clear()
        self.tables.append((table, rows))
        while len(self.tables) > 1 and self.tables[-2][1] < 2 * self.tables[-1][1]:
            (old, _), (new, _) = self.tables[-2:]
            merged, found = scratch(self._settled(old.unionByName(new)), self.label, n=F.count(F.lit(1)))
            if len(self.tables) > 2:  # the newest table may still be some frontier, and the oldest what the caller gave
                remove(old)
            self.tables[-2:] = [(merged, found["n"])]

    def _settled(self, rows: DataFrame) -> DataFrame:
        return rows if self.newest is None else rows.groupBy("id").agg(*self.newest()).select(rows.columns)

    def rows(self) -> DataFrame:
        """All rows of all tables."""
        return reduce(DataFrame.unionByName, (table for table, _ in self.tables))

    def settled(self, only: DataFrame | None = None) -> DataFrame:
        """One row an id; ``only`` of those in the column id of a DataFrame, which may be small."""
        rows = self.rows()
        if only is not None:
            rows = rows.join(only.select("id"), "id", "left_semi")
        return rows if len(self.tables) == 1 else self._settled(rows)  # no table has an id twice
