"""The loop that every iterative operator runs in.

A round is one lazily built plan over the state of the round before. Its result is written to the folder in
``spark.checkpoint.dir`` and read back, which cuts the lineage, survives lost executors and materializes the round in one
job; the counts that end the loop and the per-round evidence are observed in that same job. Nothing else reaches the driver.
"""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Rounds after which a loop stops; it logs a warning if it has not converged.
MAX_ROUNDS = 1000
LOG = logging.getLogger("graphloom")


def stopped(label: str, rounds: int) -> None:
    LOG.warning("%s: stopped after %d rounds without converging", label, rounds)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/graphloom"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is left there is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def scratch(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written to the shared folder and read back, and the metrics of that write."""
    spark, seen = df.sparkSession, None
    path = scratch_path(spark, label)
    if metrics:
        seen = Observation()
        df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(seen.get) if seen else {}


def remove(df: DataFrame) -> None:
    """Delete a table that ``scratch`` wrote and that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graphloom-" in name:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Fixpoint:
    """``step(state)`` until ``go_on`` of a round's metrics is false.

    ``metrics`` are aggregates over the state that ``step`` returns. ``history`` has one row of them per round.
    """

    step: Callable[[DataFrame], DataFrame]
    metrics: Mapping[str, Column]
    go_on: Callable[[dict], bool]
    max_rounds: int = MAX_ROUNDS
    label: str = "round"
    history: list[dict] = field(default_factory=list)

    def run(self, state: DataFrame) -> DataFrame:
        start = state
        for round_no in range(1, self.max_rounds + 1):
            after, found = scratch(self.step(state), self.label, **self.metrics)
            self.history.append({"iter": round_no, **found})
            if state is not start:
                remove(state)
            state = after
            if not self.go_on(found):
                return state
        stopped(self.label, self.max_rounds)
        return state
