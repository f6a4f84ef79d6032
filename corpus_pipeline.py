"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of ``documents``; the last returns the packed pieces, which name documents and places in
them but hold no token ids: ``pack_documents`` adds them on demand.

Defined cases, for every stage: a null text is empty, which the quality rules reject; a null doc_id is kept and ranks as the
stage's operator says; rows that repeat are copies; other columns may be null, have any names, and pass through; texts of any
length are read whole; an empty table gives an empty result. Ties are named at the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import materialize, table
from graphloom.llm.exact_dedup import drop_copies
from graphloom.llm.packing import pack_documents
from graphloom.llm.quality_rules import quality_filter
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.secret_scan import redact_secrets
from graphloom.llm.simhash_dedup import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; rows are judged one by one, so there are no ties."""
    return quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; of rows that share it too, the largest in the other columns."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; of texts that share it, the one that hashes
    lowest."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, of whatever layer, are masked; spans that touch or overlap become one mask."""
    return redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; pieces of a length are dealt in stored order."""
    return pack_documents(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: Fingerprints and tokenization are beyond SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
