"""The document pipeline: what is toxic goes, one of each group of near duplicates stays, what holds a benchmark item
goes, personal data is masked, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; all but
the last return the columns of docs. Null and empty texts pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, near_dedup, packing, pii, toxicity
from corpusloom.llm.common import mark, new_folder, release, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; trained on the labelled ones among docs."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data masked."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", near_deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: No SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again by the next. What a stage
    needed besides, and the result before, goes as soon as its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since, path = mark(), new_folder(spark, f"pipeline-{name}")
        docs = written(stage(spark, docs, sf_dir), path)
        release(spark, since if name == STAGES[0][0] else since - 1, [path])
    return STAGES[-1][1](spark, docs, sf_dir)
