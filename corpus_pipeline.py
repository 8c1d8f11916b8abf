"""A corpus pipeline: five stages, each an operator, each over all rows that the stage before it kept.

All stages but the last return the columns of their input, whatever their names. Null texts count as empty; null ids
are ids like others, but they have no label and are not named in a group of near copies. Repeated rows are judged
alike, exact dedup keeps one of them. Texts of any length are read whole. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrack.llm import decontaminate, exact_dedup, packing, queries, shingle_join, toxicity
from kinetrack.llm.tables import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model learns as in the operator's query."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that Jaccard links connect the row with the smallest doc_id stays."""
    return shingle_join.keep_one_of_each(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("packing", pack),
]

#: Learned scores and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents`` of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
