"""Training-data pipeline over ``documents``: each stage reads what the stage before it kept.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go, personal
data is replaced in the texts, and what is left is packed into sequences. All stages but the last return
the columns they were given. Every stage's behaviour on nulls, empty tables, repeated rows and further
columns is that of its operator.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringwave.llm import decontaminate, packing, pii, simhash, toxicity
from ringwave.llm.registry import table
from ringwave.session import cut_lineage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage by the contamination rule."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts sanitised and ``n_chars`` counted anew."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]
#: The learned, hashed and packed stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
