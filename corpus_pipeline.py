"""The corpus pipeline: toxic documents go, of equal and near-equal ones one stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and is given what its predecessor kept; all
but the last return the columns of documents. The shingle stage takes five words
and a similarity of 0.8, as near-duplicate stages do. Nulls, empty and repeated
rows follow the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, packing, secret_scans, toxicity
from tidemark.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, learnt from the labels of this stage's documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels, F.lit(True)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents the one with the smallest doc_id."""
    return jaccard_join.without_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secret_scans.redacted(docs, secret_scans.fit(secret_scans.labelled_findings(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a batch of its length bucket."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram jaccard join", drop_near_copies), ("secret scans", mask_secrets), ("packing", pack)]

#: The stages learn and draw pivots: SQL cannot express them, tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
