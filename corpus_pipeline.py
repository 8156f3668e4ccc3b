"""A corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cantiga.llm import stages
from cantiga.llm.runtime import Workspace, documents

STAGES = [
    ("quality classifier", stages.quality),
    ("exact dedup", stages.exact),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("mixing", stages.mix),
    ("packing", stages.packed),
]

#: A trained classifier, a sampling method and a tokeniser are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), str(k))
    return docs
