"""A bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those first by a hash of `key`, the same on each run.

    A cut of the hash that leaves a few more comes first, so that the sort behind it is of bounded size.
    """
    n = rows.count()
    share = min(1.0, (1.2 * most + 200) / max(1, n))
    part = rows.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 40)) < int(share * (1 << 40)) + 1) if share < 1 else rows
    return part.orderBy(F.xxhash64(key, F.lit(5)), key).limit(most)


def sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label): at most `rows` labelled ids, the same on each run.

    A document labelled twice has its lowest label; a null id or label is left out.
    """
    each = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    return first_by_hash(each, "doc_id", rows)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
