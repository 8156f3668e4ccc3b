"""Stages of a corpus pipeline: each takes documents with any columns and gives those that stay, with the same columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import importance, labelled
from .columns import U
from .exact import find_copies, normalised
from .jaccard import Likeness, similar_documents
from .mixing import mix_sources, word_counts
from .packing import default_tokenizer, pack
from .runtime import Workspace, filtered
from .stats import Bloom

_ID, _SHA, _COPIES, _SOURCE, _SIZE, _NTH = (f"cantiga {x}" for x in ("doc_id", "sha", "copies", "source", "size", "nth"))


def _halves(docs: DataFrame, ids: DataFrame, nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id surely is not among `ids`, and all others, with nulls also those without one. Only the others need be shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(Bloom.of(ids, ids.count()))

    def among(b) -> np.ndarray:
        column = b.column("doc_id").cast("int64")
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return sent.value.holds(column.fill_null(0).to_numpy().view(U)) & valid | (~valid & nulls)

    return filtered(docs, lambda b: ~among(b)), filtered(docs, among)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects. Null and empty texts weigh nothing, so their Gumbel number decides."""
    return importance.kept_rows(docs, importance.fit(docs, labelled.labels(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of smallest doc_id stays; of wholly equal rows one. Rows without doc_id stay."""
    work = Workspace(spark, "stage-exact")
    gone = work.keep(find_copies(docs).where("not kept and doc_id is not null").select("doc_id", "keep_id", F.unhex("text_sha256").alias("sha")), "gone")
    apart, near = _halves(docs, gone.select("doc_id"))
    gone = gone.where("keep_id is null or keep_id <> doc_id").select(F.col("doc_id").alias(_ID), F.col("sha").alias(_SHA)).distinct()
    near = near.withColumn(_ID, F.col("doc_id").cast("long")).withColumn(_SHA, F.unhex(F.sha2(normalised("text"), 256)))
    near = near.join(gone, [_ID, _SHA], "left_anti").dropDuplicates([_ID, _SHA])
    return apart.unionByName(near.select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, like: Likeness = Likeness(80, 100)) -> DataFrame:
    """Of each group of linked texts the document of smallest id stays. Rows that share an id go together; those without one stay."""
    work = Workspace(spark, "stage-near")
    gone = work.keep(similar_documents(docs, words, like).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    apart, near = _halves(docs, gone)
    near = near.withColumn(_ID, F.col("doc_id").cast("long")).join(gone.withColumnRenamed("doc_id", _ID), _ID, "left_anti")
    return apart.unionByName(near.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, rows without id or source and rows that share an id included.

    Rows of one id, source and number of words are alike to the mix: which of them it takes more often goes by a hash of the text.
    """
    work = Workspace(spark, "stage-mix")
    keys = {"doc_id": _ID, "source": _SOURCE, "size": _SIZE}
    mixed = work.keep(mix_sources(word_counts(docs)).select(*(F.col(a).alias(b) for a, b in keys.items()), F.col("copies").alias(_COPIES)), "mixed")
    several = work.keep(mixed.groupBy(_ID, _SOURCE).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    # rows that are taken as often as most of their source need not meet their number by key
    often = mixed.groupBy(_SOURCE, _COPIES).agg(F.count("*").alias("n")).groupBy(_SOURCE).agg(F.max(F.struct("n", _COPIES))[_COPIES].alias(_COPIES))
    usual = work.keep(often, "usual")
    other = mixed.join(usual.withColumnsRenamed({_SOURCE: "of", _COPIES: "usual"}), F.col(_SOURCE).eqNullSafe(F.col("of"))).where(F.col(_COPIES) != F.col("usual"))
    other = work.keep(other.select(_ID).unionAll(several.select(_ID)).where(F.col(_ID).isNotNull()).distinct(), "other")
    plain, rows = (half.withColumns({_ID: F.col("doc_id").cast("long"), _SOURCE: F.col("source")}) for half in _halves(docs, other.withColumnRenamed(_ID, "doc_id"), nulls=True))

    def same(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        out = a.join(b, reduce(lambda x, y: x & y, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in on)), how)
        return out if how != "inner" else out.select("a.*", f"b.`{_COPIES}`")

    if several.isEmpty():
        out = same(rows, mixed.where(F.col(_COPIES) > 0), [_ID, _SOURCE], "inner")
    else:
        out = same(same(rows, several, [_ID, _SOURCE], "left_anti"), same(mixed.where(F.col(_COPIES) > 0), several, [_ID, _SOURCE], "left_anti"), [_ID, _SOURCE], "inner")
        alike = Window.partitionBy(_ID, _SOURCE, _SIZE)
        few = same(rows, several, [_ID, _SOURCE], "left_semi").withColumn(_SIZE, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
        few = few.withColumn(_NTH, F.row_number().over(alike.orderBy(F.xxhash64("text"))))
        taken = same(mixed, several, [_ID, _SOURCE], "left_semi").withColumn(_NTH, F.row_number().over(alike.orderBy(F.desc(_COPIES))))
        out = out.unionByName(same(few, taken, [_ID, _SOURCE, _SIZE, _NTH], "inner").drop(_SIZE, _NTH))
    out = out.unionByName(same(plain, usual.where(F.col(_COPIES) > 0), [_SOURCE], "inner"))
    return out.where(F.col(_COPIES) > 0).withColumn(_COPIES, F.explode(F.sequence(F.lit(1), F.col(_COPIES)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in which sequence."""
    return pack(docs, default_tokenizer())
