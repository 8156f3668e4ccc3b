"""Exact duplicates: digests screened by static filters, then joined and checked byte by byte.

The older half of the documents, by id, is a snapshot that no longer changes: its digests have one binary fuse filter per
shard. The digests of the newer half are grouped among themselves first and screened by the filters; only what a filter lets
through joins the snapshot's exact buckets. Shards hold a bounded number of distinct digests, and their number follows the
input. A group of copies is one row before any shuffle, so its size does not matter. Only the texts of groups are shuffled, to be
compared byte by byte, and the rows of a large group are salted there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .columns import U, buffers, prefix_sums, span_hashes
from .runtime import Workspace, documents, filtered
from .stats import Bloom

#: Distinct digests of a shard, about.
SHARD = 1 << 19
#: Copies of one text that one task compares.
SALT_ROWS = 2000
#: Stands for a missing id where rows are looked up.
NO_ID = -(1 << 63)


def normalised(column: str) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """64-bit hashes of the digests."""
    at, data = buffers(digests)
    return span_hashes(prefix_sums(data), at[:-1], at[1:])


def _filter_of(shard: pa.Table) -> pa.Table:
    made = fuse.build(np.unique(_keys(shard.column("digest"))))
    return pa.table({"shard": shard.column("shard").slice(0, 1), "filter": pa.array([made], pa.binary())})


def _screen(new: pa.Table, old: pa.Table) -> pa.Table:
    """The new groups, and whether the snapshot's filter of this shard lets them through."""
    seen = fuse.holds(old.column("filter")[0].as_py(), _keys(new.column("digest"))) if len(old) else np.zeros(len(new), bool)
    return new.drop_columns(["shard"]).append_column("seen", pa.array(seen, pa.bool_()))


def find_copies(documents: DataFrame, bucket: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when `normalised` makes them the same bytes; of equal texts the smallest id stays. A null text is empty and
    equals an empty one. A repeated row is a copy of the first; which of two wholly equal rows counts as first is not defined.
    Rows without id come after all others. An empty table gives no rows. Columns but doc_id and text are not read, and their
    names do not matter. bucket: from SHA-256 to the digest in use; texts that share one without being equal are told apart
    byte by byte.
    """
    work = Workspace(documents.sparkSession, "exact")
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    rows = work.keep(whole.select("doc_id", "sha").withColumn("row", F.monotonically_increasing_id()), "rows").withColumn("digest", bucket(F.col("sha")))
    n, middle = rows.agg(F.count("*"), F.percentile_approx("doc_id", 0.5)).first()
    shards = -(-n // SHARD) or 1

    def grouped(part: DataFrame) -> DataFrame:
        keep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("keep")
        return part.groupBy("digest").agg(keep, F.count("*").alias("n")).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))

    is_old = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    old = work.keep(grouped(rows.where(is_old)), "snapshot")
    filters = work.keep(old.select("shard", "digest").groupBy("shard").applyInArrow(_filter_of, "shard int, filter binary"), "filters")
    new = grouped(rows.where(~is_old)).select("shard", "digest", "keep.*", "n")
    screening = new.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, "digest binary, none boolean, doc_id long, row long, n long, seen boolean")
    screened = work.keep(screening.select("digest", F.struct("none", "doc_id", "row").alias("keep"), "n", "seen"), "screened")

    through = screened.where("seen").select("digest", "keep", "n")
    known = old.join(through.select("digest", F.col("n").alias("more")), "digest", "left").select("digest", "keep", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    fresh = screened.where("not seen").select("digest", "keep", "n").unionByName(through.join(old.select("digest"), "digest", "left_anti"))
    several = known.unionByName(fresh).where("n > 1")
    out = work.keep(rows.join(several, "digest", "left"), "resolved")
    unlike = work.keep(_unlike(out.where("n is not null"), documents), "unlike")
    kept = F.col("keep.row").isNull() | (F.col("keep.row") == F.col("row"))
    out = out.select("doc_id", "sha", "row", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), kept.alias("kept"))
    if not unlike.isEmpty():
        out = _apart(out, unlike)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _texts_of(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, sha, text) of the documents whose id a filter of `ids` lets through: the others' texts are never shuffled."""
    sent = documents.sparkSession.sparkContext.broadcast(Bloom.of(ids, ids.count()))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    few = filtered(rows, lambda b: sent.value.holds(b.column("id").to_numpy().view(U)))
    return few.select("id", normalised("text").alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))


def _unlike(members: DataFrame, documents: DataFrame) -> DataFrame:
    """The texts in a bucket whose bytes differ from those of the bucket's kept row: (digest, id, sha, text)."""
    id_of = F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    each = members.select(id_of, "sha", "digest", "n", F.coalesce("keep.doc_id", F.lit(NO_ID)).alias("keep_id")).dropDuplicates(["id", "sha"])
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    copies = _texts_of(each.select("id"), documents).join(each, ["id", "sha"]).withColumn("salt", F.pmod(F.xxhash64("id", "sha"), salts).cast("int"))
    first = each.where("id = keep_id")
    kept = _texts_of(first.select("id"), documents).join(first, ["id", "sha"]).groupBy("digest", "n").agg(F.min("text").alias("kept_text"))
    kept = kept.select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "kept_text")
    return copies.join(kept, ["digest", "salt"]).where("text <> kept_text").select("digest", "id", "sha", "text")


def _apart(out: DataFrame, unlike: DataFrame) -> DataFrame:
    """Gives rows whose bytes differ from their bucket's kept row groups of their own."""
    own = out.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).join(unlike.dropDuplicates(["id", "sha"]), ["id", "sha", "digest"])
    first = own.groupBy("digest", "text").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("size"))
    each = own.join(first, ["digest", "text"]).select("row", "first", "size")
    fewer = own.groupBy("digest").agg(F.count("*").alias("gone"))
    out = out.join(each, "row", "left").join(fewer, "digest", "left")
    moved = F.col("first").isNotNull()
    return out.select(
        "doc_id", F.when(moved, F.nullif("first.id", F.lit(NO_ID))).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"), F.when(moved, F.col("first.row") == F.col("row")).otherwise(F.col("kept")).alias("kept"), "sha",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(documents(spark, sf_dir))


OP5_SQL = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
  best AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM norm JOIN best USING (t)
"""
