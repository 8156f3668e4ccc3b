"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace


def components(edges: DataFrame, work: Workspace, name: str = "edges") -> DataFrame:
    """(id, component): the smallest id that each id of `edges` (a, b) reaches, but for ids that are it themselves.

    Alternates large and small stars: every step links a vertex's neighbours to the smallest of them. The number of rounds
    grows with the logarithm of the longest path. Minima are taken before the shuffle; nothing is gathered in one place.
    """
    now = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    mark = _mark(now)
    for k in range(1, 100):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are a table of their own, so that their join is a plain one, of which Spark splits a skewed side
        least = work.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}{k}-a")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = work.keep(small.where("u <> v").distinct(), f"{name}{k}")
        work.drop(f"{name}{k - 1}", f"{name}{k}-a")
        before, mark = mark, _mark(now)
        if before == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError("no end")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
