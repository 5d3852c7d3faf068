"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its
    smallest node.

    ``edges`` has two BIGINT columns ``a`` and ``b``; direction, repeated
    edges and loops don't matter, and rows with a null are ignored.  Each round
    is the large star (bigger neighbours hang on the smallest) and the small
    star (smaller ones do), both with a partial aggregation of the minimum, and
    ends in a written table.  No node's neighbours are ever collected; a hub's
    rows are one side of a plain join, which adaptive execution splits.  The
    number of rounds grows with the logarithm of the number of nodes.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.keep(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{name}-0")
    seen, turn = _mark(now), 0
    while True:
        turn += 1
        # Large star: v > u joins the least of u and its neighbours.
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.join(least, F.col("a") == F.col("u")).where(b > a)
                 .select(b.alias("a"), F.col("m").alias("b")).distinct())
        large = scratch.keep(large, f"{name}-{turn}-large")
        # Small star: u (a > b always holds here) and its smaller neighbours join the least.
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        small = (small.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        old, now = now, scratch.keep(small, f"{name}-{turn}")
        scratch.free(large, f"{name}-{turn}-large")
        scratch.free(old, f"{name}-{turn - 1}")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(b.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(a.alias("node"), b.alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Equal for two rounds only if no edge changed (up to a 128-bit hash)."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"),
                    F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("g")).first()
    return row["n"], row["h"], row["g"]
