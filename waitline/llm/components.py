"""Connected components of a large edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.session import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges ``a``, ``b`` (long).

    In turn, larger neighbours of a node are tied to its smallest neighbour, then smaller ones; both are joins with
    a minimum for each node, so that no neighbourhood is gathered.  Each round is written, the number of rounds grows
    with the logarithm of the longest path.  Ends when a round changes nothing: then every node points at its root.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        tied = large.join(small, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(tied.union(small.select("u", "m")).distinct(), "stars")
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
