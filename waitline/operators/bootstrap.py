"""Group bootstraps with hash-drawn indices: the same draws for any partitioning.

Draw d puts into slot s the group numbered ``hash(seed, d, s) mod n``; groups are numbered in md5
order of their name.  Work is draws x groups, never draws x rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.functions.columns import seeded_int
from waitline.functions.ordered import hash_numbers
from waitline.session import written


def draw_weights(
    groups: DataFrame, keys: Sequence[str], draws: int, seed: int, group: str = "project"
) -> DataFrame:
    """(keys, draw, group, weight, ...): how often each group occurs in each draw; absent means zero.

    Further columns of ``groups`` travel along.  Groups must be distinct per keys.
    """
    # A constant key lets the ungrouped case use the same equi-joins.
    ks = list(keys) or ["_all"]
    numbered = hash_numbers(groups if keys else groups.withColumn("_all", F.lit(0)), group, ks, total="_groups")
    # A few rows become draws x groups rows, so they are spread over the cluster first, by block of draws.
    width = groups.sparkSession.sparkContext.defaultParallelism
    block = -(-draws // width)
    blocks = numbered.select(
        *ks, "_groups", "slot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(block))).alias("_first")
    ).repartition(width, "_first", "slot")
    last = F.least(F.col("_first") + (block - 1), F.lit(draws - 1))
    slots = blocks.select(*ks, "_groups", "slot", F.explode(F.sequence(F.col("_first"), last)).alias("draw"))
    picked = slots.select(*ks, "draw", (seeded_int(seed, "draw", "slot") % F.col("_groups")).alias("slot"))
    weights = picked.groupBy(*ks, "draw", "slot").agg(F.count(F.lit(1)).alias("weight"))
    extra = [c for c in groups.columns if c not in (*keys, group)]
    return weights.join(numbered, [*ks, "slot"]).select(*keys, "draw", group, "weight", *extra)


def cluster_bootstrap(
    per_group: DataFrame,
    keys: Sequence[str],
    value: str,
    seed: int,
    draws: int = 2000,
    level: float = 0.95,
    group: str = "project",
) -> DataFrame:
    """(keys, ci_lo, ci_hi): interval of the mean of ``value`` over resampled groups.

    The per-group values (one row per group) are written first: they are read several times and
    whatever produced them should run once.
    """
    values = written(per_group.where(F.col(value).isNotNull()).select(*keys, group, value), "groups")
    means = draw_weights(values, keys, draws, seed, group).groupBy(*keys, "draw").agg(
        (F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("m")
    )
    tail = (1.0 - level) / 2.0
    # One value per draw, so the exact percentile works on at most ``draws`` values per key.
    return means.groupBy(*keys).agg(
        F.percentile("m", F.lit(tail)).alias("ci_lo"), F.percentile("m", F.lit(1.0 - tail)).alias("ci_hi")
    )
