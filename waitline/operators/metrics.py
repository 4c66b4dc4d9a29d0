"""Ranking quality per group and overall; every metric can be computed for many slices at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline.functions.columns import seeded
from waitline.functions.ordered import join_null_safe, quantile_buckets, running_totals
from waitline.session import written

#: Blocks of the score axis per slice.
BLOCKS = 256


def precision_per_project(
    scored: DataFrame, keys: Sequence[str], seed: int, k: int = 10, score: str = "p_hat", outcome: str = "is_slow"
) -> DataFrame:
    """(keys, project, precision): share of positives in the top k, ties broken by a seeded hash.

    The rank filter lets Spark cut every partition to k rows per project before the shuffle.
    """
    w = W.partitionBy(*keys, "project").orderBy(F.desc(score), seeded(seed, "id"), "id")
    top = scored.select(*keys, "project", "id", score, outcome).withColumn("_rank", F.row_number().over(w))
    return top.where(F.col("_rank") <= k).groupBy(*keys, "project").agg(
        F.avg(F.col(outcome).cast("double")).alias("precision")
    )


def precision_at_k(scored: DataFrame, keys: Sequence[str], seed: int, k: int = 10, score: str = "p_hat") -> DataFrame:
    """(keys, precision_at_k): unweighted mean over projects."""
    return precision_per_project(scored, keys, seed, k, score).groupBy(*keys).agg(
        F.avg("precision").alias("precision_at_k")
    )


def score_steps(
    scored: DataFrame,
    keys: Sequence[str],
    score: str = "p_hat",
    outcome: str = "is_slow",
    bucket: Column | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Per distinct score, from the top: positives, rows and their running totals.

    ``bucket`` splits the score axis over tasks; by default splitters come from a quantile sketch per
    keys, so that a skewed score splits as evenly as any other.  A missing score cannot be ranked and
    fails the job.
    """
    ranked = F.when(F.col(score).isNull(), F.raise_error(F.lit(f"a row has no {score}"))).otherwise(F.col(score))
    one = F.col(weight) if weight else F.lit(1)
    counts = scored.withColumn(score, ranked).groupBy(*keys, score).agg(
        F.sum(F.when(F.col(outcome).cast("boolean"), one).otherwise(F.lit(0))).alias("pos"), F.sum(one).alias("n")
    )
    if bucket is not None:
        return running_totals(counts, keys, score, ["pos", "n"], bucket, descending=True)
    # Written: the sketch, the sums per bucket and the steps all read the counts.
    cut = quantile_buckets(written(counts, "score-counts"), keys, score, BLOCKS, "_cut")
    return running_totals(cut, keys, score, ["pos", "n"], F.col("_cut"), descending=True).drop("_cut")


def average_precision(
    scored: DataFrame,
    keys: Sequence[str] = (),
    score: str = "p_hat",
    outcome: str = "is_slow",
    name: str = "auc_pr",
    bucket: Column | None = None,
    weight: str | None = None,
) -> DataFrame:
    """(keys, auc_pr): sum over score steps of recall gained times precision there; ties are one step.

    Null where a slice has no positive row.
    """
    steps = score_steps(scored, keys, score, outcome, bucket, weight)
    gained = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    return steps.groupBy(*keys).agg((gained / F.nullif(F.sum("pos"), F.lit(0))).alias(name))


def base_rate_precision(scored: DataFrame, keys: Sequence[str] = (), outcome: str = "is_slow") -> DataFrame:
    """(keys, base_rate_p10): what a random order achieves, the mean of the projects' own rates."""
    per = scored.groupBy(*keys, "project").agg(F.avg(F.col(outcome).cast("double")).alias("r"))
    return per.groupBy(*keys).agg(F.avg("r").alias("base_rate_p10"))


def curve(scored: DataFrame, keys: Sequence[str] = (), score: str = "p_hat", bucket: Column | None = None) -> DataFrame:
    """Precision-recall points, one per distinct score."""
    steps = score_steps(scored, keys, score, bucket=bucket)
    total = steps.groupBy(*keys).agg(F.sum("pos").alias("_pos"))
    if keys:
        both = join_null_safe(steps, total, keys)
    else:
        both = steps.withColumn("_pos", total.scalar())
    return both.select(
        *keys, F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        (F.col("cum_pos") / F.nullif(F.col("_pos"), F.lit(0))).alias("recall"),
    )
