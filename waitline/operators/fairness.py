"""Is the score more pessimistic about some slices than their outcomes warrant?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.conf import Settings
from waitline.operators.bootstrap import cluster_bootstrap
from waitline.operators.evaluation import with_slices
from waitline.session import written


def _gap_parts(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys and project: rows, positives and summed scores, from which everything follows."""
    return sliced.groupBy(*keys, "project").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_slow").cast("double")).alias("pos"), F.sum("p_hat").alias("sp"),
        (F.avg("p_hat") - F.avg(F.col("is_slow").cast("double"))).alias("gap"))


def slice_gaps(scored: DataFrame, settings: Settings, keys: Sequence[str] = (), draws: int = 2000) -> DataFrame:
    """Per slice: sizes, actual and predicted rate, mean project gap and its group-bootstrap interval."""
    ks = [*keys, "slice", "level"]
    per = written(_gap_parts(with_slices(scored), ks), "gaps")
    top = per.groupBy(*ks).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_projects"), (F.sum("pos") / F.sum("n")).alias("actual_rate"),
        (F.sum("sp") / F.sum("n")).alias("mean_p_hat"), F.avg("gap").alias("gap"))
    ci = cluster_bootstrap(per, ks, "gap", settings.seed, draws).select(
        *ks, F.col("ci_lo").alias("gap_ci_lo"), F.col("ci_hi").alias("gap_ci_hi"))
    return top.join(ci, ks)


def gap_difference(scored: DataFrame, settings: Settings, keys: Sequence[str] = (), draws: int = 2000) -> DataFrame:
    """Newcomer gap minus repeat gap, paired by project, with its interval."""
    first = F.coalesce("is_first_here", F.lit(False))
    y = F.col("is_slow").cast("double")
    gap = lambda cond: F.avg(F.when(cond, F.col("p_hat"))) - F.avg(F.when(cond, y))
    per = scored.groupBy(*keys, "project").agg(
        (gap(first) - gap(~first)).alias("diff"), F.count_if(first).alias("nf"), F.count_if(~first).alias("nr"))
    per = written(per, "paired-gaps")
    # A project without both kinds of rows has no difference and stays out of the mean.
    all_ = list(keys) or [F.lit("all").alias("_all")]
    top = per.groupBy(*all_).agg(
        F.avg("diff").alias("difference"), F.sum("nf").alias("n_first_time"), F.sum("nr").alias("n_repeat"))
    ci = cluster_bootstrap(per, keys, "diff", settings.seed, draws)
    out = top.join(ci, list(keys)) if keys else top.join(ci.withColumn("_all", F.lit("all")), "_all").drop("_all")
    return out.withColumn("ci_excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))
