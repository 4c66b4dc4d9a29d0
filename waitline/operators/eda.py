"""Distribution of waits: definition sensitivity, histogram, survival, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.conf import Settings
from waitline.functions.ordered import exact_quantiles, running_totals, score_bucket
from waitline.operators.splits import row_share

_yes = lambda c: F.avg(F.col(c).cast("double"))


def definition_table(labelled: DataFrame, settings: Settings) -> DataFrame:
    """Slow rate, never rate and median observed wait per definition."""
    rates = labelled.groupBy("definition").agg(_yes("is_slow").alias("is_slow"), _yes("never_answered").alias("never_answered"))
    observed = labelled.where("event_observed")
    bucket = score_bucket(F.col("wait_h"), 0, settings.censor_h)
    median = exact_quantiles(observed, ["definition"], "wait_h", [0.5], ["median_wait_h"], bucket)
    return rates.join(median, "definition", "left")


def cohort_table(checked: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The checked cohort with each project's share of the modelling rows and its never-answered rate.

    A project without modelling rows has share 0; without labels its rate is null.
    """
    share = row_share(rows).drop("n")
    never = labels.groupBy("project").agg(_yes("never_answered").alias("never_answered"))
    return checked.join(share, "project", "left").join(never, "project", "left").withColumn(
        "row_share", F.coalesce("row_share", F.lit(0.0)))


def definition_spread(table: DataFrame) -> DataFrame:
    """Largest minus smallest slow rate over definitions."""
    return table.agg((F.max("is_slow") - F.min("is_slow")).alias("spread"))


def project_spread(labelled: DataFrame, a: str = "D3", b: str = "D5") -> DataFrame:
    """(project, spread): |slow rate under a - slow rate under b|."""
    rate = lambda d: F.avg(F.when(F.col("definition") == d, F.col("is_slow").cast("double")))
    return labelled.where(F.col("definition").isin(a, b)).groupBy("project").agg(F.abs(rate(a) - rate(b)).alias("spread"))


def spread_summary(spreads: DataFrame) -> DataFrame:
    """Median, maximum and the project of the maximum (first by name)."""
    top = spreads.agg(F.max("spread").alias("max_spread"))
    named = spreads.where(F.col("spread") == top.scalar()).agg(F.min("project").alias("project"))
    median = exact_quantiles(spreads, [], "spread", [0.5], ["median_spread"], score_bucket(F.col("spread")))
    return median.withColumn("max_spread", top.scalar()).withColumn("project", named.scalar())


def with_tier(labels: DataFrame, cohort: DataFrame) -> DataFrame:
    return labels.join(cohort.select("project", F.col("size_tier").alias("tier")), "project")


def wait_histogram(tiered: DataFrame, bins: int = 40) -> DataFrame:
    """Density of log10(wait hours) per tier, equal bins over the tier's own range, top edge included.

    Waits under 0.01 h count as 0.01 h; a tier with one value gets a range of one around it.
    """
    x = tiered.where("event_observed").select("tier", F.log10(F.greatest(F.col("wait_h"), F.lit(0.01))).alias("x"))
    flat = F.max("x") == F.min("x")
    span = x.groupBy("tier").agg(
        F.count(F.lit(1)).alias("_n"),
        F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("lo"),
        F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = x.join(span, "tier").groupBy("tier", bin_.alias("bin"), "lo", "hi", "_n").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "tier", "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), "n",
        (F.col("n") / (F.col("_n") * width)).alias("density"))


def survival(labels: DataFrame, settings: Settings, keys: Sequence[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """Kaplan-Meier share still waiting at each duration, with a log-log Greenwood band.

    Durations are counted first; two running totals over distinct durations give the risk sets
    and the product.  A step to zero is carried as a flag, because ln 0 would vanish from a sum.
    """
    keys = list(keys)
    bucket = score_bucket(F.col("t"), 0, settings.censor_h)
    at = labels.groupBy(*keys, F.col("wait_h_censored").alias("t")).agg(
        F.count_if("event_observed").alias("d"), F.count(F.lit(1)).alias("m"))
    down = running_totals(at, keys, "t", ["m"], bucket, descending=True).withColumnRenamed("cum_m", "at_risk")
    left = F.col("at_risk") - F.col("d")
    steps = down.select(
        *keys, "t", "d", "at_risk",
        F.when(left > 0, F.ln(left / F.col("at_risk"))).otherwise(0.0).alias("ls"),
        F.when(left > 0, F.col("d") / (F.col("at_risk") * left)).otherwise(0.0).alias("v"),
        (left == 0).cast("int").alias("zero"))
    run = running_totals(steps, keys, "t", ["ls", "v", "zero"], bucket)
    s = F.when(F.col("cum_zero") > 0, 0.0).otherwise(F.exp("cum_ls"))
    # S ** exp(+-z * sqrt(v) / ln S), defined while 0 < S < 1.
    inside = (F.col("cum_zero") == 0) & (F.col("cum_ls") < 0)
    spread = F.lit(z) * F.sqrt("cum_v") / F.col("cum_ls")
    band = lambda sign: F.when(inside, F.exp(F.col("cum_ls") * F.exp(sign * spread))).otherwise(s)
    return run.select(*keys, "t", "d", "at_risk", s.alias("survival"), band(1).alias("ci_lo"), band(-1).alias("ci_hi"))


def threshold_table(tiered: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Slow rate per (tier, threshold) and over all tiers, from one pass of conditional averages."""
    slow = lambda h: F.avg((F.col("never_answered") | F.coalesce(F.col("wait_h") > h, F.lit(False))).cast("double"))
    wide = tiered.rollup("tier").agg(*[slow(h).alias(f"t{int(h)}") for h in thresholds])
    cells = ", ".join(f"{int(h)}, t{int(h)}" for h in thresholds)
    return wide.selectExpr(
        "coalesce(tier, 'all') as tier", f"stack({len(thresholds)}, {cells}) as (threshold_h, is_slow)")
