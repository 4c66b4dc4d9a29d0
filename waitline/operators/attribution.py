"""Attributions: importance, shift, shares, rank stability and the worst predictions explained.

A contribution row is (id, contributions array<double>), in the order of a list of feature names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline import registry
from waitline.functions.columns import seeded
from waitline.functions.ordered import average_ranks


def names_array(features: Sequence[str]):
    return F.array(*[F.lit(f) for f in features])


def sample_rows(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows by hash order: a distributed top-n, no full sort."""
    return rows.orderBy(seeded(seed, "id"), "id").limit(n)


def importance(contributions: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, mean_abs, share): mean size of the pushes and its share of the total.

    The vector mean is one aggregate over the whole array; rows are never exploded.
    """
    sizes = array_to_vector(F.transform("contributions", F.abs))
    mean = contributions.groupBy(*keys).agg(Summarizer.mean(sizes).alias("_m")).select(
        *keys, vector_to_array("_m").alias("_m"))
    total = F.aggregate("_m", F.lit(0.0), lambda a, v: a + v)
    cells = mean.select(*keys, total.alias("_total"), F.posexplode("_m").alias("_i", "mean_abs"))
    share = F.coalesce(F.col("mean_abs") / F.nullif("_total", F.lit(0.0)), F.lit(0.0))
    return cells.select(
        *keys, F.element_at(names_array(features), F.col("_i") + 1).alias("feature"), "mean_abs", share.alias("share"))


def shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share in b minus share in a per feature; a feature absent from one side has share zero."""
    x = a.select("feature", F.col("share").alias("share_a"))
    y = b.select("feature", F.col("share").alias("share_b"))
    both = x.join(y, "feature", "full").na.fill(0.0, ["share_a", "share_b"])
    return both.withColumn("delta", F.col("share_b") - F.col("share_a"))


def share_of(imp: DataFrame, features: Sequence[str] = registry.LABEL_REPLAY, keys: Sequence[str] = ()) -> DataFrame:
    """Summed share of a feature group."""
    return imp.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("feature").isin(*features), F.col("share"))), F.lit(0.0)).alias("share"))


def rank_stability(a: DataFrame, b: DataFrame, top: int = 10) -> DataFrame:
    """Spearman correlation of mean sizes over a's ``top`` features, between two samples."""
    best = a.orderBy(F.desc("mean_abs"), "feature").limit(top).select("feature", F.col("mean_abs").alias("x"))
    both = best.join(b.select("feature", F.col("mean_abs").alias("y")), "feature")
    # At most ``top`` rows from here on.
    ranked = average_ranks(average_ranks(both, [], "x", "rx"), [], "y", "ry")
    return ranked.agg(F.corr("rx", "ry").alias("stability"))


def worst_rows(scored: DataFrame, features: Sequence[str], n: int = 25, k: int = 5) -> DataFrame:
    """The n most confident false alarms and the n most confident misses, with their k strongest pushes.

    ``scored``: id, project, is_slow, p_hat, contributions, values array<string>, ...
    """
    error = F.when(F.col("is_slow"), -F.col("p_hat")).otherwise(F.col("p_hat"))
    w = W.partitionBy("is_slow").orderBy(F.desc("_e"), "id")
    worst = scored.withColumn("_e", error).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    cells = F.zip_with("contributions", F.sequence(F.lit(0), F.size("contributions") - 1), lambda v, i: F.struct(
        (-F.abs(v)).alias("size"), i.alias("position"), v.alias("push")))
    top = F.transform(F.slice(F.array_sort(cells), 1, k), lambda s: F.struct(
        F.element_at(names_array(features), s["position"] + 1).alias("feature"), s["push"].alias("push"),
        F.element_at("values", s["position"] + 1).alias("value")))
    return worst.withColumn("kind", F.when(F.col("is_slow"), "fn").otherwise("fp")).withColumn("top", top).drop("_e")


def error_patterns(worst: DataFrame, table: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_worst, mean_all, z): how unusual each feature is among the worst rows.

    z is 0 where the feature does not vary.  All features are aggregated in one pass.
    """
    flagged = table.join(worst.select("id").distinct().withColumn("_w", F.lit(True)), "id", "left")
    aggs = []
    for i, f in enumerate(features):
        v = F.col(f).cast("double")
        aggs += [F.avg(F.when(F.col("_w"), v)).alias(f"w{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
    cells = F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"w{i}").alias("mean_worst"), F.col(f"a{i}").alias("mean_all"), F.col(f"s{i}").alias("sd"))
        for i, f in enumerate(features)])
    out = flagged.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")
    z = F.coalesce((F.col("mean_worst") - F.col("mean_all")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0))
    return out.select("feature", "mean_worst", "mean_all", z.alias("z"))


def additivity_gap(explained: DataFrame) -> DataFrame:
    """max |base + sum of pushes - raw margin| over rows with base, contributions and margin."""
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return explained.agg(F.max(F.abs(total - F.col("margin"))).alias("gap"))


def interpretation_gate(
    gap: DataFrame, stability: DataFrame, worst: DataFrame, scored: DataFrame, slices: DataFrame, artifacts: dict[str, DataFrame],
    n: int = 25,
) -> DataFrame:
    """Gate over the interpretation: additivity, stability, error rows, finite intervals, artifacts."""
    from waitline.operators.gates import checks

    truth = scored.select("id", F.col("is_slow").alias("truth"))
    strays = worst.join(truth, "id", "left").where(F.col("truth").isNull() | (F.col("truth") != F.col("is_slow")))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    empty = F.lit(0)
    for df in artifacts.values():
        empty = empty + F.when(df.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() == 0, 1).otherwise(0)
    facts = worst.agg(F.count_if(F.col("kind") == "fp").alias("fp"), F.count_if(F.col("kind") == "fn").alias("fn")
    ).withColumn("gap", gap.scalar()).withColumn("stability", stability.scalar()
    ).withColumn("strays", strays.agg(F.count(F.lit(1)).alias("n")).scalar()
    ).withColumn("bad", slices.agg(F.count_if(~(finite("gap_ci_lo") & finite("gap_ci_hi")) | (F.col("n_projects") < 2)).alias("b")).scalar()
    ).withColumn("empty", empty)
    return checks(facts, "interpretation", [
        (1, "attributions add up to the margin", F.round("gap", 6), F.col("gap") < 1e-6),
        (2, "two samples rank features alike", F.round("stability", 4), F.col("stability") >= 0.9),
        (3, "error rows are real and complete", F.col("strays"), (F.col("strays") == 0) & (F.col("fp") == n) & (F.col("fn") == n)),
        (4, "slice intervals are finite", F.col("bad"), F.col("bad") == 0),
        (5, "every artifact has rows", F.col("empty"), F.col("empty") == 0),
    ])
