"""Scoring of predictions, run tables and their summaries.

``scored`` rows: keys (scenario, fold, featureset), id, project, created_at, is_slow, p_hat,
baseline_score, is_first_here, created_hour.  Every function computes all its slices in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline import registry
from waitline.conf import DAY_US, HOUR_BUCKETS, Settings
from waitline.functions.columns import instant, micros
from waitline.functions.ordered import exact_quantiles, join_null_safe, score_bucket
from waitline.operators import metrics as M
from waitline.operators.bootstrap import cluster_bootstrap
from waitline.operators.gates import checks
from waitline.session import written

RUN = ("scenario", "fold", "featureset")


def evaluate(scored: DataFrame, keys: Sequence[str], settings: Settings, draws: int = 2000, k: int = 10) -> DataFrame:
    """One row per slice: sizes, P@k with its group-bootstrap interval, AP, and the baseline on the same rows.

    ``scored`` is read once for the sizes and rates, once for all average precisions and once per P@k: pass a written
    or persisted table.
    """
    keys = list(keys)
    counts = scored.groupBy(*keys, "project").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_slow").cast("long")).alias("pos"), F.count("is_slow").alias("known"))
    size = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_test"), F.count("project").alias("n_test_projects"),
        (F.sum("pos") / F.sum("known")).alias("base_rate"), F.avg(F.col("pos") / F.col("known")).alias("base_rate_p10"))
    scores = {"auc_pr": "p_hat"}
    if "baseline_score" in scored.columns:
        scores["baseline_auc_pr"] = "baseline_score"
    cells = ", ".join(f"'{name}', cast({column} as double)" for name, column in scores.items())
    each = scored.selectExpr(*keys, "is_slow", f"stack({len(scores)}, {cells}) as (_metric, _score)")
    ap = M.average_precision(each, [*keys, "_metric"], "_score", name="_ap").groupBy(*keys).agg(
        *[F.max(F.when(F.col("_metric") == name, F.col("_ap"))).alias(name) for name in scores])
    per = written(M.precision_per_project(scored, keys, settings.seed, k), "precision")
    mean = per.groupBy(*keys).agg(F.avg("precision").alias("precision_at_10"))
    interval = cluster_bootstrap(per, keys, "precision", settings.seed, draws).select(
        *keys, F.col("ci_lo").alias("p10_ci_lo"), F.col("ci_hi").alias("p10_ci_hi"))
    parts = [mean, interval, ap]
    if "baseline_score" in scored.columns:
        parts.append(M.precision_at_k(scored, keys, settings.seed, k, "baseline_score").withColumnRenamed(
            "precision_at_k", "baseline_p10"))
    for p in parts:
        size = join_null_safe(size, p, keys)
    return size


def baseline_scores(split_rows: DataFrame, trailing: DataFrame, settings: Settings) -> DataFrame:
    """Test rows scored by their project's replayed trailing rate, shrunk to each split's own training rate.

    ``split_rows`` carries scenario, fold, role; ``trailing`` is ``project_features_at`` per id.
    """
    g = split_rows.where("role = 'train'").groupBy("scenario", "fold").agg(
        F.avg(F.col("is_slow").cast("double")).alias("g"), F.count(F.lit(1)).alias("n_train"))
    counts = trailing.select(F.col("probe_id").alias("id"), "trailing_slow", "trailing_n")
    a = float(settings.alpha)
    return (
        split_rows.where("role = 'test'").join(g, ["scenario", "fold"]).join(counts, "id")
        .withColumn("p_hat", (F.col("trailing_slow") + a * F.col("g")) / (F.col("trailing_n") + a))
        .drop("trailing_slow", "trailing_n")
    )


def summarise(runs: DataFrame) -> DataFrame:
    """Mean over folds per scenario and feature set; interval bounds are averaged too."""
    columns = ["precision_at_10", "p10_ci_lo", "p10_ci_hi", "baseline_p10", "base_rate_p10", "auc_pr", "baseline_auc_pr"]
    return runs.groupBy("scenario", "featureset").agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(c) for c in columns])


def slice_levels() -> Column:
    """The slices one row belongs to: newcomer or repeat, and its hour bucket."""
    first = F.when(F.coalesce("is_first_here", F.lit(False)), "first-time").otherwise("repeat")
    hour = F.lit(None).cast("string")
    for lo, hi, name in reversed(HOUR_BUCKETS):
        hour = F.when((F.col("created_hour") >= lo) & (F.col("created_hour") < hi), name).otherwise(hour)
    return F.array(
        F.struct(F.lit("is_first_here").alias("slice"), first.alias("level")),
        F.struct(F.lit("hour_bucket").alias("slice"), hour.alias("level")),
    )


def with_slices(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_s", F.explode(slice_levels())).select("*", "_s.slice", "_s.level").drop("_s")


def bias_slices(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Size, actual and predicted rate and AP per slice; AP is null where only one class occurs."""
    ks = [*keys, "slice", "level"]
    sliced = with_slices(scored)
    y = F.col("is_slow").cast("double")
    size = sliced.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("actual_rate"), F.avg("p_hat").alias("mean_p_hat"),
        F.sum(y).alias("_pos"))
    ap = M.average_precision(sliced, ks)
    mixed = (F.col("_pos") > 0) & (F.col("_pos") < F.col("n"))
    return size.join(ap, ks).withColumn("auc_pr", F.when(mixed, F.col("auc_pr"))).drop("_pos")


def pool_comparability(scored: DataFrame) -> DataFrame:
    """Per scenario: how large and how spread in time the per-project candidate pools are."""
    per = scored.groupBy("scenario", "project").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_slow").alias("slow"),
        F.min(micros("created_at")).alias("first"), F.max(micros("created_at")).alias("last"))
    days = F.floor((F.max("last") - F.min("first")) / DAY_US)
    top = per.groupBy("scenario").agg(
        F.sum("n").alias("n_test_rows"), F.count(F.lit(1)).alias("n_projects"), F.min("n").alias("pool_min"),
        F.count_if(F.col("n") < 10).alias("projects_under_10"),
        F.count_if(F.col("slow") >= 10).alias("projects_with_10plus_slow"),
        F.bround(days / 30.4375, 0).cast("long").alias("months_spanned"))
    median = exact_quantiles(per.withColumn("v", F.col("n").cast("double")), ["scenario"], "v", [0.5], ["pool_median"],
                             score_bucket(F.log10(F.col("v")), 0, 12))
    return top.join(median, "scenario")


def weighted_delta(scored: DataFrame, settings: Settings, k: int = 10) -> DataFrame:
    """P@k gain over the baseline per scenario, unweighted and weighted by each project's rows."""
    ks = ["scenario"]
    model = M.precision_per_project(scored, ks, settings.seed, k).withColumnRenamed("precision", "m")
    base = M.precision_per_project(scored, ks, settings.seed, k, "baseline_score").withColumnRenamed("precision", "b")
    n = scored.groupBy(*ks, "project").agg(F.count(F.lit(1)).alias("n"))
    both = model.join(base, [*ks, "project"]).join(n, [*ks, "project"])
    gain = F.col("m") - F.col("b")
    return both.groupBy(*ks).agg(
        F.avg(gain).alias("unweighted_delta"), (F.sum(gain * F.col("n")) / F.sum("n")).alias("weighted_delta"),
        F.count(F.lit(1)).alias("n_projects"))


def ablation_delta(summary: DataFrame) -> DataFrame:
    """AP of every feature set minus that of FULL in the same scenario."""
    full = F.max(F.when(F.col("featureset") == "FULL", F.col("auc_pr"))).over(W.partitionBy("scenario"))
    return summary.select("scenario", "featureset", "auc_pr", (F.col("auc_pr") - full).alias("delta_vs_full"))


def folds_below_baseline(runs: DataFrame) -> DataFrame:
    """Per scenario and set: folds not above the baseline, and the range of AP over folds."""
    return runs.groupBy("scenario", "featureset").agg(
        F.count_if(F.col("auc_pr") <= F.col("baseline_auc_pr")).alias("folds_below"),
        F.min("auc_pr").alias("auc_min"), F.max("auc_pr").alias("auc_max"))


def fold_series(runs: DataFrame) -> DataFrame:
    """Long table of AP per fold: FULL, NO_LABEL_REPLAY and the baseline (on FULL's rows)."""
    model = runs.where(F.col("featureset").isin("FULL", "NO_LABEL_REPLAY")).select(
        "scenario", F.col("featureset").alias("series"), "fold", "auc_pr")
    base = runs.where("featureset = 'FULL'").select(
        "scenario", F.lit("baseline").alias("series"), "fold", F.col("baseline_auc_pr").alias("auc_pr"))
    return model.unionByName(base)


def series_means(folds: DataFrame) -> DataFrame:
    return folds.groupBy("scenario", "series").agg(F.avg("auc_pr").alias("auc_pr"), F.count(F.lit(1)).alias("folds"))


def headline(runs: DataFrame) -> DataFrame:
    """Scenario A's P@10 of the model, the baseline and a random pick."""
    a = runs.where("scenario = 'A' and featureset = 'FULL'")
    return a.selectExpr(
        "stack(3, 'model', precision_at_10, p10_ci_lo, p10_ci_hi, 'baseline', baseline_p10, cast(null as double),"
        " cast(null as double), 'random pick', base_rate_p10, cast(null as double), cast(null as double))"
        " as (series, p10, lo, hi)")


def split_leaks(split_rows: DataFrame, settings: Settings) -> DataFrame:
    """(scenario, fold, leaks): projects on both sides for B, training rows not before the test rows for A."""
    cutoff = instant(settings.cutoff)
    a = split_rows.where("scenario = 'A'").groupBy("scenario", "fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("created_at"))).alias("hi"),
        F.min(F.when(F.col("role") == "test", F.col("created_at"))).alias("lo"))
    a = a.select("scenario", "fold", (~((F.col("hi") < F.col("lo")) & (F.col("lo") >= cutoff))).cast("long").alias("leaks"))
    sides = split_rows.where("scenario = 'B'").groupBy("scenario", "fold", "project").agg(
        F.count_distinct("role").alias("roles"))
    b = sides.groupBy("scenario", "fold").agg(F.count_if(F.col("roles") > 1).alias("leaks"))
    return a.unionByName(b)


def provenance(split_rows: DataFrame) -> DataFrame:
    """Per split (scenario, fold): training rows and projects, last training and first test instant.

    ``split_rows`` carries scenario, fold, role, project and created_at.
    """
    train, at = F.col("role") == "train", F.col("created_at")
    per = split_rows.groupBy("scenario", "fold", "project").agg(
        F.count_if(train).alias("n"), F.max(F.when(train, at)).alias("until"), F.min(F.when(F.col("role") == "test", at)).alias("since"))
    return per.groupBy("scenario", "fold").agg(
        F.sum("n").alias("n_train"), F.count_if(F.col("n") > 0).alias("n_train_projects"),
        F.max("until").alias("train_until"), F.min("since").alias("test_from"))


def log_rows(runs: DataFrame, model: str) -> DataFrame:
    """Evaluated runs as rows of the experiment log; the baseline on the same rows goes to the notes."""
    note = F.format_string("baseline_p10=%.3f baseline_auc_pr=%.3f", "baseline_p10", "baseline_auc_pr")
    return runs.select(
        "scenario", "fold", F.lit(model).alias("model"), F.col("featureset").alias("features"), "params", "n_train", "n_test",
        "n_test_projects", "precision_at_10", "p10_ci_lo", "p10_ci_hi", "base_rate_p10", "auc_pr", "base_rate", note.alias("notes"))


def run_gate(runs: DataFrame, leaks: DataFrame, logged: DataFrame, refit_delta: float | Column, expected_runs: int) -> DataFrame:
    """The evaluation's validity gate."""
    hygiene = True
    for columns in registry.FEATURE_SETS.values():
        registry.check_hygiene(columns)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    facts = runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(~(finite("p10_ci_lo") & finite("p10_ci_hi"))).alias("bad_ci"),
        F.count_distinct(F.when(F.col("featureset") == "NO_LABEL_REPLAY", F.col("scenario"))).alias("ablated"),
    ).withColumn("leaks", leaks.agg(F.sum("leaks").alias("leaks")).scalar()
    ).withColumn("logged", logged.agg(F.count(F.lit(1)).alias("n")).scalar())
    delta = refit_delta if isinstance(refit_delta, Column) else F.lit(float(refit_delta))
    return checks(facts, "evaluation", [
        (1, "splits are disjoint", F.col("leaks"), F.col("leaks") == 0),
        (2, "no key, label or flag among features", F.lit("ok"), F.lit(hygiene)),
        (3, "label-replay ablation ran on both scenarios", F.col("ablated"), F.col("ablated") == 2),
        (4, "every run has an interval and is logged", F.col("n_runs"),
         (F.col("bad_ci") == 0) & (F.col("n_runs") == expected_runs) & (F.col("logged") == expected_runs)),
        (5, "a refit reproduces the score", F.round(delta, 9), F.abs(delta) < 1e-6),
    ])
