"""Pre-registered test: do project-level features only memorise the projects of the training set?

T compares, between scenarios, how well a model's project contribution ranks the projects' outcomes;
I compares what removing those features does to average precision.  Both use one set of draws.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline import registry
from waitline.functions.ordered import average_ranks, quantile_buckets, running_totals, score_bucket
from waitline.operators import metrics as M
from waitline.operators.bootstrap import draw_weights
from waitline.operators.gates import checks
from waitline.session import written

# Within this band a change of reliance counts as unchanged.
RELIANCE_BAND = 0.05

# Verdict per outcome of the transfer test and of the intervention.
VERDICTS = (
    ("confirms", "confirms", "SUPPORTED"),
    ("confirms", "inconclusive", "PARTIAL_SHAP_ONLY"),
    ("inconclusive", "confirms", "PARTIAL_INTERVENTION_ONLY"),
    ("inconclusive", "inconclusive", "NOT_SUPPORTED"),
    ("confirms", "contradicts", "CONFLICTING"),
    ("contradicts", "confirms", "CONFLICTING"),
    ("inconclusive", "contradicts", "CONTRADICTED"),
    ("contradicts", "inconclusive", "CONTRADICTED"),
    ("contradicts", "contradicts", "CONTRADICTED"),
)


def varying_within(table: DataFrame, features: Sequence[str], group: str = "project") -> DataFrame:
    """(feature, n_groups): in how many groups the feature takes more than one value; null is a value."""
    aggs = []
    for f in features:
        nulls = F.count_if(F.col(f).isNull())
        mixed = (nulls > 0) & (nulls < F.count(F.lit(1)))
        aggs.append((F.coalesce(F.min(f) != F.max(f), F.lit(False)) | mixed).alias(f))
    per = table.groupBy(group).agg(*aggs)
    counts = per.agg(*[F.count_if(f).alias(f) for f in features])
    cells = ", ".join(f"'{f}', `{f}`" for f in features)
    return counts.selectExpr(f"stack({len(features)}, {cells}) as (feature, n_groups)")


def subset_contribution(contributions: str, features: Sequence[str], subset: Sequence[str]) -> Column:
    """Summed pushes of a feature subset in one row; a subset member without a column is an error."""
    missing = [f for f in subset if f not in features]
    if missing:
        raise ValueError(f"no contribution column for {missing}")
    at = F.array(*[F.lit(features.index(f) + 1) for f in subset])
    return F.aggregate(at, F.lit(0.0), lambda a, i: a + F.element_at(contributions, i))


def per_project(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean contribution c, outcome rate y and size per project."""
    return rows.groupBy(*keys, "project").agg(
        F.avg("contrib").alias("c"), F.avg(F.col("is_slow").cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rho): correlation of average ranks."""
    ranked = average_ranks(average_ranks(df.select(*keys, x, y), keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"))


def outcome(lo: str, hi: str) -> Column:
    """confirms / contradicts / inconclusive; touching zero does not exclude it, a non-finite bound is an error."""
    a, b = F.col(lo), F.col(hi)
    broken = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    return (
        F.when(broken, F.raise_error(F.lit("non-finite interval")).cast("string"))
        .when(a > 0, "confirms").when(b < 0, "contradicts").otherwise("inconclusive")
    )


def verdicts(results: DataFrame) -> DataFrame:
    """Add both outcomes and the verdict to rows with T_lo, T_hi, I_lo, I_hi."""
    table = results.sparkSession.createDataFrame(VERDICTS, "t_outcome string, i_outcome string, verdict string")
    judged = results.withColumn("t_outcome", outcome("T_lo", "T_hi")).withColumn("i_outcome", outcome("I_lo", "I_hi"))
    # Nine fixed rows.
    return judged.join(F.broadcast(table), ["t_outcome", "i_outcome"])


def reliance_band(delta) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.when(d > RELIANCE_BAND, "higher").when(d < -RELIANCE_BAND, "lower").otherwise("unchanged")


def fold_precision(rows: DataFrame, score: str, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, fold, ap): AP per fold, folds with one class left out."""
    ks = [*keys, "fold"]
    steps = M.score_steps(rows, ks, score, weight=weight)
    both = steps.groupBy(*ks).agg(
        (F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"),
        F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    return both.where((F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).drop("_p", "_n")


def mean_fold_precision(rows: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return fold_precision(rows, score, keys).groupBy(*keys).agg(F.avg("ap").alias("ap"))


def precision_delta(rows: DataFrame, new: str, old: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean-of-folds AP of one model minus another's on the same rows."""
    two = _both_models(rows, {"new": new, "old": old}, keys)
    ap = mean_fold_precision(two, "score", [*keys, "model"])
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("ap")))
    return ap.groupBy(*keys).agg((pick("new") - pick("old")).alias("delta"))


def _both_models(rows: DataFrame, models: dict[str, str], keep: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"'{k}', {v}" for k, v in models.items())
    return rows.selectExpr(*keep, "fold", "is_slow", f"stack({len(models)}, {cells}) as (model, score)")


def _weighted_spearman(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman with multiplicities: a point of weight w counts w times, ties share their mean rank."""
    ranked = points
    for v in ("c", "y"):
        counts = points.groupBy(*keys, v).agg(F.sum("weight").alias("_w"))
        run = running_totals(counts, keys, v, ["_w"], score_bucket(F.col(v), -1, 1))
        ranks = run.select(*keys, v, (F.col("cum__w") - (F.col("_w") - 1) / 2.0).alias("r" + v))
        ranked = ranked.join(ranks, [*keys, v])
    w, x, y = F.col("weight"), F.col("rc"), F.col("ry")
    s = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"))
    spread = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    rho = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.nullif(spread, F.lit(0.0)))
    return s.select(*keys, rho.alias("rho"))


#: Blocks of the score axis per (scenario, fold, model), steps that are spread over the draws at a time.
BLOCKS, STEPS = 64, 256


def _weight_matrix(rows: pd.DataFrame, weights: pd.DataFrame, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """[project, draw + 1] how often each project occurs in each draw, absent means zero; the project of each row."""
    place = {p: i for i, p in enumerate(weights["project"])}
    dense = np.zeros((len(place), draws + 1), np.float64)
    for i, (at, w) in enumerate(zip(weights["draws"], weights["times"], strict=True)):
        dense[i, np.asarray(at) + 1] = w
    return dense, rows["project"].map(place).to_numpy()


def drawn_precision(rows: DataFrame, weights: DataFrame, draws: int) -> DataFrame:
    """(scenario, fold, model, draw, ap) for every draw, folds with one class in a draw left out.

    ``rows``: scenario, fold, model, project, score, is_slow; ``weights``: draw (from -1), project, weight.

    Rows are counted per (score, project), and the score axis of each fold and model is cut into blocks that hold equal
    scores together.  A task holds one block and, for the projects in it, their weights in all draws.  It first adds up
    positives and rows for every draw; a running total over blocks gives what lies above a block, and a second pass
    turns steps of the block into one partial sum for each draw.  Rows and draws meet only inside a task, a few steps at
    a time; what is shuffled is blocks x draws and, for each block, the weights of its projects.
    """
    axis = ["scenario", "fold", "model"]
    broken = F.when(F.col("score").isNull(), F.raise_error(F.lit("a row has no score"))).otherwise(F.col("score").cast("double"))
    counted = rows.select(*axis, "project", broken.alias("score"), F.col("is_slow").cast("boolean").alias("_y")).groupBy(*axis, "score", "project").agg(
        F.count_if("_y").alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = written(quantile_buckets(written(counted, "scores"), axis, "score", BLOCKS, "block"), "score-blocks")
    spread = written(weights.groupBy("project").agg(F.collect_list(F.struct("draw", "weight")).alias("w")).select(
        "project", F.col("w.draw").alias("draws"), F.col("w.weight").alias("times")), "project-draws")
    key = [*axis, "block"]
    here = written(counts.select(*key, "project").distinct().join(spread, "project"), "block-weights")

    def totals(rows: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*key, "draw", "pos", "n"])
        dense, at = _weight_matrix(rows, weights, draws)
        pos, n = (np.bincount(at, weights=rows[c], minlength=len(dense)) @ dense for c in ("pos", "n"))
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in key}, "draw": np.arange(-1, draws), "pos": pos, "n": n})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*key).schema)
    total = written(counts.groupBy(*key).cogroup(here.groupBy(*key)).applyInPandas(totals, f"{kinds}, draw int, pos double, n double"), "block-totals")
    above = W.partitionBy(*axis, "draw").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    carry = total.select(*key, "draw", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("pos", "n")])
    carry = carry.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("draw", "pos", "n"))).alias("c")).select(
        *key, F.col("c.pos").alias("pos_above"), F.col("c.n").alias("n_above"))
    # The carried totals travel as one more row of the block's weights.
    here = here.unionByName(carry, allowMissingColumns=True).groupBy(*key)

    def partial(rows: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*axis, "draw", "part"])
        rows = rows.sort_values("score", ascending=False, kind="stable")
        top = weights[weights["pos_above"].notna()].iloc[0]
        dense, at = _weight_matrix(rows, weights[weights["pos_above"].isna()], draws)
        pos_above, n_above, part = np.array(top["pos_above"]), np.array(top["n_above"]), np.zeros(draws + 1)
        score, pos, n = (rows[c].to_numpy() for c in ("score", "pos", "n"))
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        for k in range(0, len(first), STEPS):
            ends = [*first[k:k + STEPS], first[k + STEPS] if k + STEPS < len(first) else len(score)]
            w, cut = dense[at[ends[0]:ends[-1]]], np.array(ends[:-1]) - ends[0]
            step_pos = np.add.reduceat(w * pos[ends[0]:ends[-1], None], cut, axis=0)
            cum_pos = pos_above + np.cumsum(step_pos, axis=0)
            cum_n = n_above + np.cumsum(np.add.reduceat(w * n[ends[0]:ends[-1], None], cut, axis=0), axis=0)
            part += (step_pos * cum_pos / np.maximum(cum_n, 1)).sum(axis=0)
            pos_above, n_above = cum_pos[-1], cum_n[-1]
        return pd.DataFrame({**{c: rows[c].iloc[0] for c in axis}, "draw": np.arange(-1, draws), "part": part})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*axis).schema)
    parts = counts.groupBy(*key).cogroup(here).applyInPandas(partial, f"{kinds}, draw int, part double")
    sums = parts.groupBy(*axis, "draw").agg(F.sum("part").alias("part"))
    whole = total.groupBy(*axis, "draw").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n")).where("_p > 0 and _p < _n")
    return whole.join(sums, [*axis, "draw"]).select(*axis, "draw", (F.col("part") / F.col("_p")).alias("ap"))


def paired_bootstrap(rows: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """T and I with intervals from one set of project draws shared by both scenarios.

    ``rows``: scenario (A, B), fold, project, is_slow, p_nlr, p_no_project, contrib.  Draw -1 takes every
    project once and gives the point estimates through the same path.  Of the projects, draws make
    projects x draws rows; of the rows they make none (see ``drawn_precision``).
    """
    per = written(per_project(rows, ["scenario"]), "per-project")
    sides = per.groupBy("project").agg(F.count_distinct("scenario").alias("k")).where(F.col("k") != 2).limit(1).count()
    if sides:
        raise ValueError("both scenarios must cover the same projects")
    projects = per.where("scenario = 'A'").select("project")
    once = projects.select(F.lit(-1).alias("draw"), "project", F.lit(1).cast("long").alias("weight"))
    weights = written(draw_weights(projects, [], draws, seed).unionByName(once), "weights")

    points = weights.join(per.select("scenario", "project", "c", "y"), "project")
    rho = _weighted_spearman(points, ["scenario", "draw"])
    t = rho.groupBy("draw").agg(
        *[F.max(F.when(F.col("scenario") == s, F.col("rho"))).alias(f"rho_{s.lower()}") for s in "AB"])

    ap = drawn_precision(_both_models(rows, {"new": "p_no_project", "old": "p_nlr"}, ["scenario", "project"]), weights, draws)
    ap = ap.groupBy("scenario", "draw").agg(
        (F.avg(F.when(F.col("model") == "new", F.col("ap"))) - F.avg(F.when(F.col("model") == "old", F.col("ap")))).alias("delta"))
    i = ap.groupBy("draw").agg(
        *[F.max(F.when(F.col("scenario") == s, F.col("delta"))).alias(f"delta_{s.lower()}") for s in "AB"])

    both = t.join(i, "draw", "full").withColumn("T", F.col("rho_a") - F.col("rho_b")).withColumn(
        "I", F.col("delta_b") - F.col("delta_a"))
    point, real = F.col("draw") == -1, F.col("draw") >= 0
    tail = (1 - level) / 2
    bound = lambda c, p: F.percentile(F.when(real, F.col(c)), F.lit(p))
    first = lambda c: F.max(F.when(point, F.col(c)))
    return both.agg(
        *[first(c).alias(c) for c in ("rho_a", "rho_b", "delta_a", "delta_b")],
        first("T").alias("T"), bound("T", tail).alias("T_lo"), bound("T", 1 - tail).alias("T_hi"),
        first("I").alias("I"), bound("I", tail).alias("I_lo"), bound("I", 1 - tail).alias("I_hi"),
        F.count_if(real & F.col("T").isNull()).alias("dropped_T"), F.count_if(real & F.col("I").isNull()).alias("dropped_I"))


def join_models(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two models' predictions side by side, one row per (scenario, fold, id)."""
    ks = ["scenario", "fold", "id"]
    return old.withColumnRenamed("p_hat", "p_nlr").join(
        new.select(*ks, F.col("p_hat").alias("p_no_project")), ks)


def intervention_rows(
    explained: DataFrame, without: DataFrame, features: Sequence[str], subset: Sequence[str] = registry.PROJECT_FEATURES
) -> DataFrame:
    """Rows of the paired test from two models' predictions; ``contrib`` is what the subset pushes in the first model."""
    pushed = explained.withColumn("contrib", subset_contribution("contributions", list(features), subset))
    return join_models(pushed, without).select("scenario", "fold", "id", "project", "is_slow", "p_nlr", "p_no_project", "contrib")


def same_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(scenario, fold, only_old, only_new, repeated): all zero when both models scored the same rows once."""
    ks = ["scenario", "fold", "id"]
    n = old.groupBy(*ks).agg(F.count(F.lit(1)).alias("o")).join(
        new.groupBy(*ks).agg(F.count(F.lit(1)).alias("n")), ks, "full")
    return n.groupBy("scenario", "fold").agg(
        F.count_if(F.col("n").isNull()).alias("only_old"), F.count_if(F.col("o").isNull()).alias("only_new"),
        F.count_if((F.coalesce("o", F.lit(0)) > 1) | (F.coalesce("n", F.lit(0)) > 1)).alias("repeated"))


def reliance(imp_a: DataFrame, imp_b: DataFrame, subset: Sequence[str] = registry.PROJECT_FEATURES) -> DataFrame:
    from waitline.operators.attribution import shift

    return shift(imp_a, imp_b).withColumn("in_subset", F.col("feature").isin(*subset))


def coverage(rows: DataFrame) -> DataFrame:
    """Do both scenarios cover the same projects, and does B hold each out exactly once?"""
    per = rows.groupBy("project").agg(
        F.count_distinct("scenario").alias("sides"),
        F.count_distinct(F.when(F.col("scenario") == "B", F.col("fold"))).alias("held"))
    return per.agg(
        F.count(F.lit(1)).alias("n_projects"), (F.min("sides") == 2).alias("same_projects"),
        ((F.min("held") == 1) & (F.max("held") == 1)).alias("b_each_once"))


def fold_table(rows: DataFrame) -> DataFrame:
    """(scenario, fold, n_test, auc_pr_nlr, auc_pr_no_project, delta)."""
    ks = ["scenario", "fold"]
    n = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_test"))
    a = M.average_precision(rows, ks, "p_nlr", name="auc_pr_nlr")
    b = M.average_precision(rows, ks, "p_no_project", name="auc_pr_no_project")
    return n.join(a, ks).join(b, ks).withColumn("delta", F.col("auc_pr_no_project") - F.col("auc_pr_nlr"))


def hypothesis_gate(
    result: DataFrame, rows_same: DataFrame, cover: DataFrame, varying: DataFrame, gap: Column, refit_delta: Column,
    expected_projects: int,
) -> DataFrame:
    """Check rows; 1 and 2 are hard stops."""
    full, cut = set(registry.FEATURE_SETS["FULL"]), set(registry.FEATURE_SETS["NO_SNAPSHOT"])
    registry.check_hygiene(registry.no_project_columns())
    sets_ok = full - cut == set(registry.PROJECT_FEATURES) and len(registry.no_project_columns()) == 25
    finite = F.lit(True)
    for c in ("T_lo", "T_hi", "I_lo", "I_hi"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    facts = result.withColumn("gap", gap).withColumn("refit", refit_delta).withColumn(
        "unequal", rows_same.agg(F.sum(F.col("only_old") + F.col("only_new") + F.col("repeated")).alias("u")).scalar()
    ).withColumn("varying", varying.agg(F.sum("n_groups").alias("v")).scalar()
    ).withColumn("n_projects", cover.select("n_projects").scalar()
    ).withColumn("covered", cover.select(F.col("same_projects") & F.col("b_each_once")).scalar())
    return checks(facts, "hypothesis", [
        (1, "attributions add up to the margin", F.round("gap", 6), F.col("gap") < 1e-6),
        (2, "a refit reproduces the score", F.round("refit", 9), F.abs("refit") < 1e-6),
        (3, "both models scored the same rows", F.col("unequal"), F.col("unequal") == 0),
        (4, "project features are constant within projects", F.col("varying"), (F.col("varying") == 0) & F.lit(sets_ok)),
        (5, "scenarios cover the same projects, intervals are finite", F.col("n_projects"),
         (F.col("n_projects") == expected_projects) & F.col("covered") & finite),
    ])


def gated_verdict(result: DataFrame, gate: DataFrame, hard: Sequence[int] = (1, 2)) -> DataFrame:
    """The verdict, or no row when a hard stop failed.

    Where an interval is not finite there is no verdict: the figures stay, with null outcomes and a null verdict.  So it
    is when the subset pushes no project, as constants have no ranks to correlate.
    """
    failed = gate.where(F.col("id").isin(*hard) & ~F.col("pass")).agg(F.count(F.lit(1)).alias("n")).scalar()
    finite = reduce(and_, [
        F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in ("T_lo", "T_hi", "I_lo", "I_hi")])
    passed = result.where(failed == 0)
    return verdicts(passed.where(finite)).unionByName(passed.where(~finite), allowMissingColumns=True)


def spearman_interval(per: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Interval of one Spearman correlation of (c, y) over project draws."""
    values = written(per.select("project", "c", "y"), "pairs")
    rho = _weighted_spearman(draw_weights(values, [], draws, seed), ["draw"])
    tail = (1 - level) / 2
    return rho.agg(F.percentile("rho", F.lit(tail)).alias("ci_lo"), F.percentile("rho", F.lit(1 - tail)).alias("ci_hi"))
