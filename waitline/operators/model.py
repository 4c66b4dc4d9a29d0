"""Boosted trees over the feature table: fit, predict, save, cross-validate, search, sweep.

Trees of the built-in learner take no nulls: a missing value becomes -1, below every real value of
the nullable columns, so a split can send missing rows either way.  That keeps one vector slot per
registered feature, which the attribution relies on.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from waitline import registry
from waitline.conf import Settings
from waitline.functions.columns import instant, seeded_int
from waitline.operators import evaluation as V
from waitline.operators import metrics as M
from waitline.operators import splits
from waitline.operators.attribution import sample_rows
from waitline.operators.treeshap import explain
from waitline.session import scratch_path, shared_dir, written
from waitline.sources.tables import log_runs

CATEGORICAL = "language_dominant"
MISSING = -1.0

# The tunable names and their defaults.
DEFAULT_PARAMS = {
    "num_leaves": 31, "learning_rate": 0.05, "n_estimators": 200, "min_child_samples": 10,
    "feature_fraction": 0.9, "bagging_fraction": 0.9,
}
# What the built-in learner has no counterpart for; refused rather than ignored.
NOT_SUPPORTED = ("lambda_l2", "bagging_freq")

# The search ranges (low, high, kind).
SEARCH_SPACE = {
    "num_leaves": (8, 128, "int"), "learning_rate": (0.01, 0.2, "log"), "n_estimators": (100, 1000, "int"),
    "min_child_samples": (10, 200, "int"), "feature_fraction": (0.5, 1.0, "uniform"),
    "bagging_fraction": (0.5, 1.0, "uniform"),
}


def check_params(params: dict) -> dict:
    idle = set(params) & set(NOT_SUPPORTED)
    if idle:
        raise KeyError(f"the built-in learner has no {sorted(idle)}")
    unknown = set(params) - set(DEFAULT_PARAMS)
    if unknown:
        raise KeyError(f"unknown params: {sorted(unknown)}")
    return {**DEFAULT_PARAMS, **params}


def fingerprint(params: dict) -> str:
    """Twelve hex digits that identify a parameter set."""
    return hashlib.sha256(json.dumps(check_params(params), sort_keys=True).encode()).hexdigest()[:12]


def numeric(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles without nulls; the categorical stays text for the indexer."""
    registry.check_hygiene(features)
    return table.withColumns({
        f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features if f != CATEGORICAL})


def learner(params: dict, seed: int, categories: int = 0) -> GBTClassifier:
    """The built-in learner grows level-wise, so the leaf budget becomes a depth.

    It resamples every round and needs as many bins as the categorical has values.
    """
    p = check_params(params)
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", seed=seed, maxBins=max(64, categories),
        maxIter=int(p["n_estimators"]), maxDepth=max(1, math.ceil(math.log2(p["num_leaves"]))), stepSize=p["learning_rate"],
        minInstancesPerNode=int(p["min_child_samples"]), subsamplingRate=p["bagging_fraction"],
        featureSubsetStrategy="all" if p["feature_fraction"] >= 1 else str(p["feature_fraction"]),
    )


def fit(train: DataFrame, features: Sequence[str], params: dict, seed: int) -> PipelineModel:
    """Fit with positives weighted by negatives / positives.

    Every tree adds to the lineage of the errors the next one is fitted on, which only a checkpoint cuts: without one a fit of
    hundreds of trees slows down and at last overflows the stack.
    """
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(train.sparkSession))
    features = list(features)
    rows = numeric(train, features)
    balance = train.agg((F.count_if(~F.col("is_slow")) / F.greatest(F.count_if("is_slow"), F.lit(1))).alias("w"))
    rows = rows.withColumn("label", F.col("is_slow").cast("double")).withColumn(
        "weight", F.when(F.col("is_slow"), balance.scalar()).otherwise(1.0))
    inputs, stages = list(features), []
    if CATEGORICAL in features:
        stages.append(StringIndexer(inputCol=CATEGORICAL, outputCol="_category", handleInvalid="keep", stringOrderType="alphabetAsc"))
        inputs[inputs.index(CATEGORICAL)] = "_category"
    # One value more: the indexer's place for what training has not seen.
    categories = rows.agg(F.count_distinct(CATEGORICAL)).first()[0] + 1 if CATEGORICAL in features else 0
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), learner(params, seed, categories)]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with ``p_hat`` and the log-odds ``margin``; the input columns stay as they were."""
    keep = [c for c in rows.columns]
    held = rows.withColumns({f"_in_{c}": F.col(c) for c in keep})
    scored = model.transform(numeric(held, features))
    return scored.select(
        *[F.col(f"_in_{c}").alias(c) for c in keep], vector_to_array("probability")[1].alias("p_hat"),
        (2.0 * vector_to_array("rawPrediction")[1]).alias("margin"), "features")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- evaluation -----------------------------------------------------------------------------------


def split_roles(table: DataFrame, settings: Settings) -> DataFrame:
    """(scenario, fold, role, id) of both scenarios, written once: folds are sensitive to the row set."""
    keys = table.select("id", "project", "created_at")
    a = splits.scenario_a(keys, settings).withColumn("scenario", F.lit("A"))
    b = splits.scenario_b(keys, settings).withColumn("scenario", F.lit("B"))
    return written(a.unionByName(b).select("scenario", "fold", "role", "id"), "roles")


def with_roles(table: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows that have a role anywhere, with the list of them as ``_roles``, written.

    All runs read it: the wide rows meet their roles once, not once per run and role.
    """
    if "_roles" in table.columns:
        return table
    lists = roles.groupBy("id").agg(F.collect_list(F.struct("scenario", "fold", "role")).alias("_roles"))
    return written(table.join(lists, "id"), "table-roles")


def in_role(table: DataFrame, scenario: str, fold: int, role: str) -> DataFrame:
    """The rows of a ``with_roles`` table that have a role in a fold, once for each time they were given it."""
    mine = F.filter("_roles", lambda r: (r["scenario"] == scenario) & (r["fold"] == fold) & (r["role"] == role))
    return table.withColumn("_mine", F.explode(mine)).drop("_roles", "_mine")


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prediction_columns(scored: DataFrame, scenario: str, fold: int, name: str, *more: str) -> DataFrame:
    return scored.select(
        F.lit(scenario).alias("scenario"), F.lit(fold).cast("long").alias("fold"), F.lit(name).alias("featureset"), "id", "project",
        "number", "created_at", "wait_h", "is_slow", "p_hat", "margin", F.col("trailing_90d_slow_rate").alias("baseline_score"),
        "is_first_here", F.col("created_hour_utc").alias("created_hour"), "diff_is_exact", *more)


def run(
    table: DataFrame, roles: DataFrame, scenario: str, fold: int, name: str, params: dict, settings: Settings,
    features: Sequence[str] | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """Fit on one split's training rows and score its test rows; predictions are written.

    ``table`` may hold its roles already, as ``with_roles`` gives it.
    """
    features = list(features or registry.FEATURE_SETS[name])
    rows = with_roles(table, roles)
    # Written, so subsampling sees one fixed layout and a refit repeats it.
    train = written(in_role(rows, scenario, fold, "train").repartition("project", "id"), "train")
    model = fit(train, features, params, settings.seed)
    scored = predict(model, in_role(rows, scenario, fold, "test"), features)
    return written(prediction_columns(scored, scenario, fold, name), "predictions"), model


def sweep(
    table: DataFrame, params: dict, settings: Settings, sets: Sequence[str] = tuple(registry.FEATURE_SETS), parallel: int = 4,
    roles: DataFrame | None = None,
) -> DataFrame:
    """Predictions of every scenario x fold x feature set, stacked and stamped with the parameters.

    Fits are independent Spark jobs, so a few are submitted side by side.  ``roles`` is ``split_roles`` unless given.
    """
    roles = split_roles(table, settings) if roles is None else roles
    rows = with_roles(table, roles)
    jobs = [(*j, n) for j in each_fold("AB", settings) for n in sets]
    with ThreadPoolExecutor(parallel) as pool:
        out = stacked(list(pool.map(lambda j: run(rows, roles, *j, params, settings)[0], jobs)))
    return out.withColumn("params", F.lit(fingerprint(params)))


def experiment(
    table: DataFrame, params: dict, settings: Settings, log: str, sets: Sequence[str] = tuple(registry.FEATURE_SETS), parallel: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Every run of the sweep, evaluated, with its provenance, appended to the log; the runs and the roles they used."""
    roles = split_roles(table, settings)
    scored = written(sweep(table, params, settings, sets, parallel, roles), "sweep")
    facts = V.provenance(table.select("id", "project", "created_at").join(roles, "id"))
    runs = written(V.evaluate(scored, [*V.RUN, "params"], settings).join(facts, ["scenario", "fold"], "left"), "runs")
    log_runs(V.log_rows(runs, "gbt"), log)
    return runs, roles


def each_fold(scenarios: Sequence[str], settings: Settings) -> list[tuple[str, int]]:
    return [(s, f) for s in scenarios for f in range(1 if s == "A" else settings.folds)]


def explained_runs(
    table: DataFrame, params: dict, settings: Settings, name: str = "FULL", scenarios: Sequence[str] = ("A", "B"), sample: int | None = None,
    roles: DataFrame | None = None, parallel: int = 4,
) -> DataFrame:
    """Predictions of every fold, each row with ``base`` and ``contributions`` of the model that held it out.

    All test rows, or at most ``sample`` of a fold by hash order.  Scores and attributions come from one model each.
    """
    roles, features = split_roles(table, settings) if roles is None else roles, list(registry.FEATURE_SETS[name])
    dealt = with_roles(table, roles)

    def one(job: tuple[str, int]) -> DataFrame:
        scenario, fold = job
        _, model = run(dealt, roles, scenario, fold, name, params, settings)
        held = lambda r: (r["scenario"] == scenario) & (r["fold"] == fold) & (r["role"] == "test")
        rows = dealt.where(F.exists("_roles", held)).drop("_roles")
        scored = predict(model, rows if sample is None else sample_rows(rows, sample, settings.seed), features)
        return explain(model, prediction_columns(scored, scenario, fold, name, "features"))

    with ThreadPoolExecutor(parallel) as pool:
        return stacked(list(pool.map(one, each_fold(scenarios, settings))))


def explain_scenario(
    table: DataFrame, params: dict, settings: Settings, scenario: str = "B", name: str = "FULL", sample: int = 5000,
) -> DataFrame:
    """(id, contributions) of a scenario's test rows, at most ``sample`` of a fold, each fold explained by its own model."""
    return explained_runs(table, params, settings, name, [scenario], sample).select("id", "contributions")


def without_project(table: DataFrame, params: dict, settings: Settings, roles: DataFrame | None = None) -> DataFrame:
    """The intervention: the same folds without label replay and project snapshots."""
    roles, columns = split_roles(table, settings) if roles is None else roles, registry.no_project_columns()
    rows = with_roles(table, roles)
    with ThreadPoolExecutor(4) as pool:
        return stacked(list(pool.map(
            lambda j: run(rows, roles, *j, "NLR_NO_PROJECT", params, settings, columns)[0], each_fold("AB", settings))))


def refit_delta(table: DataFrame, params: dict, settings: Settings, name: str = "FULL") -> DataFrame:
    """One row: AP of a second fit minus AP of the first on scenario A."""
    roles = split_roles(table, settings)
    rows = with_roles(table, roles)
    first, again = (M.average_precision(run(rows, roles, "A", 0, name, params, settings)[0]) for _ in range(2))
    return first.select((again.scalar() - F.col("auc_pr")).alias("delta"))


def cv_score(train: DataFrame, params: dict, settings: Settings, features: Sequence[str], k: int = 3) -> DataFrame:
    """(fold, auc_pr) over expanding time windows of the training rows."""
    return window_scores(*time_windows(train, settings, k), params, settings, features, k)


def time_windows(train: DataFrame, settings: Settings, k: int) -> tuple[DataFrame, Row]:
    """The training rows by time fold, written, with the start and the size of a fold."""
    folded = written(splits.time_folds(train, k, settings), "time-folds")
    return folded, folded.where("valid_fold = 0").agg(F.min("position").alias("s"), F.count(F.lit(1)).alias("n")).first()


def window_scores(folded: DataFrame, size: Row, params: dict, settings: Settings, features: Sequence[str], k: int) -> DataFrame:
    parts = None
    for f in range(k):
        start = size.s + f * size.n
        model = fit(folded.where(F.col("position") < start), features, params, settings.seed)
        scored = predict(model, folded.where(F.col("valid_fold") == f), features).select(F.lit(f).alias("fold"), "is_slow", "p_hat")
        parts = scored if parts is None else parts.unionByName(scored)
    return M.average_precision(parts, ["fold"])


def trial_params(spark, trials: int, seed: int) -> list[dict]:
    """Seeded random parameter sets over the search ranges; a trial's values do not depend on the others."""
    unit = lambda name: (seeded_int(seed, F.lit(name), "id") / float(2**32))
    columns = []
    for name, (lo, hi, kind) in SEARCH_SPACE.items():
        u = unit(name)
        v = F.exp(F.lit(math.log(lo)) + u * math.log(hi / lo)) if kind == "log" else F.lit(lo) + u * (hi - lo)
        columns.append((F.round(v, 0).cast("int") if kind == "int" else v).alias(name))
    return [r.asDict() for r in spark.range(trials).select(*columns).collect()]


def search(
    train: DataFrame, trials: int, settings: Settings, features: Sequence[str] = tuple(registry.FEATURE_SETS["FULL"]), k: int = 3,
    fixed: dict | None = None, parallel: int = 1,
) -> DataFrame:
    """(trial, value, params, best): mean time-ordered AP per random parameter set.

    Trials do not depend on each other: they share one written table of time folds, and a few may run side by side.
    """
    spark = train.sparkSession
    windows = time_windows(train, settings, k)

    def tried(p: dict) -> tuple[float, str]:
        p = {**p, **(fixed or {})}
        value = window_scores(*windows, p, settings, features, k).agg(F.avg("auc_pr").alias("v")).first().v
        return value, json.dumps(check_params(p), sort_keys=True)

    with ThreadPoolExecutor(parallel) as pool:
        rows = [(i, *found) for i, found in enumerate(pool.map(tried, trial_params(spark, trials, settings.seed)))]
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "trial int, value double, params string, best boolean")


def best_params(found: DataFrame) -> dict:
    """Parameters of the best trial of a search."""
    return json.loads(found.where("best").first().params)


def training_rows(table: DataFrame, settings: Settings) -> DataFrame:
    return splits.cap_per_project(table.where(F.col("created_at") < instant(settings.cutoff)), settings)
