import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from waitline.conf import Settings
from waitline.functions.ordered import average_ranks, exact_quantiles, row_numbers, score_bucket
from waitline.operators import attribution as A
from waitline.operators import bootstrap as B
from waitline.operators import eda as E
from waitline.operators import evaluation as V
from waitline.operators import hypothesis as X
from waitline.operators import metrics as M
from waitline.operators import splits as S
from waitline.sources.tables import log_runs, read_log

SCORED = "id string, project string, is_slow boolean, p_hat double"


def scored(spark, rows):
    return spark.createDataFrame([(str(i), p, bool(y), float(s)) for i, (p, y, s) in enumerate(rows)], SCORED)


def ap_by_hand(pairs):
    """Average precision straight from its definition: one threshold per distinct score."""
    total, out, last = sum(y for y, _ in pairs), 0.0, 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        above = [y for y, s in pairs if s >= t]
        recall = sum(above) / total
        out += (recall - last) * sum(above) / len(above)
        last = recall
    return out


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_average_precision_with_ties(spark, buckets):
    rng = random.Random(5)
    pairs = [(rng.random() < 0.4, rng.randrange(20) / 20) for _ in range(300)]
    df = scored(spark, [("p", y, s) for y, s in pairs])
    got = M.average_precision(df, bucket=score_bucket(F.col("p_hat"), 0.2, 0.8, buckets)).first().auc_pr
    assert got == pytest.approx(ap_by_hand(pairs))


def test_average_precision_differs_from_trapezoid(spark):
    df = scored(spark, [("p", 0, 0.9), ("p", 1, 0.8), ("p", 0, 0.7), ("p", 1, 0.6)])
    assert M.average_precision(df).first().auc_pr == pytest.approx(0.5)


def test_precision_at_k(spark):
    df = scored(spark, [("p", 1, 1.0)] * 10 + [("p", 0, 0.5)] * 5)
    assert M.precision_at_k(df, [], 1).first().precision_at_k == 1.0
    few = scored(spark, [("p", 1, 0.9), ("p", 0, 0.8), ("p", 1, 0.1), ("p", 0, 0.2)])
    assert M.precision_at_k(few, [], 1).first().precision_at_k == 0.5
    two = scored(spark, [("a", 1, 0.9)] * 10 + [("b", 0, 0.9)] * 100)
    assert M.precision_at_k(two, [], 1).first().precision_at_k == 0.5


def test_constant_score_is_a_seeded_draw(spark):
    df = scored(spark, [("p", i % 2, 0.5) for i in range(200)])
    got = {M.precision_at_k(df, [], seed).first().precision_at_k for seed in range(6)}
    assert len(got) > 1


def test_top_k_is_cut_before_the_shuffle(spark):
    df = scored(spark, [("p", 1, 0.5)] * 50)
    plan = M.precision_per_project(df, [], 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_cluster_bootstrap(spark):
    flat = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", 0.3)], "project string, v double")
    r = B.cluster_bootstrap(flat, [], "v", 1, 200).first()
    assert (r.ci_lo, r.ci_hi) == (pytest.approx(0.3), pytest.approx(0.3))
    line = spark.createDataFrame([(f"g{i}", i / 29) for i in range(30)], "project string, v double")
    r = B.cluster_bootstrap(line, [], "v", 1, 500).first()
    assert r.ci_lo < 0.5 < r.ci_hi
    assert r == B.cluster_bootstrap(line.repartition(7), [], "v", 1, 500).first()


def test_draws_have_constant_size(spark):
    g = spark.createDataFrame([(f"g{i}",) for i in range(9)], "project string")
    sizes = B.draw_weights(g, [], 50, 3).groupBy("draw").agg(F.sum("weight").alias("w")).collect()
    assert len(sizes) == 50 and {r.w for r in sizes} == {9}


def test_group_folds_balance_and_cover(spark):
    rows = spark.createDataFrame([(f"p{i}", j) for i in range(12) for j in range(5 * (i + 1))], "project string, id int")
    folds = S.group_folds(rows, 5).collect()
    assert {r.project for r in folds} == {f"p{i}" for i in range(12)} and {r.fold for r in folds} == set(range(5))
    load = [sum(r.n for r in folds if r.fold == k) for k in range(5)]
    assert max(load) - min(load) <= 60


def test_cap_is_a_share_of_the_uncapped_total(spark):
    rows = spark.createDataFrame([("big", str(i)) for i in range(400)] + [("small", f"s{i}") for i in range(40)], "project string, id string")
    got = {r.project: r["count"] for r in S.cap_per_project(rows, Settings()).groupBy("project").count().collect()}
    assert got == {"big": 22, "small": 22}


def test_quantiles_ranks_and_numbers_against_direct_computation(spark):
    import statistics

    rng = random.Random(9)
    values = [(rng.choice("ab"), rng.randrange(50) / 10) for _ in range(300)]
    df = spark.createDataFrame(values, "k string, v double")
    for r in exact_quantiles(df, ["k"], "v", [0.5], ["m"], score_bucket(F.col("v"), 0, 5, 16)).collect():
        assert r.m == pytest.approx(statistics.median([v for k, v in values if k == r.k]))
    for r in average_ranks(df, ["k"], "v", "rank", score_bucket(F.col("v"), 0, 5, 16)).collect():
        mine = [v for k, v in values if k == r.k]
        assert r["rank"] == pytest.approx(sum(v < r.v for v in mine) + (sum(v == r.v for v in mine) + 1) / 2)
    plain = spark.range(500).withColumn("v", F.col("id") * 7 % 500)
    numbered = row_numbers(plain, [], ["v"], F.floor(F.col("v") / 50)).collect()
    assert all(r.row_no == r.v + 1 for r in numbered)


def test_identical_scenarios_give_exactly_zero(spark):
    rng = random.Random(2)
    rows = [(str(i), f"p{i % 12}", rng.random() < 0.3 + (i % 12) / 30, rng.random(), rng.random(), (i % 12) / 10) for i in range(480)]
    one = spark.createDataFrame(rows, "id string, project string, is_slow boolean, p_nlr double, p_no_project double, contrib double")
    both = one.withColumn("scenario", F.lit("A")).unionByName(one.withColumn("scenario", F.lit("B"))).withColumn("fold", F.lit(0))
    r = X.paired_bootstrap(both, 20, 1).first()
    assert (r["T"], r.T_lo, r.T_hi, r["I"], r.I_lo, r.I_hi) == (0, 0, 0, 0, 0, 0)


def test_verdict_table_and_bounds(spark):
    cases = [(0.1, 0.2, 0.1, 0.2, "SUPPORTED"), (0.0, 0.2, 0.1, 0.2, "PARTIAL_INTERVENTION_ONLY"), (-0.2, -0.1, 0.1, 0.2, "CONFLICTING"),
             (-0.1, 0.1, -0.2, -0.1, "CONTRADICTED"), (0.0, 0.0, 0.0, 0.1, "NOT_SUPPORTED")]
    df = spark.createDataFrame(cases, "T_lo double, T_hi double, I_lo double, I_hi double, want string")
    assert all(r.verdict == r.want for r in X.verdicts(df).collect())
    broken = spark.createDataFrame([(float("nan"), 1.0, 0.0, 0.0)], "T_lo double, T_hi double, I_lo double, I_hi double")
    with pytest.raises(Exception, match="non-finite"):
        X.verdicts(broken).collect()


def test_provenance_says_what_a_split_was_trained_on(spark):
    day = lambda n: at(f"2024-03-{n:02d}T00:00:00")
    rows = spark.createDataFrame([
        ("A", 0, "train", "p", day(1)), ("A", 0, "train", "p", day(4)), ("A", 0, "train", None, day(2)), ("A", 0, "test", "p", day(9)),
        ("A", 0, "test", "q", day(7)), ("B", 1, "test", "q", day(3))], "scenario string, fold long, role string, project string, created_at timestamp")
    got = {(r.scenario, r.fold): tuple(r)[2:] for r in V.provenance(rows).collect()}
    a, b = got["A", 0], got["B", 1]
    assert a[:2] == (3, 2) and b[:3] == (0, 0, None)
    days = {r.scenario: (r.u, r.s) for r in V.provenance(rows).selectExpr("scenario", "day(train_until) as u", "day(test_from) as s").collect()}
    assert days == {"A": (4, 7), "B": (None, 3)}


RUNS = """scenario string, fold long, featureset string, params string, n_train long, n_test long, n_test_projects long, precision_at_10 double,
  p10_ci_lo double, p10_ci_hi double, base_rate_p10 double, auc_pr double, base_rate double, baseline_p10 double, baseline_auc_pr double"""


def evaluated(spark, **changes):
    row = dict(params="abc", n_train=9, n_test=4, n_test_projects=2, precision_at_10=0.5, p10_ci_lo=0.25, p10_ci_hi=0.75, base_rate_p10=0.5,
               auc_pr=0.5, base_rate=0.25, baseline_p10=0.125, baseline_auc_pr=0.375)
    rows = [dict(scenario=s, fold=0, featureset=f, **row) for s in "AB" for f in ("FULL", "NO_LABEL_REPLAY")]
    rows[0].update(changes)
    names = [c.split()[0] for c in RUNS.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RUNS)


def test_runs_are_logged_as_they_are(spark, tmp_path):
    runs = evaluated(spark, auc_pr=0.875)
    log_runs(V.log_rows(runs, "gbt"), str(tmp_path / "log"))
    got = {(r.scenario, r.features): r for r in read_log(spark, str(tmp_path / "log")).collect()}
    assert len(got) == 4 and got["A", "FULL"].auc_pr == 0.875
    r = got["B", "NO_LABEL_REPLAY"]
    assert (r.model, r.params, r.n_train, r.n_test, r.p10_ci_lo, r.notes) == ("gbt", "abc", 9, 4, 0.25, "baseline_p10=0.125 baseline_auc_pr=0.375")
    assert r.date is not None


@pytest.mark.parametrize("broken, failed", [
    ({}, set()), ({"leaks": 1}, {1}), ({"featureset": "FULL"}, {3}), ({"p10_ci_lo": None}, {4}), ({"p10_ci_hi": float("nan")}, {4}),
    ({"unlogged": True}, {4}), ({"refit": 1e-3}, {5})])
def test_each_broken_input_flips_only_its_check(spark, broken, failed):
    changes = {k: v for k, v in broken.items() if k.startswith("p10")}
    runs = evaluated(spark, **changes)
    logged = runs.limit(3) if broken.get("unlogged") else runs
    if "featureset" in broken:
        runs = runs.withColumn("featureset", F.when(F.col("scenario") == "A", F.lit("FULL")).otherwise(F.col("featureset")))
    leaks = spark.createDataFrame([("A", broken.get("leaks", 0)), ("B", 0)], "scenario string, leaks long")
    gate = V.run_gate(runs, leaks, logged, broken.get("refit", 0.0), 4).collect()
    assert {r.id for r in gate if not r["pass"]} == failed


def test_cohort_table_keeps_projects_without_rows_or_labels(spark):
    checked = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "project string, size_tier int")
    rows = spark.createDataFrame([("p",)] * 3 + [("q",)], "project string")
    labels = spark.createDataFrame([("p", True), ("p", False), ("r", False)], "project string, never_answered boolean")
    got = {r.project: (r.size_tier, r.row_share, r.never_answered) for r in E.cohort_table(checked, rows, labels).collect()}
    assert got == {"p": (1, 0.75, 0.5), "q": (2, 0.25, None), "r": (3, 0.0, 0.0)}


@pytest.mark.parametrize("broken, failed", [
    ({}, set()), ({"gap": 1e-3}, {1}), ({"stability": 0.5}, {2}), ({"stability": None}, {2}), ({"truth": True}, {3}), ({"drop": 1}, {3}),
    ({"gap_ci_lo": None}, {4}), ({"gap_ci_hi": float("nan")}, {4}), ({"n_projects": 1}, {4}), ({"empty": True}, {5})])
def test_each_broken_artifact_flips_only_its_check(spark, broken, failed):
    worst = spark.createDataFrame(
        [(f"{k}{i}", k == "fn", k) for k in ("fp", "fn") for i in range(2) if not (broken.get("drop") and k == "fp" and i)],
        "id string, is_slow boolean, kind string")
    scored = worst.withColumn("is_slow", F.col("is_slow") | F.lit(broken.get("truth", False)))
    slices = spark.createDataFrame([("s", 0.1, 0.2, 3)], "slice string, gap_ci_lo double, gap_ci_hi double, n_projects long")
    for c in ("gap_ci_lo", "gap_ci_hi", "n_projects"):
        if c in broken:
            slices = slices.withColumn(c, F.lit(broken[c]).cast(slices.schema[c].dataType))
    one = lambda name, v: spark.createDataFrame([(v,)], f"{name} double")
    other = slices.limit(0) if broken.get("empty") else slices
    gate = A.interpretation_gate(
        one("gap", broken.get("gap", 0.0)), one("stability", broken.get("stability", 0.95)), worst, scored, slices,
        {"worst": worst, "other": other}, n=2).collect()
    assert {r.id for r in gate if not r["pass"]} == failed


@pytest.mark.parametrize("broken, failed", [
    ({}, set()), ({"gap": 1e-3}, {1}), ({"refit": -1e-3}, {2}), ({"only_new": 1}, {3}), ({"repeated": 1}, {3}), ({"varying": 1}, {4}),
    ({"b_each_once": False}, {5}), ({"n_projects": 4}, {5}), ({"T_lo": None}, {5}), ({"I_hi": float("nan")}, {5})])
def test_each_broken_measure_flips_only_its_check(spark, broken, failed):
    has = lambda name, kind, good: F.lit(broken.get(name, good)).cast(kind).alias(name)
    one = spark.range(1)
    result = one.select(*[has(c, "double", v) for c, v in (("T_lo", 0.1), ("T_hi", 0.4), ("I_lo", 0.1), ("I_hi", 0.3))])
    same = one.select(*[has(c, "long", 0) for c in ("only_old", "only_new", "repeated")])
    cover = one.select(has("n_projects", "long", 5), has("same_projects", "boolean", True), has("b_each_once", "boolean", True))
    varying = one.select(F.lit("f").alias("feature"), F.lit(broken.get("varying", 0)).alias("n_groups"))
    gate = X.hypothesis_gate(
        result, same, cover, varying, F.lit(broken.get("gap", 0.0)), F.lit(broken.get("refit", 0.0)), 5)
    assert {r.id for r in gate.collect() if not r["pass"]} == failed
    if not failed & {5}:
        assert X.gated_verdict(result, gate).count() == (0 if failed & {1, 2} else 1)


def test_a_subset_without_any_push_has_figures_but_no_verdict(spark):
    rows = spark.range(60).selectExpr(
        "if(id % 2 = 0, 'A', 'B') as scenario", "0L as fold", "concat('p', id div 2 % 6) as project", "id % 5 < 2 as is_slow",
        "(id % 7) / 7D as p_nlr", "(id % 11) / 11D as p_no_project", "0D as contrib")
    result = X.paired_bootstrap(rows, 20, 7)
    gate = spark.createDataFrame([(1, True), (2, True), (5, False)], "id int, pass boolean")
    r = X.gated_verdict(result, gate).first()
    assert r.T_lo is None and r.dropped_T == 20 and r.I_lo <= r.I_hi and r.delta_a is not None
    assert (r.t_outcome, r.i_outcome, r.verdict) == (None, None, None)
    stopped = spark.createDataFrame([(1, False), (2, True), (5, False)], "id int, pass boolean")
    assert X.gated_verdict(result, stopped).count() == 0
