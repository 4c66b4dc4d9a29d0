"""Reports over fitted models: which model explains a row, what the extract shows, what the paired test reads."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from waitline import registry
from waitline.operators import hypothesis as X
from waitline.operators import model as Mo
from waitline.operators import triage as T
from waitline.plans import q_model as q

FULL = registry.FEATURE_SETS["FULL"]


@pytest.fixture(scope="module")
def fitted(spark):
    return q.FittedTables(spark, SF)


def test_every_row_is_explained_by_the_model_that_held_it_out(spark, fitted):
    rows = fitted.explained().collect()
    table = {r.id for r in q.table(spark, SF).collect()}
    assert sorted(r.id for r in rows if r.scenario == "B") == sorted(table)
    base = {}
    for r in rows:
        base.setdefault((r.scenario, r.fold), set()).add(r.base)
        assert r.base + sum(r.contributions) == pytest.approx(math.log(r.p_hat / (1 - r.p_hat)), abs=1e-6)
        assert len(r.contributions) == len(FULL)
    assert all(len(v) == 1 for v in base.values()) and len(base) == 1 + q.DATA.folds
    assert len(set().union(*base.values())) > 1  # not one model for all
    assert {r.n for r in T.logit_problems(fitted.explained()).collect()} == {0}
    moved = fitted.explained().withColumn("base", F.when(F.col("scenario") == "A", F.col("base") + 0.01).otherwise(F.col("base")))
    off = {r.check: r.n for r in T.logit_problems(moved).collect()}
    assert off == {"logit A": sum(r.scenario == "A" for r in rows), "logit B": 0}


def test_extract_shows_values_pushes_and_drivers(spark, fitted):
    table = q.table(spark, SF)
    e = T.serving_table(fitted.explained(), fitted.subjects(), fitted.labels(), table, FULL)
    assert [c for c in e.columns if c.startswith("x__")] == [f"x__{f}" for f in FULL]
    assert len(e.columns) == 17 + 3 * len(FULL)
    held = {(r.scenario, r.id): r for r in fitted.explained().collect()}
    known = {r.id: r for r in table.collect()}
    got = e.collect()
    assert sorted(r.id for r in got) == sorted(i for s, i in held if s == "A")
    for r in got:
        for side in "ab":
            h = held[side.upper(), r.id]
            assert r[f"score_{side}"] == h.p_hat and r[f"base_{side}"] == h.base
            assert np.allclose([r[f"push_{side}__{f}"] for f in FULL], h.contributions, atol=1e-6)
            top = sorted(range(len(FULL)), key=lambda i: (-abs(h.contributions[i]), i))[:3]
            texts = r[f"drivers_{side}"].split(" · ")
            assert [t.split(" = ")[0] for t in texts] == [FULL[i].replace("_", " ") for i in top]
            assert [t[-1] for t in texts] == ["↑" if h.contributions[i] > 0 else "↓" for i in top]
        assert r.fold_b == held["B", r.id].fold and all(r[f"x__{f}"] == known[r.id][f] for f in FULL)


def test_driver_text(spark):
    row = spark.createDataFrame(
        [([0.5, -2.0, 0.5, 0.0], True, 0.255, 1234, "Go"), ([0.0, 0.0, 0.0, 0.1], None, None, None, None)],
        "c array<double>, is_weekend boolean, prior_merge_rate_here double, body_len int, language_dominant string")
    names = ["is_weekend", "prior_merge_rate_here", "body_len", "language_dominant"]
    got = [r[0] for r in row.select(T.driver_text("c", names, {"body_len": "length"})).collect()]
    assert got == ["prior merge rate here = 0.26 ↓ · is weekend = yes ↑ · length = 1,234 ↑",
                   "language dominant = missing ↑ · is weekend = missing ↓ · prior merge rate here = missing ↓"]


def test_rows_without_a_partner_stay_and_are_counted(spark, fitted):
    some = fitted.explained().where("scenario = 'A'")
    lost = some.first().id
    cut = fitted.explained().where((F.col("scenario") == "A") | (F.col("id") != lost))
    table = q.table(spark, SF)
    e = T.serving_table(cut, fitted.subjects().where(F.col("id") != lost), fitted.labels(), table, FULL)
    folds = q.group_folds(table, q.DATA.folds)
    assert {r.check: r.n for r in T.extract_problems(e, folds, ["number", "score_a", "score_b", "drivers_b"]).collect()} == {
        "missing number": 1, "missing score_a": 0, "missing score_b": 1, "missing drivers_b": 1, "wrong fold": 1, "repeated id": 0}


def test_paired_rows_carry_what_project_features_push(fitted):
    names = registry.FEATURE_SETS["NO_LABEL_REPLAY"]
    old, new = fitted.explained_without_replay(), fitted.intervention()
    at = [names.index(f) for f in registry.PROJECT_FEATURES]
    first = {(r.scenario, r.fold, r.id): r for r in old.collect()}
    second = {(r.scenario, r.fold, r.id): r.p_hat for r in new.collect()}
    rows = X.intervention_rows(old, new, names).collect()
    assert len(rows) == len(first) == len(second)
    for r in rows:
        k = (r.scenario, r.fold, r.id)
        assert (r.p_nlr, r.p_no_project) == (first[k].p_hat, second[k])
        assert r.contrib == pytest.approx(sum(first[k].contributions[i] for i in at), abs=1e-12)
    assert {r.featureset for r in new.select("featureset").distinct().collect()} == {"NLR_NO_PROJECT"}


def test_samples_of_a_fold_are_explained_alone(spark, fitted):
    got = Mo.explain_scenario(q.table(spark, SF), q.SWEEP, q.DATA, "A", sample=7).collect()
    whole = {r.id: r.contributions for r in fitted.explained().where("scenario = 'A'").collect()}
    assert len(got) == 7 and all(np.allclose(r.contributions, whole[r.id], atol=1e-9) for r in got)
