import itertools
import math
import random

import numpy as np
import pytest
from conftest import SF, at
from pyspark.sql import functions as F

from waitline import registry
from waitline.operators import metrics as M
from waitline.operators import model as Mo
from waitline.operators import treeshap as T
from waitline.operators import triage as D
from waitline.operators.attribution import additivity_gap
from waitline.plans.bindings import SETTINGS_T, OrderTables

PARAMS = {"n_estimators": 3, "num_leaves": 8, "learning_rate": 0.3, "feature_fraction": 1.0, "bagging_fraction": 1.0}
COLS = ["body_len", "trailing_90d_slow_rate", "language_dominant", "days_since_first_here"]


@pytest.fixture(scope="module")
def fitted(spark):
    # The outcome follows one feature plainly, so a working fit must find it.
    table = OrderTables(spark, SF).feature_table().withColumn("is_slow", F.col("trailing_90d_slow_rate") > 0.8).cache()
    return table, Mo.fit(table, COLS, PARAMS, 1)


def test_fit_finds_the_signal_and_repeats(spark, fitted):
    table, model = fitted
    scored = Mo.predict(model, table, COLS)
    assert M.average_precision(scored).first().auc_pr > table.agg(F.avg(F.col("is_slow").cast("int"))).first()[0] + 0.1
    again = Mo.predict(Mo.fit(table, COLS, PARAMS, 1), table, COLS)
    a = {r.id: r.p_hat for r in scored.select("id", "p_hat").collect()}
    assert a == {r.id: r.p_hat for r in again.select("id", "p_hat").collect()}


def test_unknown_parameter_is_refused():
    with pytest.raises(KeyError, match="depth"):
        Mo.check_params({"depth": 3})
    assert len(Mo.fingerprint({})) == 12 and Mo.fingerprint({}) != Mo.fingerprint({"num_leaves": 5})


def test_attribution_adds_up_to_the_log_odds(spark, fitted):
    table, model = fitted
    e = T.explain(model, Mo.predict(model, table, COLS).select("id", "p_hat", "margin", "features"))
    assert additivity_gap(e).first().gap < 1e-9
    assert D.logit_gap(e.withColumn("score", F.col("p_hat"))).first().gap < 1e-9


def random_trees(r, trees, depth, features, kinds):
    """Flat arrays of random trees; features repeat on paths, one is categorical."""
    left, right, feature, threshold, categories, value, cover, root = [], [], [], [], [], [], [], []

    def grow(d, n):
        at = len(left)
        for a, v in ((left, -1), (right, -1), (feature, -1), (threshold, math.nan), (categories, None), (value, r.uniform(-2, 2)), (cover, float(n))):
            a.append(v)
        if d and n > 1 and r.random() < 0.9:
            feature[at] = r.randrange(features)
            if feature[at] == 0:
                categories[at] = np.array(r.sample(range(kinds), r.randint(1, kinds - 1)), float)
            else:
                threshold[at] = r.choice([-0.5, 0.0, 0.5])
            less = r.randint(1, n - 1)
            left[at], right[at] = grow(d - 1, less), grow(d - 1, n - less)
        return at

    for _ in range(trees):
        root.append(grow(depth, 100))
    return T.Trees(*map(np.array, (root, left, right, feature, threshold)), categories, np.array(value), np.array(cover))


@pytest.mark.parametrize("seed", range(6))
def test_attribution_equals_enumeration_of_coalitions(seed):
    """Path-dependent Shapley values by brute force over subsets of four features."""
    r, n = random.Random(seed), 4
    trees = random_trees(r, 3, 5, n, 3)
    rows = np.array([[r.randrange(3), *(r.choice([-1.0, -0.5, 0.2, 0.5, 0.7]) for _ in range(n - 1))] for _ in range(7)])

    def value(known, row, at):
        if trees.left[at] < 0:
            return trees.value[at]
        f, cats, kids = trees.feature[at], trees.categories[at], (trees.left[at], trees.right[at])
        if f in known:
            goes = row[f] in cats if cats is not None else row[f] <= trees.threshold[at]
            return value(known, row, kids[0] if goes else kids[1])
        return sum(trees.cover[k] / trees.cover[at] * value(known, row, k) for k in kids)

    got = T.attribute(rows, trees)
    assert T.base_value(trees) == pytest.approx(sum(value(set(), rows[0], k) for k in trees.root))
    for at, row in enumerate(rows):
        whole = lambda known: sum(value(known, row, k) for k in trees.root)  # noqa: E731, B023
        for i in range(n):
            others, want = [j for j in range(n) if j != i], 0.0
            for k in range(n):
                for s in itertools.combinations(others, k):
                    want += math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (whole({*s, i}) - whole(set(s)))
            assert got[at, i] == pytest.approx(want)


TRI = "project string, id string, number long, created_at timestamp, closed_at timestamp, first_response_at timestamp, p_hat double, is_slow boolean, url string, title string"


def triage(spark):
    t = lambda h: at("2026-03-10T00:00:00", hours=h)
    return spark.createDataFrame([
        ("p", "a", 1, t(-10), None, None, 0.5, True, "", ""), ("p", "b", 2, t(-20), None, t(5), 0.9, False, "", ""),
        ("p", "c", 3, t(0), None, None, 0.9, True, "", ""), ("p", "d", 4, t(-5), t(0), None, 0.9, True, "", ""),
        ("p", "e", 5, t(-5), None, t(0), 0.9, False, "", ""), ("p", "f", 6, t(-20), None, None, 0.9, True, "", "")], TRI)


def test_waiting_boundaries_and_rank(spark):
    moment = F.lit(at("2026-03-10T00:00:00"))
    rows = D.ranked(triage(spark), moment).orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "f", "a"]
    assert D.tally(triage(spark), moment, 2).first().stalled == 1


def test_hit_rate_equals_enumeration_of_rounds(spark):
    week0 = [("s1", 1, 0.5, True), ("s2", 2, 0.3, True), ("f1", 3, 0.5, False), ("f2", 4, 0.2, False), ("f3", 5, 0.3, False), ("f4", 6, 0.1, False)]
    week1 = [("s3", 7, 0.1, True), ("g1", 8, 0.0, False), ("g2", 9, 0.1, False), ("g3", 10, 0.05, False)]
    rows = []
    for k, group in enumerate((week0, week1)):
        for i, n, score, slow in group:
            rows.append(("p", i, n, at("2026-03-09T12:00:00", days=7 * k), None, None, score, slow, "", ""))
    rates = []
    for group in (week0, week1):
        wins = []
        for s in (g for g in group if g[3]):
            rounds = list(itertools.combinations([g for g in group if not g[3]], 3))
            best = [max([s, *r], key=lambda g: (g[2], -g[1])) is s for r in rounds]
            wins.append(sum(best) / len(best))
        rates.append(sum(wins) / len(wins))
    r = D.game_hit_rate(spark.createDataFrame(rows, TRI)).first()
    assert r.n_groups == 2 and r.hit_rate == pytest.approx(sum(rates) / 2)


def test_wide_rows_meet_their_roles_once(spark):
    """Every run reads the same written rows and shuffles none of them; repeated ids come as often as a join gives them."""
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "id string, n int")
    given = [("A", 0, "train", "a"), ("A", 0, "train", "a"), ("B", 1, "test", "a"), ("A", 0, "test", "b"), ("A", 0, "test", None)]
    roles = spark.createDataFrame(given, "scenario string, fold long, role string, id string")
    held = Mo.with_roles(table, roles)
    assert Mo.with_roles(held, roles) is held
    for s, f, role in [("A", 0, "train"), ("A", 0, "test"), ("B", 1, "test"), ("B", 1, "train")]:
        want = table.join(roles.where((F.col("scenario") == s) & (F.col("fold") == f) & (F.col("role") == role)).select("id"), "id")
        got = Mo.in_role(held, s, f, role)
        assert got.columns == table.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
