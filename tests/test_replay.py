import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from waitline.conf import Settings
from waitline.operators import replay as R

HIST = ("project string, id string, actor_login string, created_at timestamp, closed_at timestamp, merged_at timestamp")
LAB = "id string, first_event_at timestamp, is_slow boolean"
PROBE = "probe_id string, project string, at timestamp, actor_login string"
d = lambda text: at(text + "T00:00:00")


def toy(spark):
    hist = spark.createDataFrame([
        ("p", "P0", "u0", d("2023-06-01"), d("2024-06-01"), d("2024-06-01")),
        ("p", "P1", "u1", d("2024-03-01"), None, None),
        ("p", "P2", "u2", d("2024-03-10"), d("2024-03-20"), d("2024-03-20")),
        ("p", "P3", "u1", d("2024-04-15"), None, None),
        ("p", "P4", "u3", d("2024-04-19"), None, None)], HIST)
    lab = spark.createDataFrame([
        ("P1", d("2024-03-02"), False), ("P2", None, True), ("P3", d("2024-04-16"), False), ("P4", None, True)], LAB)
    return hist, lab


def ask(spark, probes, **changes):
    rows = spark.createDataFrame(probes, PROBE)
    out = R.features_at(*toy(spark), rows, Settings().but(**changes), 0.5, 0.4)
    return {r.probe_id: r.asDict() for r in out.collect()}


@pytest.mark.parametrize("days", [1, 7, 400])
def test_worked_example(spark, days):
    t = d("2024-04-21")
    got = ask(spark, [("u1", "p", t, "u1"), ("u2", "p", t, "u2"), ("u0", "p", t, "u0"), ("new", "p", t, "nobody"), ("gone", "p", t, None),
                      ("early", "p", d("2024-02-01"), "u1")], bucket_days=days, actor_bucket_days=days)
    a = got["u1"]
    assert (a["open_backlog_at_t"], a["trailing_n"], a["opened_trailing_7d"], a["trailing_window_complete"]) == (4, 3, 2, True)
    assert a["trailing_90d_slow_rate"] == pytest.approx(0.4375)
    assert (a["n_prior_here"], a["n_prior_merged_here"], a["days_since_first_here"], a["actor_prior_n"]) == (2, 0, 51.0, 2)
    assert a["prior_merge_rate_here"] == pytest.approx(2 / 7) and a["actor_prior_slow_rate_here"] == pytest.approx(2.5 / 7)
    b = got["u2"]
    assert (b["n_prior_here"], b["n_prior_merged_here"], b["days_since_first_here"]) == (1, 1, 42.0)
    assert b["prior_merge_rate_here"] == pytest.approx(0.5) and b["actor_prior_slow_rate_here"] == pytest.approx(3.5 / 6)
    c = got["u0"]
    assert (c["n_prior_here"], c["n_prior_merged_here"], c["days_since_first_here"], c["actor_prior_n"]) == (1, 0, 325.0, 0)
    for k in ("new", "gone"):
        assert got[k]["is_first_here"] and got[k]["days_since_first_here"] is None and got[k]["actor_prior_slow_rate_here"] == 0.5
    e = got["early"]
    assert (e["open_backlog_at_t"], e["trailing_n"], e["trailing_90d_slow_rate"], e["trailing_window_complete"]) == (1, 0, 0.5, False)


def test_a_row_is_invisible_at_its_own_instant(spark):
    t = d("2024-04-15")
    got = ask(spark, [("same", "p", t, None), ("next", "p", at("2024-04-15T00:00:01"), None)])
    assert got["next"]["open_backlog_at_t"] == got["same"]["open_backlog_at_t"] + 1


def test_label_becomes_usable_when_resolved(spark):
    got = ask(spark, [("before", "p", at("2024-04-15T12:00:00"), None), ("after", "p", d("2024-04-17"), None)])
    assert got["after"]["trailing_n"] == got["before"]["trailing_n"] + 1


def random_frames(spark, seed, n=250):
    rng = random.Random(seed)
    base = at("2024-02-01T00:00:00")
    from datetime import timedelta

    hist, lab, probes = [], [], []
    for i in range(n):
        # Two thirds of the rows share one project and one actor; half-day times make many ties.
        project = "hot" if rng.random() < 0.66 else rng.choice("ab")
        actor = rng.choice(["big", "big", "x", "y", None])
        born = base + timedelta(hours=12 * rng.randrange(400))
        closed = None if rng.random() < 0.4 else born + timedelta(hours=12 * rng.randrange(60))
        hist.append((project, f"h{i}", actor, born, closed, closed if rng.random() < 0.5 else None))
        if rng.random() < 0.8:
            first = None if rng.random() < 0.3 else born + timedelta(hours=12 * rng.randrange(40))
            lab.append((f"h{i}", first, first is None or rng.random() < 0.5))
        probes.append((f"q{i}", rng.choice(["hot", "a", "b", "none"]), base + timedelta(hours=12 * rng.randrange(420)), rng.choice(["big", "x", None])))
    return spark.createDataFrame(hist, HIST), spark.createDataFrame(lab, LAB), spark.createDataFrame(probes, PROBE)


def rows_of(df):
    cols = ["probe_id", *R.REPLAY_COLUMNS]
    return {r.probe_id: tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(cols).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_on_skewed_ties(spark, seed):
    h, l, p = random_frames(spark, seed)
    s = Settings().but(bucket_days=3, actor_bucket_days=20)
    fast = rows_of(R.features_at(h, l, p, s, 0.3, 0.2))
    assert len(fast) == 250
    assert fast == rows_of(R.brute_force_features(h, l, p, s, 0.3, 0.2))


def test_does_not_depend_on_partitioning(spark):
    h, l, p = random_frames(spark, 3)
    got = []
    for n in (1, 8, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got.append(rows_of(R.features_at(h.repartition(n), l, p, Settings(), 0.3, 0.2)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_replay_plan_has_no_pairwise_join(spark):
    h, l, p = random_frames(spark, 4, 20)
    plan = R.features_at(h, l, p, Settings(), 0.3, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def audit(spark, monkeypatch=None, change=None):
    hist, lab = toy(spark)
    t = d("2024-04-21")
    probes = spark.createDataFrame([("a", "p", t, None), ("b", "p", d("2024-03-15"), None), ("c", "other", t, None)], PROBE)
    if change:
        real = R.project_features_at
        monkeypatch.setattr(R, "project_features_at", lambda *a: change(real(*a)))
    return R.replay_audit(hist, lab, probes, Settings(), 0.5, 7).first()


def test_audit_passes_on_the_replay(spark):
    r = audit(spark)
    assert (r.n, r.max_abs_diff_backlog, r["pass"]) == (3, 0, True) and r.max_abs_diff_rate < 1e-12


RATE, BACKLOG = "trailing_90d_slow_rate", "open_backlog_at_t"


@pytest.mark.parametrize("change", [
    lambda df: df.withColumn(RATE, F.col(RATE) + F.when(F.col("probe_id") == "b", 1e-6).otherwise(0)),
    lambda df: df.withColumn(BACKLOG, F.col(BACKLOG) + F.when(F.col("probe_id") == "a", 1).otherwise(0)),
    lambda df: df.where("probe_id <> 'c'"),
    lambda df: df.withColumn(RATE, F.when(F.col("probe_id") != "a", F.col(RATE))),
])
def test_audit_fails_on_any_wrong_missing_or_null_value(spark, monkeypatch, change):
    assert audit(spark, monkeypatch, change)["pass"] is False


def test_actors_with_few_rows_move_once(spark):
    h, l, p = random_frames(spark, 5, 60)
    plan = R.features_at(h, l, p, Settings(), 0.3, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(project#" in x and "actor_key#" in x]) == 1


def test_crowded_actors_run_in_two_levels_with_the_same_values(spark, monkeypatch):
    h, l, p = random_frames(spark, 6)
    nowhere = spark.createDataFrame([(f"n{i}", None, at("2024-04-01T00:00:00"), "big") for i in range(40)], PROBE)
    asked, s = p.unionByName(nowhere), Settings().but(actor_bucket_days=20)
    want = rows_of(R.features_at(h, l, asked, s, 0.3, 0.2))
    ran, real = [], R.running_totals
    monkeypatch.setattr(R, "running_totals", lambda df, keys, *a, **k: ran.append(list(keys)) or real(df, keys, *a, **k))
    monkeypatch.setattr(R, "CROWD", 30)
    assert rows_of(R.features_at(h, l, asked, s, 0.3, 0.2)) == want and len(want) == 290
    assert ["project", "actor_key"] in ran
