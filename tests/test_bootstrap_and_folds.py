"""Balanced folds by run lengths and the paired bootstrap by blocks of scores, against their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitline.functions import ordered
from waitline.operators import hypothesis, splits


def one_by_one(sizes, k):
    """name -> fold: largest first, the last name of equal sizes first, each to the lightest fold."""
    loads, out = [0] * k, {}
    for n, name in sorted(((n, name) for name, n in sizes.items()), reverse=True):
        fold = loads.index(min(loads))
        loads[fold] += n
        out[name] = fold
    return out


@pytest.mark.parametrize("seed", range(8))
def test_run_lengths_place_like_one_by_one(seed):
    r = random.Random(seed)
    sizes = {f"g{i:03}": r.choice([1, 1, 1, 2, 3, 7, 50, 1000][seed % 3:]) for i in range(r.randint(1, 120))}
    k, loads = r.randint(2, 6), None
    runs = {}
    for n in sizes.values():
        runs[n] = runs.get(n, 0) + 1
    for n, before, got in splits.lightest_first(sorted(runs.items(), reverse=True), k):
        assert sum(got) == runs[n] and (loads is None or before == loads)
        loads = [a + b * n for a, b in zip(before, got, strict=True)]
    want = [0] * k
    for name, fold in one_by_one(sizes, k).items():
        want[fold] += sizes[name]
    assert loads == want


@pytest.mark.parametrize("seed", [1, 2])
def test_group_folds_equal_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    sizes = {f"{r.choice('abc')}{i:03}": r.choice([1, 1, 2, 2, 5, 30]) for i in range(80)}
    rows = spark.createDataFrame([(name,) for name, n in sizes.items() for _ in range(n)], "project string")
    got = {x.project: x for x in splits.group_folds(rows, 5).collect()}
    assert {p: x.fold for p, x in got.items()} == one_by_one(sizes, 5) and all(got[p].n == n for p, n in sizes.items())


def test_a_million_equal_groups_are_dealt_evenly(spark):
    rows = spark.range(1_000_000).select(F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("project"))
    n = {x.fold: x["count"] for x in splits.group_folds(rows, 5).groupBy("fold").count().collect()}
    assert n == dict.fromkeys(range(5), 200_000)


def test_quantile_buckets_follow_the_values(spark):
    """All scores in one thousandth of the axis: no bucket holds more than twice its share, and order is kept."""
    r = random.Random(4)
    rows = [("k" if i % 3 else None, 0.5 + r.random() / 1000) for i in range(30_000)] + [("k", None), ("one", 0.25)]
    got = ordered.quantile_buckets(spark.createDataFrame(rows, "key string, score double"), ["key"], "score", 64, "b").toPandas()
    assert len(got) == len(rows) and (got[got.score.isna()].b == -1).all()
    for key in ("k", None):
        mine = got[(got.key.isna() if key is None else got.key == key) & got.score.notna()].sort_values("score")
        assert mine.b.is_monotonic_increasing and mine.b.value_counts().max() <= 2 * len(mine) / 64 and mine.b.nunique() > 55


def weighted_ap(score, y, w):
    total, ap, pos, n = (w * y).sum(), 0.0, 0, 0
    for s in sorted(set(score), reverse=True):
        at = score == s
        gained = (w * y)[at].sum()
        pos, n = pos + gained, n + w[at].sum()
        ap += gained * pos / n if n else 0
    return ap / total if 0 < total < w.sum() else None


def test_drawn_precision_equals_each_draw_alone(spark):
    r, draws = random.Random(8), 30
    rows = [(s, f, m, f"p{r.randint(0, 9)}", round(r.random(), 2), r.random() < 0.3)
            for s in "AB" for f in range(2) for m in ("new", "old") for _ in range(400)]
    rows += [("A", 5, "new", "p1", 0.5, True), ("A", 6, "new", "p1", 0.5, False)]
    weights = {(d, f"p{p}"): 1 if d < 0 else r.choice([0, 0, 1, 2, 3]) for d in range(-1, draws) for p in range(10)}
    table = spark.createDataFrame([(d, p, w) for (d, p), w in weights.items() if w], "draw int, project string, weight long")
    frame = spark.createDataFrame(rows, "scenario string, fold long, model string, project string, score double, is_slow boolean")
    got = {(x.scenario, x.fold, x.model, x.draw): x.ap for x in hypothesis.drawn_precision(frame, table, draws).collect()}
    want = {}
    for key in {x[:3] for x in rows}:
        mine = [x for x in rows if x[:3] == key]
        score, y = np.array([x[4] for x in mine]), np.array([x[5] for x in mine], float)
        for d in range(-1, draws):
            ap = weighted_ap(score, y, np.array([weights[d, x[3]] for x in mine], float))
            if ap is not None:
                want[(*key, d)] = ap
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_identical_models_give_zero_in_every_draw(spark):
    r = random.Random(2)
    rows = [(s, i % 2, f"p{i % 7}", r.random() < 0.4, p, p, r.random()) for i in range(300) for s, p in [("A", r.random()), ("B", r.random())]]
    frame = spark.createDataFrame(rows, "scenario string, fold long, project string, is_slow boolean, p_nlr double, p_no_project double, contrib double")
    out = hypothesis.paired_bootstrap(frame, 200, 3).first()
    assert out.I == out.I_lo == out.I_hi == 0.0
