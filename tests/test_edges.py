"""Rows that the given tables do not hold: null keys and scores, odd files, long numbers, other projects in a sink."""

import json
import random

import pytest
from conftest import at
from pyspark.sql import functions as F
from test_replay import HIST, LAB, PROBE, random_frames, rows_of

from waitline import Settings
from waitline.functions.columns import format_value, nearest
from waitline.functions.ordered import average_ranks, row_numbers, running_totals, score_bucket
from waitline.operators import atopen, labels, metrics, model, replay, triage
from waitline.sources import pages, tables
from waitline.streaming import ingest


@pytest.mark.parametrize("seed", [5, 6])
def test_replay_with_null_projects_and_instants_equals_brute_force(spark, seed):
    h, l, p = random_frames(spark, seed)
    gone = F.when(F.crc32(F.col("id").cast("binary")) % 5 > 0, F.col("project"))
    h = h.withColumn("project", gone)
    p = p.withColumn("project", F.when(F.crc32(F.col("probe_id").cast("binary")) % 4 > 0, F.col("project")))
    p = p.withColumn("at", F.when(F.crc32(F.col("probe_id").cast("binary")) % 7 > 0, F.col("at")))
    fast = rows_of(replay.features_at(h, l, p, Settings(), 0.3, 0.2))
    assert len(fast) == 250 and fast == rows_of(replay.brute_force_features(h, l, p, Settings(), 0.3, 0.2))


def test_a_probe_without_project_is_a_first_subject(spark):
    h = spark.createDataFrame([(None, "h1", "u", at("2024-01-02"), None, None), (None, "h2", None, at("2024-01-03"), None, None)], HIST)
    p = spark.createDataFrame([("q", None, at("2024-02-01"), "u")], PROBE)
    r = replay.features_at(h, spark.createDataFrame([], LAB), p, Settings(), 0.3, 0.2).first()
    assert r.is_first_here and r.open_backlog_at_t == 0 and r.trailing_90d_slow_rate == 0.3


def test_two_level_helpers_keep_null_keys_and_null_values(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", None]), r.choice([0.1, 0.5, 0.9, None]), 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    ran = running_totals(df, ["k"], "v", ["n"], score_bucket(F.col("v")))
    order = lambda v: (v is not None, v or 0)
    for x in ran.collect():
        assert x.cum_n == sum(1 for k, v, _ in rows if k == x.k and order(v) <= order(x.v))
    numbered = row_numbers(df, ["k"], ["v"], score_bucket(F.col("v")), total="size").collect()
    for key in ("a", None):
        mine = sorted(x.row_no for x in numbered if x.k == key)
        assert mine == list(range(1, len(mine) + 1)) and {x["size"] for x in numbered if x.k == key} == {len(mine)}
    assert average_ranks(df, ["k"], "v", "rank").count() == 200


def test_average_precision_keeps_a_null_key_and_refuses_a_null_score(spark):
    df = spark.createDataFrame([(None, 0.9, True), (None, 0.1, False), ("a", 0.4, True)], "k string, p_hat double, is_slow boolean")
    assert {(r.k, r.auc_pr) for r in metrics.average_precision(df, ["k"]).collect()} == {(None, 1.0), ("a", 1.0)}
    assert metrics.curve(df, ["k"]).count() == 3
    with pytest.raises(Exception, match="a row has no p_hat"):
        metrics.average_precision(df.withColumn("p_hat", F.when(F.col("p_hat") > 0.3, F.col("p_hat")))).collect()


def test_rewriting_one_project_leaves_the_others(spark, tmp_path):
    df = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "c")], "project string, id string")
    tables.write_entity(df, str(tmp_path), "subjects")
    tables.write_entity(spark.createDataFrame([("p1", "z")], df.schema), str(tmp_path), "subjects")
    got = tables.load_entity(spark, str(tmp_path), "subjects", df.schema).collect()
    assert {(r.project, r.id) for r in got} == {("p1", "z"), ("p2", "b"), ("p3", "c")}


def test_files_beside_the_pages_are_passed_over(spark, tmp_path):
    folder = tmp_path / "acme__tool"
    folder.mkdir()
    (folder / "manifest.jsonl").write_text('{"tier": 1}\n')
    (folder / "tier1_00003.json").write_text("{}")
    (folder / "tier99999999999_1.json").write_text("{}")
    got = pages.read_pages(spark, str(tmp_path), r"/([^/]+)/tier(\d+)_(\d+)\.json$").collect()
    assert [(r.project, r.tier, r.page_index) for r in got if r.tier is not None] == [("acme/tool", 1, 3)]


def test_a_number_that_does_not_fit_is_no_reference(spark):
    df = spark.createDataFrame([("9" * 30,), ("acme/tool#" + "9" * 30,), ("acme/tool#12",), ("7",)], "t string")
    got = [r.r for r in df.select(triage.parse_reference("t", F.lit("home")).alias("r")).collect()]
    assert got[:2] == [None, None] and tuple(got[2]) == ("acme/tool", 12) and tuple(got[3]) == ("home", 7)


def test_rounding_is_of_the_double_itself(spark):
    values = [2.675, 1.115, 0.125, 0.375, 1.005, -2.675, 0.29, 3.0, 0.35, 0.45] + [random.Random(3).uniform(0, 50) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", format_value("v", "float", True).alias("two"), F.format_string("%.1f", nearest(F.col("v"), 1)).alias("one")).collect()
    assert all(r.two == f"{r.v:.2f}" and r.one == f"{r.v:.1f}" for r in got)


def test_missing_metadata_raises_and_rows_stay(spark):
    rows = spark.createDataFrame([("1", "p", at("2024-01-02")), ("2", "q", at("2024-01-03"))], "id string, project string, created_at timestamp")
    meta = spark.createDataFrame([("p",)], "project string")
    with pytest.raises(KeyError, match="q"):
        atopen.require_meta(rows, meta)
    full = spark.createDataFrame(
        [("p", at("2023-01-01"), 1, 2, "User", True, True, False, 3, "Go")],
        "project string, created_at timestamp, n_assignable_users int, n_mentionable_users int, owner_type string, has_codeowners boolean,"
        " has_pr_template boolean, has_contributing boolean, n_ci_workflows int, language_dominant string")
    assert {(r.id, r.language_dominant) for r in atopen.project_features(rows, full).collect()} == {("1", "Go"), ("2", None)}


def test_more_than_64_categories_and_refused_parameters(spark):
    df = spark.range(400).selectExpr("cast(id as string) as id", "concat('l', id % 80) as language_dominant", "cast(id % 24 as int) as created_hour_utc", "id % 3 = 0 as is_slow")
    fitted = model.fit(df, ["language_dominant", "created_hour_utc"], {"n_estimators": 2, "num_leaves": 4}, 1)
    assert model.predict(fitted, df, ["language_dominant", "created_hour_utc"]).where("p_hat between 0 and 1").count() == 400
    for name in model.NOT_SUPPORTED:
        with pytest.raises(KeyError, match=name):
            model.check_params({name: 1})


def test_the_earliest_page_wins_in_any_order_of_arrival(spark):
    source, sink, checkpoint = ingest.fresh_paths(spark)
    schema = "project string, tier int, id string, page_index long, payload string"
    for page in (5, 2, 9):
        rows = [("p", 1, "x", page, json.dumps(page)), ("p", 1, f"only{page}", page, "{}")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, schema, sink, checkpoint)
    got = {r.id: r.page_index for r in ingest.landed(spark, sink).collect()}
    assert got == {"x": 2, "only5": 5, "only2": 2, "only9": 9}


def test_responses_without_a_stream_count_for_no_rule(spark):
    from waitline import RULES

    df = spark.createDataFrame([(None, "NONE", None), ("reviews", None, None), ("issue_comments", "NONE", True)], "stream string, association string, is_minimized boolean")
    got = df.select(*[labels.qualifies(r).alias(n) for n, r in RULES.items()]).collect()
    assert [tuple(r) for r in got] == [(False,) * 5, (True,) * 5, (False, False, True, False, False)]


def test_intermediate_tables_can_be_deleted(spark):
    from waitline.session import clean, written

    kept = written(spark.range(5), "numbers")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert kept.count() == 5 and os.path.isdir(path)
    # Other tests' shared tables are forgotten as well, so that they are written anew.
    from waitline.plans import bindings

    assert clean(spark) >= 1 and not os.path.isdir(path)
    bindings.forget_shared(keep=("raw",))
