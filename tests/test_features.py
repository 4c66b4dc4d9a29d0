import pytest
from conftest import SF, at
from pyspark.sql import functions as F

from waitline import registry
from waitline.conf import Settings
from waitline.operators import atopen as A
from waitline.operators import features as X
from waitline.operators import labels as L
from waitline.operators import replay as R
from waitline.plans.bindings import OrderTables

T0 = "2025-01-01T00:00:00"
ROWS = ("project string, id string, created_at timestamp, is_draft_current boolean, n_labels_current int, title_current string,"
        " base_ref_current string")
TL = ("id string, event_type string, created_at timestamp, event_key string, previous_title string, previous_ref string, requested_type string")
DIFF = "id string, additions_at_open long, deletions_at_open long, n_commits_at_open long, diff_is_exact boolean"


def at_open(spark, rows, events):
    r = spark.createDataFrame(rows, ROWS)
    t = spark.createDataFrame([(*e, f"{i:04d}", *rest) for i, (e, rest) in enumerate(events)], TL)
    meta = spark.createDataFrame([("p", "main")], "project string, default_branch string")
    out = A.at_open_features(r, t, meta, Settings(), spark.createDataFrame([], DIFF))
    return {x.id: x for x in out.collect()}


def e(i, kind, title=None, ref=None, req=None, **plus):
    return ((i, kind, at(T0, **plus)), (title, ref, req))


def test_undo_of_later_events(spark):
    rows = [("p", "A", at(T0), False, 2, "new title", "main"), ("p", "B", at(T0), True, 0, "t", "main"),
            ("p", "C", at(T0), False, 3, "current", "dev"), ("p", "D", at(T0), False, 0, "t", "main")]
    events = [e("A", "ReadyForReviewEvent", hours=1), e("A", "LabeledEvent", hours=2), e("A", "LabeledEvent", hours=3),
              e("A", "UnlabeledEvent", hours=4), e("A", "RenamedTitleEvent", title="old", hours=5),
              e("A", "RenamedTitleEvent", title="mid title", hours=6), e("A", "BaseRefChangedEvent", ref="dev", hours=7),
              e("A", "ReviewRequestedEvent", req="User", seconds=1), e("A", "ReviewRequestedEvent", req="Team", seconds=30),
              e("A", "ReviewRequestedEvent", req="User", hours=2), e("B", "ConvertToDraftEvent", hours=1),
              e("B", "ReadyForReviewEvent", hours=2), *[e("D", "LabeledEvent", minutes=i + 1) for i in range(60)]]
    g = at_open(spark, rows, events)
    a, b, c, d = (g[k] for k in "ABCD")
    assert a.is_draft_at_open and a.n_labels_at_open == 1 and a.title_len_at_open == 3 and not a.base_is_default
    assert a.n_reviewers_requested_at_open == 2 and a.requested_team_at_open
    assert b.is_draft_at_open and b.base_is_default and not b.requested_team_at_open
    assert c.n_labels_at_open == 3 and c.title_len_at_open == 7 and not c.base_is_default
    assert d.n_labels_at_open == 0 and d.timeline_may_be_truncated and not c.timeline_may_be_truncated


def test_earliest_change_wins_even_with_null(spark):
    g = at_open(spark, [("p", "A", at(T0), False, 0, "current", "main")],
                [e("A", "RenamedTitleEvent", hours=1), e("A", "RenamedTitleEvent", title="later", hours=2)])
    assert g["A"].title_len_at_open == len("current")


def test_event_at_opening_is_not_undone(spark):
    g = at_open(spark, [("p", "A", at(T0), False, 1, "t", "main")],
                [e("A", "LabeledEvent"), e("A", "ReadyForReviewEvent"), e("A", "ReviewRequestedEvent", req="User")])
    assert g["A"].n_labels_at_open == 1 and not g["A"].is_draft_at_open and g["A"].n_reviewers_requested_at_open == 1


def test_commits_at_open_keeps_zero_apart_from_unknown(spark):
    rows = spark.createDataFrame([("A", at(T0)), ("B", at(T0))], "id string, created_at timestamp")
    commits = spark.createDataFrame([("A", at(T0, hours=-1), 0, 7), ("B", at(T0, hours=1), 5, 5)],
                                    "id string, authored_date timestamp, additions long, deletions long")
    g = {r.id: r for r in A.commits_at_open(rows, commits).collect()}
    assert (g["A"].additions_at_open, g["A"].deletions_at_open, g["A"].n_commits_at_open, g["A"].diff_is_exact) == (0, 7, 1, True)
    assert g["B"].additions_at_open is None and g["B"].n_commits_at_open is None and not g["B"].diff_is_exact


def test_missing_metadata_is_named(spark):
    rows = spark.createDataFrame([("known",), ("lost",)], "project string")
    meta = spark.createDataFrame([("known",)], "project string")
    with pytest.raises(KeyError, match="lost"):
        A.require_meta(rows, meta)
    A.require_meta(rows.where("project = 'known'"), meta)


def test_registry_contract():
    assert len(registry.COLUMNS) == 50
    assert [len(registry.FEATURE_SETS[k]) for k in ("FULL", "NO_SNAPSHOT", "NO_LABEL_REPLAY", "SUBJECT_ONLY")] == [37, 29, 33, 17]
    assert len(registry.PROJECT_FEATURES) == 8 and len(registry.no_project_columns()) == 25
    for bad in ("is_slow", "id", "diff_is_exact", "nonsense"):
        with pytest.raises(ValueError):
            registry.check_hygiene(["body_len", bad])


def test_table_audit_and_its_mutations(spark):
    t = OrderTables(spark, SF)
    table = t.feature_table()
    assert table.columns == list(registry.COLUMNS)
    assert X.contract_violations(table).count() == 0
    from waitline.operators import labels as L

    rows = L.modelling_rows(t.subjects(), t.settings).join(t.kept(), "project", "left_semi")
    marks = L.label(rows, t.responses(), t.settings)
    base = X.priors(rows.join(marks.select("id", "is_slow"), "id"), t.settings).first()
    brute = R.brute_force_features(t.history(), marks, R.sample_probes(R.row_probes(rows), 100, 1), t.settings, base.g, base.g_merge)
    n = F.lit(rows.count())
    verdict = lambda tab: {r.id: r["pass"] for r in X.audit(tab, brute, n).collect()}
    assert verdict(table) == {1: True, 2: True, 3: True, 4: True}
    assert verdict(table.withColumn("trailing_n", F.col("trailing_n") + 1)) == {1: True, 2: False, 3: True, 4: True}
    assert verdict(table.limit(10))[1] is False
    assert verdict(table.withColumn("body_len", F.lit(None).cast("int")))[3] is False


def test_priors_fall_back_to_all_rows(spark):
    s = Settings()
    rows = spark.createDataFrame([(at("2026-02-01T00:00:00"), True, None), (at("2026-03-01T00:00:00"), False, None)],
                                 "created_at timestamp, is_slow boolean, merged_at timestamp")
    assert tuple(X.priors(rows, s).first()) == (0.5, 0.0)


def test_lines_are_shuffled_once_on_their_way_to_labels_and_events(spark, capsys):
    t = OrderTables(spark, SF)
    rows = spark.createDataFrame([("1", "c1", at("1996-01-01T00:00:00"))], "id string, actor_login string, created_at timestamp")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (A.timeline_summary(rows, t.timeline(), t.settings), L.first_events(rows, t.responses())):
            df.explain()
            assert capsys.readouterr().out.count("Exchange hashpartitioning") == 3  # lines, orders, rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_row_is_shuffled_to_its_project_for_metadata(spark):
    t = OrderTables(spark, SF)
    rows = t.subjects()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        built = X.build(rows, t.history(), t.responses(), t.timeline(), A.commits_at_open(rows, t.commits()), t.project_meta(), t.kept(), t.settings)
        joins = [x for x in built._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [project#" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert joins and not [x for x in joins if "SortMergeJoin" in x]
