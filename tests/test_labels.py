from conftest import at
from pyspark.sql import functions as F

from waitline.conf import RULES, Settings
from waitline.functions.columns import is_bot
from waitline.operators import labels as L

T0 = "2025-01-01T00:00:00"
SUBJECTS = "project string, id string, created_at timestamp, actor_login string, actor_is_bot boolean"
RESPONSES = ("id string, stream string, created_at timestamp, submitted_at timestamp, published_at timestamp, login string,"
             " type string, association string, is_minimized boolean")


def frames(spark, extra=()):
    subjects = spark.createDataFrame([("p", i, at(T0), "alice", False) for i in "ABCD"], SUBJECTS)
    h = lambda n: at(T0, hours=n)
    rows = [
        ("A", "reviews", h(1), h(2), None, "bob", "User", "MEMBER", None),
        ("B", "issue_comments", h(1), None, None, "carl", "User", "NONE", False),
        ("B", "reviews", h(199), h(200), None, "bob", "User", "MEMBER", None),
        ("C", "issue_comments", h(5), None, None, "alice", "User", "MEMBER", False),
        ("C", "issue_comments", h(6), None, None, "dependabot[bot]", "Bot", "NONE", False),
        ("D", "reviews", h(1), None, None, "bob", "User", "MEMBER", None),
        *extra,
    ]
    return subjects, spark.createDataFrame(rows, RESPONSES)


def waits(df):
    return {r.id: (r.wait_h, r.is_slow, r.never_answered, r.wait_h_censored) for r in df.collect()}


def test_primary_definition(spark):
    got = waits(L.label(*frames(spark), Settings()))
    assert got == {"A": (2.0, False, False, 2.0), "B": (200.0, True, False, 200.0),
                   "C": (None, True, True, 720.0), "D": (None, True, True, 720.0)}


def test_definitions_differ_only_where_they_should(spark):
    rows = L.label_all(*frames(spark), Settings()).collect()
    wait = {(r.definition, r.id): r.wait_h for r in rows}
    assert wait["D3", "B"] == 1.0 and wait["D5", "B"] == 200.0
    assert {i for (d, i), w in wait.items() if d == "D1" and w is not None} == {"A", "B"}


def test_minimized_counts_for_d3_not_d4(spark):
    late = [("D", "issue_comments", at(T0, hours=3), None, None, "dora", "User", "MEMBER", True)]
    rows = L.label_all(*frames(spark, late), Settings()).collect()
    wait = {(r.definition, r.id): r.wait_h for r in rows}
    assert wait["D3", "D"] == 3.0 and wait["D4", "D"] is None


def test_wait_beyond_censor(spark):
    subjects, responses = frames(spark)
    later = responses.where("id = 'A'").withColumn("submitted_at", F.lit(at(T0, hours=800)))
    r = L.label(subjects.where("id = 'A'"), later, Settings()).first()
    assert r.never_answered and r.wait_h == 800.0 and r.wait_h_censored == 720.0 and not r.event_observed


def test_unknown_opener_lets_everyone_count(spark):
    subjects, responses = frames(spark)
    unknown = subjects.withColumn("actor_login", F.lit(None).cast("string"))
    assert waits(L.label(unknown, responses, Settings(), RULES["D3"]))["C"][0] == 5.0


def test_is_bot(spark):
    rows = [("dependabot[bot]", "Bot"), ("Dependabot", "User"), ("alice", "User"), (None, None), ("renovate", "User")]
    got = spark.createDataFrame(rows, "l string, t string").select(is_bot("l", "t").alias("b")).collect()
    assert [r.b for r in got] == [True, True, False, False, True]


def test_modelling_rows_include_both_ends(spark):
    s = Settings()
    rows = [("p", "a", s.window_start, "x", None), ("p", "b", s.window_end, "x", False), ("p", "c", at("2023-12-31T23:59:59"), "x", None),
            ("p", "d", s.window_end, "x", True)]
    got = L.modelling_rows(spark.createDataFrame(rows, SUBJECTS), s).collect()
    assert {r.id for r in got} == {"a", "b"}
