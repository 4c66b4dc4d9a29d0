"""Queries over the label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline.conf import RULES
from waitline.functions.columns import is_bot, micros
from waitline.operators import labels as L
from waitline.plans import oracle_base as o
from waitline.plans.bindings import SETTINGS_E, SETTINGS_T, EventTables, OrderTables
from waitline.plans.registry import Book

book = Book()
R9 = lambda c: F.round(c, 9).alias(c)


@book.query("l1_is_bot", o.with_(o.RESPONSES) + f"""
select login, type, coalesce(type = 'Bot' or lower(login) like '%[bot]' or
       regexp_replace(lower(login), '\\[bot\\]$', '') in ({o.BOTS}), type = 'Bot') as is_bot, count(*) as n
from resp group by all""")
def l1_is_bot(spark, sf):
    r = OrderTables(spark, sf).responses().groupBy("login", "type").agg(F.count("*").alias("n"))
    return r.select("login", "type", is_bot("login", "type").alias("is_bot"), "n")


@book.query("l2_visible_at", o.with_(o.RESPONSES) + """
select stream, cast(v_us as varchar) as v_us, count(*) as n from resp group by all""")
def l2_visible_at(spark, sf):
    r = OrderTables(spark, sf).responses().select("stream", micros(L.visible_at()).cast("string").alias("v_us"))
    return r.groupBy("stream", "v_us").agg(F.count("*").alias("n"))


def _l3(name):
    def run(spark, sf):
        t = OrderTables(spark, sf)
        e = L.eligible_events(t.subjects(), t.responses(), RULES[name])
        return e.groupBy("id", "stream", "login").agg(
            F.count("*").alias("n"), F.min(micros("visible_at")).alias("first_us"))
    return run


for _d in RULES:
    book.query(f"l3_eligible_events_{_d.lower()}", o.with_(o.SUBJECTS, o.RESPONSES, o.ELIGIBLE) + f"""
select id, stream, login, count(*) as n, min(v_us) as first_us from elig
where {o.DEFINITION_FILTER[_d]} group by all""")(_l3(_d))


@book.query("l4_first_event", o.with_(o.SUBJECTS, o.RESPONSES, o.ELIGIBLE) + f"""
select id, min(v_us) as first_us from elig where {o.DEFINITION_FILTER['D5']} group by id having min(v_us) is not null""")
def l4_first_event(spark, sf):
    t = OrderTables(spark, sf)
    f = L.first_events(t.subjects(), t.responses(), [RULES["D5"]])
    return f.select("id", micros("first_D5").alias("first_us")).where("first_us is not null")


LABEL_SQL = """select project, id, c_us, cast(fe_us as varchar) as first_us, round(wait_h, 9) as wait_h, never_answered, is_slow,
 round(wait_h_censored, 9) as wait_h_censored, event_observed from lab"""


def _label_out(df):
    return df.select("project", "id", micros("created_at").alias("c_us"), micros("first_event_at").cast("string").alias("first_us"),
                     R9("wait_h"), "never_answered", "is_slow", R9("wait_h_censored"), "event_observed")


@book.query("l5_label", o.with_(o.SUBJECTS, o.RESPONSES, o.ELIGIBLE, o.label_cte()) + LABEL_SQL)
def l5_label(spark, sf):
    t = OrderTables(spark, sf)
    return _label_out(L.label(t.subjects(), t.responses(), t.settings))


# Microsecond waits are compared as whole microseconds, where rounding is exact.
@book.query("l5_label_events", o.with_(o.E_SUBJECTS, o.E_RESPONSES, o.ELIGIBLE, o.label_cte(thr=24.0, censor=168.0)) + f"""
select project, id, c_us, cast(fe_us as varchar) as first_us, round(wait_h * {float(o.HOUR)}, 0) as wait_us, never_answered, is_slow,
  round(wait_h_censored * {float(o.HOUR)}, 0) as wait_censored_us, event_observed from lab""")
def l5_label_events(spark, sf):
    t = EventTables(spark, sf)
    whole = lambda c, name: F.round(F.col(c) * float(o.HOUR), 0).alias(name)
    return L.label(t.subjects(), t.responses(), t.settings).select(
        "project", "id", micros("created_at").alias("c_us"), micros("first_event_at").cast("string").alias("first_us"),
        whole("wait_h", "wait_us"), "never_answered", "is_slow", whole("wait_h_censored", "wait_censored_us"), "event_observed")


@book.query("l6_label_all", o.with_(
    o.SUBJECTS, o.RESPONSES, o.ELIGIBLE, *[o.label_cte(f"lab{d}", d) for d in RULES]) + " union all ".join(
    f"select '{d}' as definition, id, round(wait_h, 9) as wait_h, never_answered, is_slow, "
    f"round(wait_h_censored, 9) as wait_h_censored from lab{d}" for d in RULES))
def l6_label_all(spark, sf):
    t = OrderTables(spark, sf)
    out = L.label_all(t.subjects(), t.responses(), t.settings)
    return out.select("definition", "id", R9("wait_h"), "never_answered", "is_slow", R9("wait_h_censored"))


@book.query("l7_modelling_rows", o.with_(o.SUBJECTS, o.MODEL_ROWS) + "select id, project, c_us from mrows")
def l7_modelling_rows(spark, sf):
    t = OrderTables(spark, sf)
    return L.modelling_rows(t.subjects(), t.settings).select("id", "project", micros("created_at").alias("c_us"))


@book.query("l8_prepare_rows", o.with_(o.SUBJECTS, o.RESPONSES, o.ELIGIBLE, o.MODEL_ROWS, o.KEPT,
                                       o.label_cte(source="mrows")) + """
select m.id, m.project, l.is_slow, cast(l.fe_us as varchar) as first_us, round(l.wait_h, 9) as wait_h
from mrows m join lab l using (id) where m.project in (select project from kept)""")
def l8_prepare_rows(spark, sf):
    t = OrderTables(spark, sf)
    rows = L.modelling_rows(t.subjects(), t.settings)
    out = L.prepare_rows(t.subjects(), L.label(rows, t.responses(), t.settings), t.kept(), t.settings)
    return out.select("id", "project", "is_slow", micros("first_event_at").cast("string").alias("first_us"), R9("wait_h"))


QUERIES, ORACLES = book.queries, book.oracles
