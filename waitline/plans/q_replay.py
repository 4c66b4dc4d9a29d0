"""Queries over the point-in-time replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline.functions.columns import micros
from waitline.operators import labels as L
from waitline.operators import replay as R
from waitline.plans import oracle_base as o
from waitline.plans.bindings import EventTables, OrderTables
from waitline.plans.registry import Book

book = Book()
PRIOR, MERGE_PRIOR = 0.5, 0.4


def replay_sql(probes: str, thr_h: float, trail_d: int, recent_d: int, wstart: str, g="0.5", gm="0.4", name="rep") -> str:
    """Range self-join from the definitions; ``probes`` names a relation (pid, project, t_us, who)."""
    usable = f"(h.slow is not null and (h.c_us <= p.t_us - {int(thr_h * o.HOUR)} or coalesce(h.fe_us < p.t_us, false)))"
    recent = f"h.c_us >= p.t_us - {trail_d * o.DAY}"
    return f"""
hist as (select s.project, s.id, s.c_us, s.x_us, s.m_us, s.actor_login, l.fe_us, cast(l.is_slow as integer) as slow
         from subj s left join lab l using (id)),
{name}_n as (select p.pid, p.project, p.t_us,
   count(*) filter (h.id is not null and (h.x_us is null or h.x_us > p.t_us)) as backlog,
   count(*) filter (h.c_us >= p.t_us - {recent_d * o.DAY}) as opened,
   count(*) filter ({usable} and {recent}) as tn,
   count(*) filter ({usable} and {recent} and h.slow = 1) as ts,
   count(*) filter (h.actor_login = p.who) as pn,
   count(*) filter (h.actor_login = p.who and h.m_us < p.t_us) as pm,
   min(case when h.actor_login = p.who then h.c_us end) as f_us,
   count(*) filter (h.actor_login = p.who and {usable}) as an,
   count(*) filter (h.actor_login = p.who and {usable} and h.slow = 1) as asl
  from {probes} p left join hist h on h.project = p.project and h.c_us < p.t_us group by all),
{name} as (select pid, project, t_us, backlog as open_backlog_at_t, opened as opened_trailing_7d,
   (ts + 5.0 * {g}) / (tn + 5.0) as trailing_90d_slow_rate, tn as trailing_n,
   t_us - {trail_d * o.DAY} >= {wstart} as trailing_window_complete,
   pn = 0 as is_first_here, pn as n_prior_here, pm as n_prior_merged_here,
   (pm + 5.0 * {gm}) / (pn + 5.0) as prior_merge_rate_here, (t_us - f_us) / {float(o.DAY)} as days_since_first_here,
   (asl + 5.0 * {g}) / (an + 5.0) as actor_prior_slow_rate_here, an as actor_prior_n from {name}_n)"""


BASE = [o.SUBJECTS, o.RESPONSES, o.ELIGIBLE, o.MODEL_ROWS, o.label_cte(source="mrows")]
ROW_PROBES = "pr as (select id as pid, project, c_us as t_us, actor_login as who from subj)"
REP_T = o.with_(*BASE, ROW_PROBES, replay_sql("pr", o.THR_H, o.TRAIL_D, 7, o.WSTART))
ROUND = {"trailing_90d_slow_rate", "prior_merge_rate_here", "actor_prior_slow_rate_here"}
AGE = "days_since_first_here"  # compared in whole microseconds, where rounding is exact


def cols_sql(names):
    names = list(names)
    if AGE in names:
        names.remove(AGE)
        return f"round({AGE} * {float(o.DAY)}, 0) as first_age_us" + (", " + cols_sql(names) if names else "")
    return ", ".join(f"round({n}, 9) as {n}" if n in ROUND else n for n in names)


def cols_df(names):
    names = list(names)
    if AGE in names:
        names.remove(AGE)
        return [F.round(F.col(AGE) * float(o.DAY), 0).alias("first_age_us"), *cols_df(names)]
    return [F.round(n, 9).alias(n) if n in ROUND else F.col(n) for n in names]


def inputs(t):
    return t.history(), t.labels()


def _rows_query(names):
    def run(spark, sf):
        t = OrderTables(spark, sf)
        hist, lab = inputs(t)
        out = R.features_at(hist, lab, R.row_probes(t.history()), t.settings, PRIOR, MERGE_PRIOR)
        return out.select(F.col("probe_id").alias("pid"), *cols_df(names))
    return run


for _key, _names in {
    "r1_open_backlog": ("open_backlog_at_t",),
    "r2_opened_trailing": ("opened_trailing_7d",),
    "r3_trailing_slow_rate": ("trailing_90d_slow_rate", "trailing_n"),
    "r4_trailing_window_complete": ("trailing_window_complete",),
    "r5_prior_count": ("n_prior_here", "is_first_here"),
    "r6_prior_merge_rate": ("n_prior_merged_here", "prior_merge_rate_here"),
    "r7_days_since_first": ("days_since_first_here",),
    "r8_actor_slow_rate": ("actor_prior_slow_rate_here", "actor_prior_n"),
}.items():
    book.query(_key, REP_T + f"select pid, {cols_sql(_names)} from rep")(_rows_query(_names))


@book.query("r9_features_at_instants", o.with_(*BASE, o.TIMELINE.replace(o.LINES + ",", "", 1), """
pr as (select distinct concat(s.id, '@', e_us) as pid, s.project, e_us as t_us, s.actor_login as who
       from tl join subj s using (id))""", replay_sql("pr", o.THR_H, o.TRAIL_D, 7, o.WSTART)) + f"""
select pid, t_us, {cols_sql(R.REPLAY_COLUMNS)} from rep""")
def r9_features_at_instants(spark, sf):
    t = OrderTables(spark, sf)
    hist, lab = inputs(t)
    moments = t.timeline().select("id", F.col("created_at").alias("at"))
    probes = moments.join(t.history().select("id", "project", "actor_login"), "id").select(
        F.concat("id", F.lit("@"), micros("at").cast("string")).alias("probe_id"), "project", "at", "actor_login"
    ).distinct()
    out = R.features_at(hist, lab, probes, t.settings, PRIOR, MERGE_PRIOR)
    return out.select(F.col("probe_id").alias("pid"), micros("at").alias("t_us"), *cols_df(R.REPLAY_COLUMNS))


@book.query("r9_features_at_events", o.with_(
    o.E_SUBJECTS, o.E_RESPONSES, o.ELIGIBLE, o.label_cte(thr=24.0, censor=168.0), """
pr as (select cast(event_id as varchar) as pid, concat('p', user_id % 25) as project, epoch_us(ts) as t_us,
              concat('u', user_id) as who from events)""",
    replay_sql("pr", 24.0, 7, 1, "epoch_us(timestamp '2024-01-03')")) + f"""
select pid, t_us, {cols_sql(R.REPLAY_COLUMNS)} from rep""")
def r9_features_at_events(spark, sf):
    t = EventTables(spark, sf)
    lab = L.label(t.subjects(), t.responses(), t.settings)
    probes = t._events().selectExpr(
        "cast(event_id as string) as probe_id", "concat('p', user_id % 25) as project", "at",
        "concat('u', user_id) as actor_login")
    out = R.features_at(t.history(), lab, probes, t.settings, PRIOR, MERGE_PRIOR)
    return out.select(F.col("probe_id").alias("pid"), micros("at").alias("t_us"), *cols_df(R.REPLAY_COLUMNS))


@book.query("r10_brute_force_sample", o.with_(*BASE, """
pr as (select id as pid, project, c_us as t_us, actor_login as who from mrows
       order by md5(concat_ws(':', '7', id)), id limit 500)""",
    replay_sql("pr", o.THR_H, o.TRAIL_D, 7, o.WSTART)) + f"""
select pid, {cols_sql(R.REPLAY_COLUMNS)} from rep""")
def r10_brute_force_sample(spark, sf):
    t = OrderTables(spark, sf)
    hist, lab = inputs(t)
    probes = R.sample_probes(R.row_probes(L.modelling_rows(t.subjects(), t.settings)), 500, 7)
    out = R.brute_force_features(hist, lab, probes, t.settings, PRIOR, MERGE_PRIOR)
    return out.select(F.col("probe_id").alias("pid"), *cols_df(R.REPLAY_COLUMNS))


@book.query("r11_replay_features", o.with_(
    *BASE, "pr as (select id as pid, project, c_us as t_us, actor_login as who from mrows)",
    replay_sql("pr", o.THR_H, o.TRAIL_D, 7, o.WSTART)) + f"select pid as id, {cols_sql(R.REPLAY_COLUMNS)} from rep")
def r11_replay_features(spark, sf):
    t = OrderTables(spark, sf)
    rows, lab = L.modelling_rows(t.subjects(), t.settings), t.labels()
    out = R.replay_features(rows, t.history(), lab, t.settings, PRIOR, MERGE_PRIOR)
    return out.select("id", *cols_df(R.REPLAY_COLUMNS))


@book.query("flagship_waiting_by_risk", o.with_(
    *BASE, f"""
pr as (select id as pid, project, {o.CUT} as t_us, actor_login as who from mrows
       where c_us < {o.CUT})""",
    "waiting as (select m.* from mrows m left join lab l using (id) where m.c_us < " + o.CUT
    + " and (m.x_us is null or m.x_us > " + o.CUT + ") and (l.fe_us is null or l.fe_us > " + o.CUT + "))",
    replay_sql("pr", o.THR_H, o.TRAIL_D, 7, o.WSTART)) + f"""
select project, id, rank, round(risk, 6) as risk, days_waited from (
  select w.project, w.id, r.actor_prior_slow_rate_here as risk,
         round(({o.CUT} - w.c_us) / {float(o.DAY)}, 6) as days_waited,
         row_number() over (partition by w.project order by r.actor_prior_slow_rate_here desc, w.c_us, w.number) as rank
  from waiting w join rep r on r.pid = w.id) where rank <= 10""")
def flagship_waiting_by_risk(spark, sf):
    """Per project, the ten waiting subjects most at risk at the cutoff instant."""
    from pyspark.sql import Window as W

    from waitline.functions.columns import days_between, instant
    from waitline.operators.triage import awaiting

    t = OrderTables(spark, sf)
    at = instant(t.settings.cutoff)
    rows, lab = L.modelling_rows(t.subjects(), t.settings), t.labels()
    open_rows = awaiting(
        rows.join(lab.select("id", F.col("first_event_at").alias("first_response_at")), "id"), at
    ).select("id", "project", "number", "created_at", "actor_login")
    probes = open_rows.select(F.col("id").alias("probe_id"), "project", at.alias("at"), "actor_login")
    risk = R.features_at(t.history(), lab, probes, t.settings, PRIOR, MERGE_PRIOR).select(
        F.col("probe_id").alias("id"), F.col("actor_prior_slow_rate_here").alias("risk"))
    w = W.partitionBy("project").orderBy(F.desc("risk"), "created_at", "number")
    return (
        open_rows.join(risk, "id").withColumn("rank", F.row_number().over(w)).where("rank <= 10")
        .select("project", "id", F.col("rank").cast("long").alias("rank"), F.round("risk", 6).alias("risk"),
                F.round(days_between("created_at", at), 6).alias("days_waited"))
    )


QUERIES, ORACLES = book.queries, book.oracles
