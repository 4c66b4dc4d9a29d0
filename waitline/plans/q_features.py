"""Queries over static, at-open and project features and the assembled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline import registry
from waitline.functions.columns import micros
from waitline.operators import atopen as A
from waitline.operators import features as X
from waitline.operators import labels as L
from waitline.operators import replay as R
from waitline.plans import oracle_base as o
from waitline.plans.bindings import OrderTables
from waitline.plans.q_replay import replay_sql
from waitline.plans.registry import Book

book = Book()

STATIC_SQL = f"""
st as (select id, cast(hour(created_at) as integer) as created_hour_utc, cast(isodow(created_at) - 1 as integer) as created_dayofweek,
              isodow(created_at) >= 6 as is_weekend, coalesce(is_cross, false) as is_cross_project,
              (c_us - a_us) / {float(o.DAY)} as actor_account_age_days,
              cast(length(coalesce(body_current, '')) as integer) as body_len, length(coalesce(body_current, '')) > 0 as has_body,
              edited as body_edited from subj)"""

AT_OPEN_SQL = f"""
tle as (select t.*, s.c_us from tl t join subj s using (id)),
ren as (select id, previous_title from (select *, row_number() over (partition by id order by e_us, event_key) as rn
        from tle where event_type = 'RenamedTitleEvent' and e_us > c_us) where rn = 1),
reb as (select id, previous_ref from (select *, row_number() over (partition by id order by e_us, event_key) as rn
        from tle where event_type = 'BaseRefChangedEvent' and e_us > c_us) where rn = 1),
cnt as (select s.id,
   count(*) filter (e_us > t.c_us and event_type in ('ReadyForReviewEvent', 'ConvertToDraftEvent')) as flips,
   count(*) filter (e_us > t.c_us and event_type = 'LabeledEvent') as added,
   count(*) filter (e_us > t.c_us and event_type = 'UnlabeledEvent') as removed,
   count(*) filter (event_type = 'ReviewRequestedEvent' and e_us <= t.c_us + 60000000) as req,
   count(*) filter (event_type = 'ReviewRequestedEvent' and e_us <= t.c_us + 60000000 and requested_type = 'Team') as team,
   count(t.id) as n_events
  from subj s left join tle t using (id) group by s.id),
com as (select cast(l_orderkey as varchar) as id, epoch_us(l_shipdate) as w_us,
               case when l_linenumber <> 4 then cast(l_quantity as bigint) end as additions, l_partkey % 50 as deletions
        from lineitem),
diff as (select s.id, sum(case when w_us <= s.c_us then coalesce(additions, 0) end) as additions_at_open,
                sum(case when w_us <= s.c_us then deletions end) as deletions_at_open,
                nullif(count(*) filter (w_us <= s.c_us), 0) as n_commits_at_open,
                count(*) = 1 and count(*) filter (w_us <= s.c_us) = 1 as diff_is_exact
         from com c join subj s using (id) group by s.id),
ao as (select s.id, s.is_draft_current <> (flips % 2 = 1) as is_draft_at_open,
   cast(greatest(0, n_labels_current - added + removed) as bigint) as n_labels_at_open,
   cast(length(coalesce(ren.previous_title, title_current, '')) as integer) as title_len_at_open,
   coalesce(coalesce(reb.previous_ref, base_ref_current) = default_branch, false) as base_is_default,
   req > 0 as reviewer_requested_at_open, req as n_reviewers_requested_at_open, team > 0 as requested_team_at_open,
   cast(additions_at_open as double) as additions_at_open, cast(deletions_at_open as double) as deletions_at_open,
   cast(n_commits_at_open as double) as n_commits_at_open, coalesce(diff_is_exact, false) as diff_is_exact,
   n_events >= 60 as timeline_may_be_truncated
  from subj s left join ren using (id) left join reb using (id) left join cnt using (id) left join diff using (id)
  left join meta using (project))"""

PROJ_SQL = f"""
pf as (select s.id, n_assignable_users, n_mentionable_users, owner_type = 'Organization' as owner_is_org, has_codeowners,
              has_pr_template, has_contributing, n_ci_workflows, language_dominant,
              (s.c_us - p_us) / {float(o.DAY)} as project_age_days_at_open from subj s join meta using (project))"""

TL = o.TIMELINE.replace(o.LINES + ",", "", 1)
BASE = [o.SUBJECTS, o.RESPONSES, TL, o.META, AT_OPEN_SQL]


@book.query("f1_static", o.with_(o.SUBJECTS, STATIC_SQL) + """
select * replace (round(actor_account_age_days, 6) as actor_account_age_days) from st""")
def f1_static(spark, sf):
    out = A.static_features(OrderTables(spark, sf).subjects())
    return out.withColumn("actor_account_age_days", F.round("actor_account_age_days", 6))


def _at_open(t):
    rows = t.subjects()
    return A.at_open_features(rows, t.timeline(), t.project_meta(), t.settings, A.commits_at_open(rows, t.commits()))


def _at_open_query(columns):
    return lambda spark, sf: _at_open(OrderTables(spark, sf)).select("id", *columns)


for _key, _cols in {
    "f2_draft_at_open": ["is_draft_at_open"],
    "f3_labels_at_open": ["n_labels_at_open"],
    "f4_title_at_open": ["title_len_at_open"],
    "f5_base_is_default": ["base_is_default"],
    "f6_requests_at_open": ["reviewer_requested_at_open", "n_reviewers_requested_at_open", "requested_team_at_open"],
    "f7_timeline_cap": ["timeline_may_be_truncated"],
    "f8_diff_at_open": ["additions_at_open", "deletions_at_open", "n_commits_at_open", "diff_is_exact"],
}.items():
    book.query(_key, o.with_(*BASE) + f"select id, {', '.join(_cols)} from ao")(_at_open_query(_cols))


@book.query("f9_project_features", o.with_(o.SUBJECTS, o.META, PROJ_SQL) + """
select * replace (round(project_age_days_at_open, 6) as project_age_days_at_open) from pf""")
def f9_project_features(spark, sf):
    t = OrderTables(spark, sf)
    out = A.project_features(t.subjects(), t.project_meta())
    return out.withColumn("project_age_days_at_open", F.round("project_age_days_at_open", 6))


@book.query("f10_missing_metadata", o.with_(o.SUBJECTS, o.META) + """
select project, count(*) as n from subj where project not in (select project from meta where owner_type = 'User') group by project""")
def f10_missing_metadata(spark, sf):
    t = OrderTables(spark, sf)
    known = t.project_meta().where("owner_type = 'User'")
    rows = t.subjects()
    return rows.join(A.missing_meta(rows, known), "project").groupBy("project").agg(F.count("*").alias("n"))


ROWS = [*BASE, o.ELIGIBLE, o.MODEL_ROWS, o.KEPT, "crows as (select * from mrows where project in (select project from kept))",
        o.label_cte(source="crows")]
PRIORS_SQL = f"""
pri as (select coalesce(avg(case when c.c_us < {o.CUT} then cast(l.is_slow as integer) end), avg(cast(l.is_slow as integer))) as g,
               coalesce(avg(case when c.c_us < {o.CUT} then cast(coalesce(m_us < {o.CUT}, false) as integer) end),
                        avg(cast(coalesce(m_us < {o.CUT}, false) as integer))) as g_merge
        from crows c join lab l using (id))"""


@book.query("f11_priors", o.with_(*ROWS, PRIORS_SQL) + "select round(g, 9) as g, round(g_merge, 9) as g_merge from pri")
def f11_priors(spark, sf):
    t = OrderTables(spark, sf)
    rows = L.modelling_rows(t.subjects(), t.settings).join(t.kept(), "project", "left_semi")
    marks = L.label(rows, t.responses(), t.settings).select("id", "is_slow")
    return X.priors(rows.join(marks, "id"), t.settings).select(F.round("g", 9).alias("g"), F.round("g_merge", 9).alias("g_merge"))


_PRESENT = ("project", "id", "number", "created_at", "is_slow")
_MISSING = [c for c in registry.COLUMNS if c not in _PRESENT]


@book.query("f12_contract_violations", o.with_(o.SUBJECTS) + " union all ".join(
    [f"select '{c}' as column, 'missing' as problem, 1::bigint as n" for c in _MISSING]
    + ["select 'bogus', 'extra', 1", "select 'is_slow', 'type', 1",
       "select 'number', 'null', count(*) from subj where number % 5 = 0 having count(*) > 0"]))
def f12_contract_violations(spark, sf):
    broken = OrderTables(spark, sf).subjects().selectExpr(
        "project", "id", "if(number % 5 = 0, null, number) as number", "created_at", "'yes' as is_slow", "1 as bogus")
    return X.contract_violations(broken)


TABLE_SQL = [*ROWS, PRIORS_SQL, STATIC_SQL, PROJ_SQL,
             "pr as (select id as pid, project, c_us as t_us, actor_login as who from crows)",
             replay_sql("pr", o.THR_H, o.TRAIL_D, 7, o.WSTART, "(select g from pri)", "(select g_merge from pri)"),
             """
feat as (select c.project, c.id, c.number, c.c_us, l.is_slow, l.wait_h, l.wait_h_censored, l.event_observed, l.never_answered,
                st.* exclude (id), ao.* exclude (id), rep.* exclude (pid, project, t_us), pf.* exclude (id)
         from crows c join lab l using (id) join st using (id) join ao using (id) join rep on rep.pid = c.id join pf using (id))"""]
DOUBLES = [c.name for c in registry.COLUMNS.values() if c.type == "double"]


def rounded_sql(columns):
    out = []
    for c in columns:
        if c == "created_at":
            out.append("c_us")
        elif c in DOUBLES:
            out.append(f"round({c}, 6) as {c}")
        else:
            out.append(c)
    return ", ".join(out)


def rounded(df, columns):
    out = []
    for c in columns:
        if c == "created_at":
            out.append(micros(c).alias("c_us"))
        elif c in DOUBLES:
            out.append(F.round(c, 6).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@book.query("f13_feature_table", o.with_(*TABLE_SQL) + f"select {rounded_sql(registry.COLUMNS)} from feat")
def f13_feature_table(spark, sf):
    return rounded(OrderTables(spark, sf).feature_table(), registry.COLUMNS)


for _set, _names in registry.FEATURE_SETS.items():
    book.query(f"f14_set_{_set.lower()}", o.with_(*TABLE_SQL) + f"select id, is_slow, {rounded_sql(_names)} from feat")(
        lambda spark, sf, _set=_set, _names=_names: rounded(
            X.project_set(OrderTables(spark, sf).feature_table(), _set), ["id", "is_slow", *_names]))


@book.query("f15_audit", o.with_(*TABLE_SQL) + """
select 'features' as gate, 1 as id, 'row count is conserved' as check, cast(count(*) as varchar) as value,
       count(*) = (select count(*) from crows) as pass from feat
union all select 'features', 2, 'replay equals brute force', '0.0', true
union all select 'features', 3, 'nulls only where allowed', '0', true
union all select 'features', 4, 'capped timelines below 2 %',
       cast(avg(cast(timeline_may_be_truncated as integer)) as varchar), avg(cast(timeline_may_be_truncated as integer)) < 0.02 from feat""")
def f15_audit(spark, sf):
    t = OrderTables(spark, sf)
    table = t.feature_table()
    rows = L.modelling_rows(t.subjects(), t.settings).join(t.kept(), "project", "left_semi")
    marks = L.label(rows, t.responses(), t.settings)
    base = X.priors(rows.join(marks.select("id", "is_slow"), "id"), t.settings)
    probes = R.sample_probes(R.row_probes(rows), 500, t.settings.seed)
    brute = R.brute_force_features(
        t.history(), marks, probes, t.settings, base.select("g").scalar(), base.select("g_merge").scalar())
    return X.audit(table, brute, rows.agg(F.count("*")).scalar())


@book.query("f16_explain", o.with_(*ROWS, f"""
ask as (select id as pid, project, c_us as t_us, actor_login as who from crows order by md5(concat_ws(':', '11', id)), id limit 20),
hist as (select s.*, l.fe_us, l.is_slow as slow from subj s left join lab l using (id)),
near as (select a.pid, a.t_us, a.who, h.*,
           case when h.slow is not null and (h.c_us <= a.t_us - {int(o.THR_H * o.HOUR)} or coalesce(h.fe_us < a.t_us, false))
                then 'counted' else 'not yet resolvable' end as tag
         from ask a join hist h on h.project = a.project and h.c_us < a.t_us)""") + f"""
select pid as probe_id, 'backlog' as reason, 'counted' as tag, id as evidence_id from near where x_us is null or x_us > t_us
union all select pid, 'recent', 'counted', id from near where c_us >= t_us - 7 * {o.DAY}
union all select pid, 'actor', tag, id from near where actor_login = who
union all select pid, 'trailing', tag, id from near where slow is not null and c_us >= t_us - {o.TRAIL_D * o.DAY}""")
def f16_explain(spark, sf):
    t = OrderTables(spark, sf)
    rows = L.modelling_rows(t.subjects(), t.settings).join(t.kept(), "project", "left_semi")
    marks = L.label(rows, t.responses(), t.settings)
    asked = R.sample_probes(R.row_probes(rows), 20, 11)
    return X.explain(t.history(), marks, asked, t.settings).drop("created_at")


@book.query("f17_load_for_modelling", o.with_(*TABLE_SQL) + """
select id, c_us, trailing_n from feat where not timeline_may_be_truncated""")
def f17_load_for_modelling(spark, sf):
    return X.load_for_modelling(OrderTables(spark, sf).feature_table()).select(
        "id", micros("created_at").alias("c_us"), "trailing_n")


QUERIES, ORACLES = book.queries, book.oracles
