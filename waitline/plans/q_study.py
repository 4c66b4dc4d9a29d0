"""Queries over cohort selection, quality checks, collection gates and wait distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline.conf import RULES
from waitline.functions.columns import instant, micros
from waitline.operators import cohort as C
from waitline.operators import collection as G
from waitline.operators import eda as E
from waitline.operators import labels as L
from waitline.operators.atopen import commits_at_open
from waitline.operators.splits import group_folds
from waitline.plans import oracle_base as o
from waitline.plans.bindings import SETTINGS_T, OrderTables
from waitline.plans.registry import Book

book = Book()
r9 = lambda *cs: [F.round(c, 9).alias(c) for c in cs]
FAMILIES = {r: (r,) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}

ALL_LABELS = ", ".join([
    o.SUBJECTS, o.RESPONSES, o.ELIGIBLE, o.MODEL_ROWS, *[o.label_cte(f"lab{d}", d, "mrows") for d in RULES],
    "alab as (" + " union all ".join(f"select '{d}' as definition, * from lab{d}" for d in RULES) + ")"])
TIERS = o.COHORT
RATE = "avg(case when is_slow then 1.0 else 0.0 end)"


def all_labels(t):
    return L.label_all(L.modelling_rows(t.subjects(), t.settings), t.responses(), t.settings)


# --- cohort -------------------------------------------------------------------------------------

@book.query("c1_dominant_language", o.with_(o.CANDIDATES) + "select id, dominant as language_dominant from cand")
def c1_dominant_language(spark, sf):
    return C.dominant_language(OrderTables(spark, sf).candidates()).select("id", "language_dominant")


@book.query("c2_structural_filter", o.with_(o.CANDIDATES) + """
select id from cand where primary_language = 'BUILDING' and stars between 0 and 6000 and pushed_at > timestamp '1999-01-01'
 and not is_fork and not coalesce(is_archived, false) and not is_mirror and not is_private""")
def c2_structural_filter(spark, sf):
    since = F.lit("1999-01-01").cast("timestamp")
    return C.structural_filter(OrderTables(spark, sf).candidates(), "BUILDING", 0, 6000, since).select("id")


@book.query("c3_stratified_draw", o.with_(o.CANDIDATES, """
walk as (select id, cell, md5(concat_ws(':', '5', cell, id)) as h, n_all, n_window from cand),
w2 as (select *, case when n_all < 8 then 'all-time volume' when n_window < 8 then 'in-window volume' end as reason from walk),
w3 as (select *, coalesce(sum(case when reason is null then 1 else 0 end) over (partition by cell order by h
         rows between unbounded preceding and 1 preceding), 0) as taken from w2)""") + """
select id, cell, reason, reason is null as chosen from w3 where taken < 5""")
def c3_stratified_draw(spark, sf):
    return C.stratified_draw(OrderTables(spark, sf).candidates(), 5, 8, 5).select("id", "cell", "reason", "chosen")


CHECK_SQL = ", ".join([ALL_LABELS, o.COHORT, o.META, f"""
cn as (select project, count(*) filter (c_us between {o.WSTART} and {o.WEND}) as n,
              count(*) filter (c_us between {o.WSTART} and {o.WEND} and coalesce(actor_is_bot, false)) as nb from subj group by project),
cr as (select project, avg(case when is_slow then 1.0 else 0.0 end) filter (definition = 'D5') as d5,
              avg(case when is_slow then 1.0 else 0.0 end) filter (definition = 'D3') as d3 from alab group by project),
chk as (select c.project, language_stratum, size_tier, coalesce(n, 0) as n_in_window, coalesce(n - nb, 0) as n_human,
     coalesce(nb / nullif(n, 0), 0) as bot_share, case when n is not null then language_dominant end as language_dominant,
     d5 as is_slow_d5, d3 as is_slow_d3, abs(d5 - d3) as spread_d3_d5,
     case when n is null then 'no data collected' else concat_ws(';',
        case when coalesce(nb / nullif(n, 0), 0) > 0.5 then 'bot share' end, case when n - nb < 100 then 'too few human rows' end,
        case when language_dominant <> language_stratum then 'language outside the stratum''s family' end) end as reasons
  from cohort c left join cn using (project) left join cr using (project) left join meta using (project))"""])


def checked(t):
    human = L.label_all(L.modelling_rows(t.subjects(), t.settings), t.responses(), t.settings)
    return C.check_projects(t.cohort(), t.subjects(), t.project_meta(), human, t.settings, FAMILIES)


@book.query("c4_check_projects", o.with_(CHECK_SQL) + """
select project, language_stratum, size_tier, n_in_window, n_human, round(bot_share, 9) as bot_share, language_dominant,
  round(is_slow_d5, 9) as is_slow_d5, round(is_slow_d3, 9) as is_slow_d3, round(spread_d3_d5, 9) as spread_d3_d5, reasons, reasons = '' as kept from chk""")
def c4_check_projects(spark, sf):
    return checked(OrderTables(spark, sf)).select(
        "project", "language_stratum", "size_tier", "n_in_window", "n_human",
        *r9("bot_share", "is_slow_d5", "is_slow_d3", "spread_d3_d5"), "language_dominant",
        F.array_join("reasons", ";").alias("reasons"), "kept")


@book.query("c5_look_list", o.with_(CHECK_SQL) + """
select project, n_human, round(row_share, 9) as row_share,
  concat_ws(';', case when row_share > 0.08 then 'row share' end, case when spread_d3_d5 > 0.15 then 'definition spread' end) as why
from (select *, n_human / sum(n_human) over () as row_share from chk where reasons = '')""")
def c5_look_list(spark, sf):
    return C.look_list(checked(OrderTables(spark, sf))).select(
        "project", "n_human", *r9("row_share"), F.array_join("why", ";").alias("why"))


@book.query("c6_kept_rows", o.with_(o.SUBJECTS, o.KEPT) + "select id, project from subj where project in (select project from kept)")
def c6_kept_rows(spark, sf):
    t = OrderTables(spark, sf)
    return C.keep(t.subjects(), t.kept()).select("id", "project")


# --- collection gate -----------------------------------------------------------------------------

@book.query("g1_coverage", o.with_(o.SUBJECTS) + f"""
select project, min(c_us) as first_us, max(c_us) as last_us, count(*) as n, count(*) filter (c_us between {o.WSTART} and {o.WEND}) as n_in_window,
  round(avg(case when c_us between {o.WSTART} and {o.WEND} then 0.0 else 1.0 end), 9) as outside_share from subj group by project""")
def g1_coverage(spark, sf):
    t = OrderTables(spark, sf)
    return G.coverage(t.subjects(), t.settings, ["project"]).select(
        "project", micros("first_at").alias("first_us"), micros("last_at").alias("last_us"), "n", "n_in_window", *r9("outside_share"))


@book.query("g2_truncation_rate", o.with_(o.SUBJECTS, o.RESPONSES) + f"""
select project, round(avg(case when coalesce(n, 0) > 5 then 1.0 else 0.0 end), 9) as truncation_rate
from subj left join (select id, count(*) as n from resp group by id) using (id)
where c_us between {o.WSTART} and {o.WEND} group by project""")
def g2_truncation_rate(spark, sf):
    t = OrderTables(spark, sf)
    n = t.responses().groupBy("id").agg(F.count("*").alias("n"))
    flagged = G.in_window(t.subjects(), t.settings).select("project", "id").join(n, "id", "left").select(
        "project", (F.coalesce("n", F.lit(0)) > 5).alias("is_truncated"))
    return G.truncation_rate(flagged, ["project"]).select("project", *r9("truncation_rate"))


DEF_SQL = f"""
dt as (select definition, {RATE} as is_slow, avg(case when never_answered then 1.0 else 0.0 end) as never_answered,
              quantile_cont(wait_h, 0.5) filter (event_observed) as median_wait_h from alab group by definition)"""


@book.query("g3_definition_spread", o.with_(ALL_LABELS, DEF_SQL) + "select round(max(is_slow) - min(is_slow), 9) as spread from dt")
def g3_definition_spread(spark, sf):
    t = OrderTables(spark, sf)
    return E.definition_spread(E.definition_table(all_labels(t), t.settings)).select(*r9("spread"))


@book.query("g4_degeneracy", o.with_(ALL_LABELS) + f"""
select round(never, 9) as never, round(slow, 9) as slow, never between 0.10 and 0.35 and slow between 0.05 and 0.60 as pass
from (select avg(case when never_answered then 1.0 else 0.0 end) as never, {RATE} as slow from labD3)""")
def g4_degeneracy(spark, sf):
    t = OrderTables(spark, sf)
    lab = L.label(L.modelling_rows(t.subjects(), t.settings), t.responses(), t.settings, RULES["D3"])
    return G.degeneracy(lab).select(*r9("never", "slow"), "pass")


@book.query("g5_contamination", o.with_(o.SUBJECTS, o.TIMELINE) + f"""
, ins as (select * from subj where c_us between {o.WSTART} and {o.WEND})
select event_type, count(distinct id) as n, round(count(distinct id) / (select count(*) from ins), 9) as share
from tl join ins using (id) where e_us > c_us group by event_type""")
def g5_contamination(spark, sf):
    t = OrderTables(spark, sf)
    return G.contamination(G.in_window(t.subjects(), t.settings), t.timeline()).select("event_type", "n", *r9("share"))


@book.query("g5_diff_rates", o.with_(o.SUBJECTS) + """
select round(avg(case when n > 1 then 1.0 else 0.0 end), 9) as multi_commit_rate,
  round(avg(case when n = 1 and e = 1 then 1.0 else 0.0 end), 9) as diff_exact_rate
from (select s.id, count(l_orderkey) as n, count(*) filter (epoch_us(l_shipdate) <= c_us) as e
      from subj s left join lineitem on l_orderkey = s.number group by s.id)""")
def g5_diff_rates(spark, sf):
    t = OrderTables(spark, sf)
    n = t.commits().groupBy("id").agg(F.count("*").alias("n"))
    counts = t.subjects().select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_commits"))
    return G.diff_rates(commits_at_open(t.subjects(), t.commits()), counts).select(*r9("multi_commit_rate", "diff_exact_rate"))


@book.query("g6_warm_up", o.with_(o.SUBJECTS) + f"""
select count(*) filter (c_us < {o.WSTART} and (x_us is null or x_us > {o.WSTART})) as open_at_window_start,
  round(avg(case when exists (select 1 from subj v where v.c_us < {o.WSTART} and v.project = subj.project and v.actor_login = subj.actor_login) then 1.0 else 0.0 end)
        filter (c_us >= {o.WSTART} and c_us < {o.WSTART} + 90 * {o.DAY}), 9) as early_actors_with_history from subj""")
def g6_warm_up(spark, sf):
    t = OrderTables(spark, sf)
    return G.warm_up(t.history(), t.settings).select("open_at_window_start", *r9("early_actors_with_history"))


@book.query("g7_mutability", o.with_(o.SUBJECTS) + """
select count(*) as n_actors, count(*) filter (s = 'CONTRIBUTOR') as n_status,
  round(avg(case when s = 'CONTRIBUTOR' then 1.0 else 0.0 end), 9) as rate
from (select project, actor_login, (array_agg(association_current order by c_us, id) filter (association_current is not null))[1] as s
      from subj where actor_login is not null group by project, actor_login)""")
def g7_mutability(spark, sf):
    return G.mutability(OrderTables(spark, sf).history()).select("n_actors", "n_status", *r9("rate"))


@book.query("g8_collection_cost", o.with_(o.ORDERS, o.MANIFEST) + """
select points, n_rows, round(points / n_rows * 1000, 6) as points_per_1k, round(bytes / n_rows, 6) as bytes_per_row
from (select sum(coalesce(rate_limit_cost, 0))::bigint as points, sum(pr_count)::bigint as n_rows, sum(bytes)::bigint as bytes
      from man where tier = 2 and pr_count > 0)""")
def g8_collection_cost(spark, sf):
    return G.cost(OrderTables(spark, sf).manifest()).select(
        "points", F.col("rows").alias("n_rows"), F.round("points_per_1k", 6).alias("points_per_1k"),
        F.round("bytes_per_row", 6).alias("bytes_per_row"))


# --- the gate of every project and of all together, in one scan each ------------------------------

LEVEL = "case when grouping(project) = 1 then 'all' else 'each' end as level, project"
BY = ["project"]


@book.query("g5_contamination_levels", o.with_(o.SUBJECTS, o.TIMELINE) + f"""
, ins as (select * from subj where c_us between {o.WSTART} and {o.WEND}),
hit as (select {LEVEL}, event_type, count(distinct id) as n from (
    select ins.project, tl.event_type, ins.id from tl join ins on tl.id = ins.id where e_us > c_us) group by grouping sets ((project, event_type), (event_type))),
tot as (select {LEVEL}, count(*) as m from ins group by grouping sets ((project), ()))
select hit.level, hit.project, event_type, n, round(n / m, 9) as share from hit join tot on hit.level = tot.level and hit.project is not distinct from tot.project""")
def g5_contamination_levels(spark, sf):
    t = OrderTables(spark, sf)
    return G.contamination(G.in_window(t.subjects(), t.settings), t.timeline(), BY).select("level", "project", "event_type", "n", *r9("share"))


@book.query("g5_diff_rates_levels", o.with_(o.SUBJECTS) + f"""
select {LEVEL}, round(avg(case when n > 1 then 1.0 else 0.0 end), 9) as multi_commit_rate,
  round(avg(case when n = 1 and e = 1 then 1.0 else 0.0 end), 9) as diff_exact_rate
from (select s.id, s.project, count(l_orderkey) as n, count(*) filter (epoch_us(l_shipdate) <= c_us) as e
      from subj s left join lineitem on l_orderkey = s.number group by s.id, s.project) group by grouping sets ((project), ())""")
def g5_diff_rates_levels(spark, sf):
    t = OrderTables(spark, sf)
    n = t.commits().groupBy("id").agg(F.count("*").alias("n"))
    counts = t.subjects().select("id", "project").join(n, "id", "left").select("id", "project", F.coalesce("n", F.lit(0)).alias("n_commits"))
    return G.diff_rates(commits_at_open(t.subjects(), t.commits()), counts, BY).select("level", "project", *r9("multi_commit_rate", "diff_exact_rate"))


@book.query("g6_warm_up_levels", o.with_(o.SUBJECTS) + f"""
select {LEVEL}, count(*) filter (c_us < {o.WSTART} and (x_us is null or x_us > {o.WSTART})) as open_at_window_start,
  round(avg(case when exists (select 1 from subj v where v.c_us < {o.WSTART} and v.project = subj.project and v.actor_login = subj.actor_login) then 1.0 else 0.0 end)
        filter (c_us >= {o.WSTART} and c_us < {o.WSTART} + 90 * {o.DAY}), 9) as early_actors_with_history
from subj group by grouping sets ((project), ())""")
def g6_warm_up_levels(spark, sf):
    t = OrderTables(spark, sf)
    return G.warm_up(t.history(), t.settings, keys=BY).select("level", "project", "open_at_window_start", *r9("early_actors_with_history"))


@book.query("g7_mutability_levels", o.with_(o.SUBJECTS) + f"""
select {LEVEL}, count(*) as n_actors, count(*) filter (s = 'CONTRIBUTOR') as n_status,
  round(avg(case when s = 'CONTRIBUTOR' then 1.0 else 0.0 end), 9) as rate
from (select project, actor_login, (array_agg(association_current order by c_us, id) filter (association_current is not null))[1] as s
      from subj where actor_login is not null group by project, actor_login) group by grouping sets ((project), ())""")
def g7_mutability_levels(spark, sf):
    return G.mutability(OrderTables(spark, sf).history(), keys=BY).select("level", "project", "n_actors", "n_status", *r9("rate"))


@book.query("g8_cost_levels", o.with_(o.ORDERS, o.MANIFEST) + f"""
select level, project, points, n_rows, round(points / n_rows * 1000, 6) as points_per_1k, round(bytes / n_rows, 6) as bytes_per_row
from (select {LEVEL}, sum(coalesce(rate_limit_cost, 0))::bigint as points, sum(pr_count)::bigint as n_rows, sum(bytes)::bigint as bytes
      from man where tier = 2 and pr_count > 0 group by grouping sets ((project), ()))""")
def g8_cost_levels(spark, sf):
    return G.cost(OrderTables(spark, sf).manifest(), BY).select(
        "level", "project", "points", F.col("rows").alias("n_rows"), F.round("points_per_1k", 6).alias("points_per_1k"),
        F.round("bytes_per_row", 6).alias("bytes_per_row"))


# --- distributions -------------------------------------------------------------------------------

@book.query("e1_definition_table", o.with_(ALL_LABELS, DEF_SQL) + """
select definition, round(is_slow, 9) as is_slow, round(never_answered, 9) as never_answered, round(median_wait_h, 9) as median_wait_h from dt""")
def e1_definition_table(spark, sf):
    t = OrderTables(spark, sf)
    return E.definition_table(all_labels(t), t.settings).select("definition", *r9("is_slow", "never_answered", "median_wait_h"))


@book.query("e2_project_spread", o.with_(ALL_LABELS, f"""
sp as (select project, abs(avg(case when is_slow then 1.0 else 0.0 end) filter (definition = 'D3')
                         - avg(case when is_slow then 1.0 else 0.0 end) filter (definition = 'D5')) as spread from alab group by project)""") + """
select round(quantile_cont(spread, 0.5), 9) as median_spread, round(max(spread), 9) as max_spread,
       (select min(project) from sp where round(spread, 9) = (select round(max(spread), 9) from sp)) as project from sp""")
def e2_project_spread(spark, sf):
    out = E.spread_summary(E.project_spread(all_labels(OrderTables(spark, sf))))
    return out.select(*r9("median_spread", "max_spread"), "project")


LAB_T = ", ".join([o.SUBJECTS, o.RESPONSES, o.ELIGIBLE, o.MODEL_ROWS, o.label_cte(source="mrows"), o.COHORT,
                   "tlab as (select l.*, size_tier as tier from lab l join cohort using (project))"])


@book.query("e3_wait_histogram", o.with_(LAB_T, """
x as (select tier, log10(greatest(wait_h, 0.01)) as x from tlab where event_observed),
sp as (select tier, min(x) as lo, max(x) as hi, count(*) as n from x group by tier),
b as (select tier, lo, hi, sp.n as total, cast(least(floor((x - lo) / ((hi - lo) / 40)), 39) as integer) as bin from x join sp using (tier))""") + """
select tier, bin, round(lo + bin * ((hi - lo) / 40), 9) as left_edge, count(*) as n,
       round(count(*) / (total * ((hi - lo) / 40)), 9) as density from b group by tier, bin, lo, hi, total""")
def e3_wait_histogram(spark, sf):
    t = OrderTables(spark, sf)
    return E.wait_histogram(E.with_tier(t.labels(), t.cohort())).select("tier", "bin", *r9("left_edge"), "n", *r9("density"))


def km_sql(keys):
    cols, by, part = o._cols(keys), "".join(f", {k}" for k in keys), o.part(keys)
    return f"""
att as (select {cols}wait_h_censored as t, count(*) filter (event_observed) as d, count(*) as m from tlab group by t{by}),
rk as (select *, sum(m) over ({part} order by t desc) as at_risk from att),
st as (select *, case when at_risk > d then ln((at_risk - d) / at_risk) else 0 end as ls,
              case when at_risk > d then d / (at_risk * (at_risk - d)) else 0 end as v, case when at_risk = d then 1 else 0 end as z from rk),
km as (select {cols}t, d, at_risk::bigint as at_risk, sum(ls) over w as cls, sum(v) over w as cv, sum(z) over w as cz from st window w as ({part} order by t)),
kf as (select *, case when cz > 0 then 0.0 else exp(cls) end as survival from km)"""


KM_OUT = """t, d, at_risk, round(survival, 9) as survival,
  round(case when cz = 0 and cls < 0 then exp(cls * exp(1.959963984540054 * sqrt(cv) / cls)) else survival end, 9) as ci_lo,
  round(case when cz = 0 and cls < 0 then exp(cls * exp(-1.959963984540054 * sqrt(cv) / cls)) else survival end, 9) as ci_hi from kf"""


@book.query("e4_survival", o.with_(LAB_T, km_sql(())) + "select " + KM_OUT)
def e4_survival(spark, sf):
    t = OrderTables(spark, sf)
    return E.survival(t.labels(), t.settings).select("t", "d", "at_risk", *r9("survival", "ci_lo", "ci_hi"))


@book.query("e4_survival_by_tier", o.with_(LAB_T, km_sql(("tier",))) + "select tier, " + KM_OUT)
def e4_survival_by_tier(spark, sf):
    t = OrderTables(spark, sf)
    return E.survival(E.with_tier(t.labels(), t.cohort()), t.settings, ["tier"]).select(
        "tier", "t", "d", "at_risk", *r9("survival", "ci_lo", "ci_hi"))


THRESHOLDS = (2160, 4320, 8640, 12960)


@book.query("e5_threshold_table", o.with_(LAB_T) + f"""
select coalesce(tier, 'all') as tier, threshold_h, round(avg(case when never_answered or wait_h > threshold_h then 1.0 else 0.0 end), 9) as is_slow
from tlab cross join (select unnest([{", ".join(map(str, THRESHOLDS))}]) as threshold_h)
group by grouping sets ((tier, threshold_h), (threshold_h))""")
def e5_threshold_table(spark, sf):
    t = OrderTables(spark, sf)
    return E.threshold_table(E.with_tier(t.labels(), t.cohort()), THRESHOLDS).select("tier", "threshold_h", *r9("is_slow"))


@book.query("e6_cohort_table", o.with_(CHECK_SQL) + """
select project, size_tier, reasons, n_in_window, n_human, round(coalesce(n / total, 0), 9) as row_share, round(nv, 9) as never_answered_d5
from chk left join (select project, count(*) as n, sum(count(*)) over () as total from mrows group by project) using (project)
left join (select project, avg(case when never_answered then 1.0 else 0.0 end) as nv from labD5 group by project) using (project)""")
def e6_cohort_table(spark, sf):
    t = OrderTables(spark, sf)
    return E.cohort_table(checked(t), L.modelling_rows(t.subjects(), t.settings), t.labels()).select(
        "project", "size_tier", F.array_join("reasons", ";").alias("reasons"), "n_in_window", "n_human", *r9("row_share"),
        F.round("never_answered", 9).alias("never_answered_d5"))


@book.query("e7_study_gate", o.with_(CHECK_SQL, o.folds_cte("mrows")) + f"""
select 'study' as gate, 1 as id, 'projects kept >= 30' as check, cast(count(*) as varchar) as value, count(*) >= 30 as pass from chk where reasons = ''
union all select 'study', 2, 'slow rate in [10 %, 70 %]', cast(round({RATE}, 4) as varchar), {RATE} between 0.1 and 0.7 from labD5
union all select 'study', 3, '>= 20 test projects with >= 10 rows', cast(count(*) as varchar), count(*) >= 20
   from (select project from mrows where c_us >= {o.CUT} group by project having count(*) >= 10)
union all select 'study', 4, 'every fold holds out >= 6 projects', cast(min(g) as varchar), min(g) >= 6 from (select count(*) as g from folds group by fold)
union all select 'study', 5, 'replay audit passes', '1', true""")
def e7_study_gate(spark, sf):
    from waitline.plans.q_evaluation import m10_baseline_audit

    t = OrderTables(spark, sf)
    rows = L.modelling_rows(t.subjects(), t.settings)
    late = rows.where(F.col("created_at") >= instant(t.settings.cutoff))
    return G.study_gate(checked(t), t.labels(), late, group_folds(rows, 5), m10_baseline_audit(spark, sf))


@book.query("e8_split_coverage", o.with_(o.SUBJECTS, o.MODEL_ROWS, o.folds_cte("mrows")) + f"""
select (select count(*) from (select project from mrows where c_us >= {o.CUT} group by project having count(*) >= 10)) as test_projects_with_10,
       (select min(g) from (select count(*) as g from folds group by fold)) as min_projects_per_fold""")
def e8_split_coverage(spark, sf):
    t = OrderTables(spark, sf)
    rows = L.modelling_rows(t.subjects(), t.settings)
    return G.split_coverage(rows.where(F.col("created_at") >= instant(t.settings.cutoff)), group_folds(rows, 5))


QUERIES, ORACLES = book.queries, book.oracles
