"""The bindings and the basic definitions again, in plain SQL for DuckDB.

Written from the definitions (range joins, filters), not from the DataFrame code.
"""

from __future__ import annotations

HOUR = 3600000000
DAY = 24 * HOUR

ORDERS = """
ord as (select o.*, n_name as project, c_mktsegment, n_nationkey,
               epoch_us(o_orderdate) as c_us
        from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

SUBJECTS = ORDERS + f""",
subj as (select project, cast(o_orderkey as varchar) as id, o_orderkey as number, c_us,
                o_orderdate as created_at,
                case when o_orderstatus = 'F' then c_us + 30 * {DAY} end as x_us,
                case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then c_us + 30 * {DAY} end as m_us,
                case when o_custkey % 37 <> 0 then concat('c', o_custkey) end as actor_login,
                case when o_custkey % 37 = 0 then null else o_custkey % 20 = 0 end as actor_is_bot,
                case when o_custkey % 3 = 0 then 'CONTRIBUTOR' when o_custkey % 7 = 0 then null else 'NONE' end as association_current,
                case when o_custkey % 37 <> 0 then epoch_us(timestamp '1990-01-01') + (o_custkey % 3000) * {DAY} end as a_us,
                case when o_orderpriority = '1-URGENT' then null else o_orderpriority = '5-LOW' end as is_cross,
                o_orderstatus = 'P' as is_draft_current,
                concat('Order ', o_orderkey, ' ', o_orderpriority) as title_current,
                case when o_orderpriority <> '4-NOT SPECIFIED' then concat(c_mktsegment, ' ', o_totalprice > 250000) end as body_current,
                o_orderstatus as base_ref_current,
                cast(o_orderkey % 4 as integer) as n_labels_current,
                o_totalprice > 250000 as edited,
                o_totalprice
         from ord)"""

LINES = """
lin as (select l.*, o_custkey, o_orderdate as opened from lineitem l join orders on l_orderkey = o_orderkey)"""

RESPONSES = LINES + f""",
resp as (select cast(l_orderkey as varchar) as id,
                case l_returnflag when 'R' then 'reviews' when 'A' then 'thread_comments' else 'issue_comments' end as stream,
                case when l_returnflag = 'R' then (case when l_tax < 0.08 then epoch_us(l_shipdate) end)
                     when l_tax > 0 then epoch_us(l_shipdate) else epoch_us(l_shipdate) - {HOUR} end as v_us,
                case when l_suppkey % 17 = 0 then null when l_linenumber = 7 then concat('c', o_custkey)
                     when l_suppkey % 13 = 0 then 'Renovate' else concat('s', l_suppkey) end as login,
                case when l_suppkey % 10 = 0 then 'Bot' else 'User' end as type,
                case when l_linenumber = 6 then null when l_linestatus = 'O' then 'MEMBER' else 'NONE' end as association,
                case when l_linenumber = 5 then null else l_discount > 0.09 end as is_minimized
         from lin where l_shipdate >= opened)"""

TIMELINE = LINES + """,
tl as (select cast(l_orderkey as varchar) as id,
              case l_linenumber when 1 then 'ReadyForReviewEvent' when 2 then 'ConvertToDraftEvent'
                when 3 then 'LabeledEvent' when 4 then 'UnlabeledEvent' when 5 then 'RenamedTitleEvent'
                when 6 then 'BaseRefChangedEvent' else 'ReviewRequestedEvent' end as event_type,
              case when l_linenumber = 7 then epoch_us(opened) + (l_suppkey % 120) * 1000000 else epoch_us(l_shipdate) end as e_us,
              concat_ws('-', l_partkey, l_suppkey) as event_key,
              case when l_linenumber = 5 and l_suppkey % 5 <> 0 then concat('was ', l_partkey) end as previous_title,
              case when l_linenumber = 6 and l_suppkey % 5 <> 0 then substr('OFP', cast(l_partkey % 3 as integer) + 1, 1) end as previous_ref,
              case when l_linenumber = 7 then (case when l_partkey % 2 = 0 then 'Team' else 'User' end) end as requested_type
       from lin)"""

META = f"""
meta as (select n_name as project, epoch_us(timestamp '1990-01-01') + n_nationkey * 30 * {DAY} as p_us,
                case when n_nationkey % 2 = 0 then 'Organization' else 'User' end as owner_type,
                r_name as language_dominant, case when n_nationkey % 3 = 0 then 'F' else 'O' end as default_branch,
                (select count(*) from supplier where s_nationkey = n_nationkey) as n_assignable_users,
                (select count(*) from customer where c_nationkey = n_nationkey) as n_mentionable_users,
                n_nationkey % 2 = 1 as has_codeowners, n_nationkey % 3 = 1 as has_pr_template,
                n_nationkey % 5 = 1 as has_contributing, cast(n_nationkey % 7 as bigint) as n_ci_workflows
         from nation join region on n_regionkey = r_regionkey)"""

COHORT = """
cohort as (select n_name as project, case when n_nationkey % 6 = 5 then 'ASIA' else r_name end as language_stratum,
                  concat('tier', n_nationkey % 3) as size_tier
           from nation join region on n_regionkey = r_regionkey)"""

KEPT = "kept as (select n_name as project from nation where n_nationkey % 8 <> 7)"

MANIFEST = """
man as (select project, cast(o_orderkey % 3 as integer) as tier, o_orderkey as page_index,
   case when o_custkey % 9 <> 0 then concat('k', o_custkey % 200) end as cursor_before,
   case when o_orderpriority = '1-URGENT' then 'timeout' end as fatal_transient,
   o_orderpriority = '2-HIGH' and o_orderkey % 5 = 0 as bypass,
   case when o_orderpriority = '2-HIGH' and o_orderkey % 5 = 0 then [o_custkey, o_custkey % 10] end as dead_numbers,
   case when o_orderkey % 11 <> 0 then o_orderpriority = '3-MEDIUM' and o_orderkey % 7 = 0 end as has_graphql_errors,
   case when o_orderkey % 4 = 0 then 'v2' else 'v1' end as query_version, o_custkey % 50 as pr_count,
   case when o_orderkey % 6 <> 0 then o_orderkey % 8 end as rate_limit_cost, floor(o_totalprice)::bigint as bytes from ord)"""

CANDIDATES = LINES + """,
lsz as (select o_custkey, l_returnflag as name, floor(sum(l_quantity))::bigint as size from lin group by all),
ldom as (select o_custkey, name from (select *, row_number() over (partition by o_custkey order by size desc, name) as rn from lsz) where rn = 1),
vol as (select o_custkey, count(*) as n_all, count(*) filter (o_orderdate >= timestamp '1998-01-01') as n_window,
               max(o_orderdate) as pushed_at from orders group by o_custkey),
cand as (select cast(c_custkey as varchar) as id, c_mktsegment as primary_language, coalesce(ldom.name, c_mktsegment) as dominant,
   trunc(c_acctbal)::bigint as stars, pushed_at, coalesce(n_all, 0) as n_all, coalesce(n_window, 0) as n_window,
   c_custkey % 10 = 0 as is_fork, case when c_custkey % 4 <> 0 then c_custkey % 11 = 0 end as is_archived,
   c_custkey % 13 = 0 as is_mirror, c_custkey % 17 = 0 as is_private,
   concat(c_mktsegment, ':', case when c_acctbal < 2000 then 'low' when c_acctbal < 6000 then 'mid' else 'high' end) as cell
  from customer c left join ldom on ldom.o_custkey = c_custkey left join vol on vol.o_custkey = c_custkey)"""

# Window, cutoff, threshold, censor and trailing length of binding T.
WSTART, WEND, CUT = "epoch_us(timestamp '1996-01-01')", "epoch_us(timestamp '2000-12-31 23:59:59')", "epoch_us(timestamp '2000-01-01')"
THR_H, CENSOR_H, TRAIL_D = 8640.0, 25920.0, 720

E_SUBJECTS = f"""
subj as (select concat('p', user_id % 25) as project, cast(event_id as varchar) as id, event_id as number,
                epoch_us(ts) as c_us, case when value > 20 then epoch_us(ts) + 36 * {HOUR} end as x_us,
                case when value > 40 then epoch_us(ts) + 36 * {HOUR} end as m_us,
                concat('u', user_id) as actor_login, user_id % 20 = 0 as actor_is_bot, user_id
         from events where event_type = 'signup')"""

E_RESPONSES = """
resp as (select s.id, case event_id % 3 when 0 then 'reviews' when 1 then 'thread_comments' else 'issue_comments' end as stream,
                epoch_us(ts) as v_us, concat('svc', event_id % 7) as login, 'User' as type,
                case when event_id % 4 = 0 then 'NONE' else 'MEMBER' end as association,
                event_id % 11 = 0 as is_minimized
         from subj s join events e on e.user_id = s.user_id and e.event_type = 'purchase' and epoch_us(ts) > s.c_us)"""

BOTS = ("'dependabot','renovate','github-actions','codecov','coveralls','sonarcloud','netlify','vercel',"
        "'pre-commit-ci','allcontributors','stale','mergify','copilot'")

# Human, visible, not the opener's own.
ELIGIBLE = f"""
elig as (select r.*, s.project, s.c_us from resp r join subj s using (id)
         where v_us is not null and login is not null
           and not (type = 'Bot' or lower(login) like '%[bot]' or lower(login) in ({BOTS}))
           and (s.actor_login is null or login <> s.actor_login))"""

DEFINITION_FILTER = {
    "D1": "stream = 'reviews'",
    "D2": "stream in ('reviews', 'thread_comments')",
    "D3": "true",
    "D4": "not coalesce(is_minimized, false)",
    "D5": "coalesce(association, '') <> 'NONE'",
}


def label_cte(name: str = "lab", definition: str = "D5", source: str = "subj",
              thr: float = THR_H, censor: float = CENSOR_H) -> str:
    return f"""
{name}_f as (select id, min(v_us) as fe_us from elig where {DEFINITION_FILTER[definition]} group by id),
{name}_w as (select s.project, s.id, s.c_us, fe_us, (fe_us - s.c_us) / {float(HOUR)} as wait_h
             from {source} s left join {name}_f using (id)),
{name} as (select *, (wait_h is null or wait_h > {censor}) as never_answered,
                  (wait_h is null or wait_h > {thr}) as is_slow,
                  least(coalesce(wait_h, {censor}), {censor}) as wait_h_censored,
                  not (wait_h is null or wait_h > {censor}) as event_observed
           from {name}_w)"""


MODEL_ROWS = f"""
mrows as (select * from subj where not coalesce(actor_is_bot, false) and c_us between {WSTART} and {WEND})"""

PREDICTIONS = ", ".join([
    SUBJECTS, RESPONSES, ELIGIBLE, MODEL_ROWS, label_cte(source="mrows"),
    """
pred as (select m.id, m.project, m.number, m.c_us, m.x_us, m.title_current as title,
                concat('https://example.com/', m.project, '/', m.number) as url, l.is_slow, l.wait_h, l.fe_us,
                least(0.999::double, greatest(0.001::double, floor(m.o_totalprice / 500) / 1000.0::double)) as p_hat,
                (m.number % 97 + 1) / 100.0::double as baseline_score,
                coalesce(m.actor_login, '') < 'c5' as is_first_here,
                cast(m.number % 24 as integer) as created_hour, m.number % 5 = 0 as diff_is_exact, m.created_at
         from mrows m join lab l using (id))""",
])


def folds_cte(source: str, name: str = "folds", k: int = 5) -> str:
    """Greedy balanced folds: size descending, name descending, to the first lightest fold."""
    zeros = ", ".join(["0"] * k)
    return f"""
{name}_g as (select project, count(*) as n, row_number() over (order by count(*) desc, project desc) as rn
             from {source} group by project),
{name}_r as (select cast(0 as bigint) as rn, cast([{zeros}] as bigint[]) as load, cast('' as varchar) as project,
                    cast(0 as bigint) as n, cast(-1 as bigint) as fold
             union all
             select g.rn, list_transform(r.load, lambda v, i:
                      case when i = list_position(r.load, list_min(r.load)) then v + g.n else v end),
                    g.project, g.n, list_position(r.load, list_min(r.load)) - 1
             from {name}_r r join {name}_g g on g.rn = r.rn + 1),
{name} as (select project, n, fold from {name}_r where rn > 0)"""


SCENARIOS = ", ".join([PREDICTIONS, folds_cte("pred"), f"""
scen as (select 'A' as scenario, cast(0 as bigint) as fold, p.* from pred p where c_us >= {CUT}
         union all select 'B', f.fold, p.* from pred p join folds f using (project))"""])

SCORED = ", ".join([SCENARIOS, """
sets as (select 'FULL' as featureset, * from scen
         union all select 'NO_SNAPSHOT', * replace (p_hat * 0.5::double + (case when diff_is_exact then 1.0::double else 0.0::double end) * 0.1::double as p_hat) from scen
         union all select 'NO_LABEL_REPLAY', * replace (p_hat * 0.5::double + baseline_score * 0.25::double as p_hat) from scen
         union all select 'SUBJECT_ONLY', * replace (created_hour / 25.0::double as p_hat) from scen)"""])


def _on(keys, a, b):
    return " and ".join(f"{a}.{k} = {b}.{k}" for k in keys) or "true"


def _cols(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def part(keys):
    return "partition by " + ", ".join(keys) if keys else ""


def grouped(keys):
    return "group by " + ", ".join(keys) if keys else ""


def ap_cte(name: str, source: str, keys=(), score: str = "p_hat", outcome: str = "is_slow") -> str:
    return f"""
{name}_c as (select {_cols(keys)}{score} as s, count(*) filter ({outcome}) as pos, count(*) as n
             from {source} group by {_cols(keys)}s),
{name}_r as (select *, sum(pos) over ({part(keys)} order by s desc) as cp, sum(n) over ({part(keys)} order by s desc) as cn
             from {name}_c),
{name} as (select {_cols(keys)}sum(pos * cp / cn) / nullif(sum(pos), 0) as auc_pr from {name}_r {grouped(keys)})"""


def patk_cte(name: str, source: str, keys=(), k: int = 10, seed: int = 7411, score: str = "p_hat") -> str:
    pk = [*keys, "project"]
    return f"""
{name}_k as (select {_cols(pk)}is_slow, row_number() over ({part(pk)} order by {score} desc, md5(concat_ws(':', '{seed}', id)), id) as rk
             from {source}),
{name}_p as (select {_cols(pk)}avg(case when is_slow then 1.0 else 0.0 end) as precision from {name}_k where rk <= {k} {grouped(pk)}),
{name} as (select {_cols(keys)}avg(precision) as precision_at_k from {name}_p {grouped(keys)})"""


def boot_cte(name: str, source: str, keys=(), value: str = "v", draws: int = 2000, seed: int = 7411,
             group: str = "project") -> str:
    gb = ", ".join([*keys, "draw"])
    return f"""
{name}_g as (select {_cols(keys)}{group}, {value} as v,
                    row_number() over ({part(keys)} order by md5({group}), {group}) - 1 as slot,
                    count(*) over ({part(keys)}) as n from {source} where {value} is not null),
{name}_d as (select {_cols(keys, "g.")}d.draw as draw,
                    ('0x' || substr(md5(concat_ws(':', '{seed}', d.draw, g.slot)), 1, 8))::bigint % g.n as pick
             from {name}_g g, range({draws}) d(draw)),
{name}_m as (select {_cols(keys, "d.")}d.draw, avg(g.v) as m from {name}_d d join {name}_g g on {_on(keys, "d", "g")} and g.slot = d.pick
             group by {_cols(keys, "d.")}d.draw),
{name} as (select {_cols(keys)}quantile_cont(m, 0.025) as ci_lo, quantile_cont(m, 0.975) as ci_hi from {name}_m {grouped(keys)})"""


def with_(*ctes: str) -> str:
    return "with recursive " + ", ".join(ctes) + "\n"
