"""Queries over the triage view."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline.conf import utc
from waitline.functions.columns import format_value, instant, iso_week, micros
from waitline.operators import triage as T
from waitline.operators.splits import group_folds
from waitline.plans import oracle_base as o
from waitline.plans.bindings import SETTINGS_T, EmbeddingTables, OrderTables
from waitline.plans.registry import Book

book = Book()
r9 = lambda *cs: [F.round(c, 9).alias(c) for c in cs]
WAIT = f"c_us < {o.CUT} and (x_us is null or x_us > {o.CUT}) and (fe_us is null or fe_us > {o.CUT})"
OUTCOME = f"""(case when fe_us is not null then concat('reviewed after ', printf('%.1f', (fe_us - c_us) / {float(o.DAY)}), ' days')
 when x_us is not null then concat('closed after ', printf('%.1f', (x_us - c_us) / {float(o.DAY)}), ' days without a review')
 else 'never reviewed' end) || case when is_slow then ', stalled' else '' end"""
RANKED = f"""
rk as (select *, row_number() over (partition by project order by p_hat desc, c_us, number) as rank,
              round(({o.CUT} - c_us) / {float(o.DAY)}, 6) as days_waited, {OUTCOME} as outcome from pred where {WAIT})"""
CALENDAR = [utc(f"{y}-{m:02d}-01T00:00:00") for y in range(1996, 2001) for m in range(1, 13)]
CAL_SQL = "cal as (select epoch_us(d) as t_us from range(timestamp '1996-01-01', timestamp '2001-01-01', interval 1 month) r(d))"


def cut():
    return instant(SETTINGS_T.cutoff)


def pred(spark, sf):
    return OrderTables(spark, sf).predictions()


@book.query("d3_format_value", o.with_(o.SUBJECTS, o.META) + """
select id, case when is_cross is null then 'missing' when is_cross then 'yes' else 'no' end as flag,
  coalesce(body_current, 'missing') as word, printf('%.2f', n_labels_current / 8.0) as rate,
  format('{:,}', cast(round_even(o_totalprice, 0) as bigint)) as amount from subj""")
def d3_format_value(spark, sf):
    return OrderTables(spark, sf).subjects().withColumn("share", F.col("n_labels_current") / 8.0).select(
        "id", format_value("is_cross", "bool").alias("flag"), format_value("body_current", "str").alias("word"),
        format_value("share", "float", True).alias("rate"), format_value("o_totalprice", "float").alias("amount"))


@book.query("d6_awaiting", o.with_(o.PREDICTIONS) + f"select id, project from pred where {WAIT}")
def d6_awaiting(spark, sf):
    return T.awaiting(pred(spark, sf), cut()).select("id", "project")


COUNTS = """
cnt as (select p.project, t_us, count(*) filter (c_us < t_us and (x_us is null or x_us > t_us) and (fe_us is null or fe_us > t_us)) as n_waiting
        from pred p cross join cal group by all)"""


@book.query("d6_waiting_counts", o.with_(o.PREDICTIONS, CAL_SQL, COUNTS) + "select * from cnt")
def d6_waiting_counts(spark, sf):
    return T.waiting_counts(pred(spark, sf), CALENDAR, SETTINGS_T).select("project", micros("at").alias("t_us"), "n_waiting")


@book.query("d7_outcome", o.with_(o.PREDICTIONS) + f"select id, {OUTCOME} as outcome from pred")
def d7_outcome(spark, sf):
    return pred(spark, sf).select("id", T.outcome().alias("outcome"))


@book.query("d8_ranked", o.with_(o.PREDICTIONS, RANKED) + """
select project, id, rank, p_hat as risk, url, title, days_waited, outcome, is_slow as stalled from rk""")
def d8_ranked(spark, sf):
    return T.ranked(pred(spark, sf), cut()).withColumn("days_waited", F.round("days_waited", 6))


@book.query("d9_tally", o.with_(o.PREDICTIONS, RANKED) + """
select project, count(*) filter (is_slow) as stalled, count(*) as k from rk where rank <= 3 group by project""")
def d9_tally(spark, sf):
    return T.tally(pred(spark, sf), cut())


@book.query("d10_default_project", o.with_(o.PREDICTIONS, CAL_SQL, COUNTS) + """
select t_us, project, n_waiting from (select *, row_number() over (partition by t_us order by n_waiting desc, project) as rn from cnt) where rn = 1""")
def d10_default_project(spark, sf):
    counts = T.waiting_counts(pred(spark, sf), CALENDAR, SETTINGS_T)
    return T.default_project(counts).select(micros("at").alias("t_us"), "project", "n_waiting")


def references(spark, sf):
    return OrderTables(spark, sf).history().selectExpr(
        "number as ref_id",
        "case number % 5 when 0 then concat('see https://github.com/acme/', project, '/pull/', number, ' please')"
        " when 1 then concat('acme/', lower(project), '#', number) when 2 then concat(' #', number, ' ')"
        " when 3 then cast(number as string) else concat('order ', number) end as text", "project as home")


@book.query("d11_parse_reference", o.with_(o.SUBJECTS) + """
select number as ref_id, case number % 5 when 0 then concat('acme/', project) when 1 then concat('acme/', lower(project))
  when 4 then null else project end as project, case when number % 5 < 4 then cast(number as double) end as number from subj""")
def d11_parse_reference(spark, sf):
    p = references(spark, sf).withColumn("r", T.parse_reference("text", "home"))
    return p.select("ref_id", "r.project", F.col("r.number").cast("double").alias("number"))


@book.query("d12_find", o.with_(o.PREDICTIONS) + "select id from pred where number % 5 <> 4")
def d12_find(spark, sf):
    rows = pred(spark, sf).withColumn("project", F.concat(F.lit("Acme/"), "project"))
    asked = references(spark, sf).withColumn("r", T.parse_reference("text", F.concat(F.lit("acme/"), "home"))).select("r.*")
    return T.find(rows, asked.where("number is not null")).select("id")


@book.query("d13_rank_in_project", o.with_(o.PREDICTIONS) + """
select id, round(coalesce((rank() over (partition by project order by p_hat) - 1) / nullif(count(*) over (partition by project) - 1, 0), 0), 9) as share_lower,
       count(*) over (partition by project) - 1 as n_others from pred""")
def d13_rank_in_project(spark, sf):
    return T.rank_in_project(pred(spark, sf)).select("id", *r9("share_lower"), "n_others")


@book.query("d14_random_pick", o.with_(o.PREDICTIONS) + """
select project, id from (select project, id, row_number() over (partition by project order by md5(concat_ws(':', '3', id)), id) as rn from pred) where rn = 1""")
def d14_random_pick(spark, sf):
    return T.random_pick(pred(spark, sf), 3, ["project"])


@book.query("d15_wait_buckets", o.with_(o.PREDICTIONS, """
names as (select * from (values ('within an hour', false), ('1 hour to 1 day', false), ('1 to 7 days', false),
  ('after more than 7 days', true), ('closed without a review', true), ('never reviewed, still open', true)) v(bucket, stalled)),
bk as (select case when fe_us - c_us < 3600000000 then 'within an hour' when fe_us - c_us < 86400000000 then '1 hour to 1 day'
   when fe_us - c_us <= 604800000000 then '1 to 7 days' when fe_us is not null then 'after more than 7 days'
   when x_us is not null then 'closed without a review' else 'never reviewed, still open' end as bucket from pred)""") + """
select n.bucket, count(b.bucket) as count, round(count(b.bucket) / (select count(*) from bk), 9) as share, stalled
from names n left join bk b using (bucket) group by n.bucket, stalled""")
def d15_wait_buckets(spark, sf):
    return T.wait_buckets(pred(spark, sf)).select("bucket", "count", *r9("share"), "stalled")


@book.query("d16_wait_summary", o.with_(o.PREDICTIONS) + f"""
select project, round(avg(case when fe_us - c_us < {o.DAY} then 1.0 else 0.0 end), 9) as quick,
  round(avg(case when is_slow then 1.0 else 0.0 end), 9) as stalled,
  round(coalesce(avg(case when x_us - c_us < {o.DAY} then 1.0 else 0.0 end) filter (fe_us is null and x_us is not null), 0), 9) as closed_fast,
  round(avg(case when (fe_us is null or fe_us - c_us > 7 * {o.DAY}) and (x_us is null or x_us - c_us > 7 * {o.DAY}) then 1.0 else 0.0 end), 9) as limbo
from pred group by project""")
def d16_wait_summary(spark, sf):
    return T.wait_summary(pred(spark, sf), ["project"]).select("project", *r9("quick", "stalled", "closed_fast", "limbo"))


@book.query("d17_timeline", o.with_(o.PREDICTIONS) + f"""
select project, id, number, title, c_us, p_hat as risk, is_slow as stalled, coalesce({WAIT}, false) as waiting, {OUTCOME} as outcome from pred""")
def d17_timeline(spark, sf):
    return T.timeline(pred(spark, sf), cut()).withColumn("c_us", micros("created_at")).drop("created_at")


EMB = """
emb as (select cast(vec_id as varchar) as id, concat('g', label) as project, list_transform(embedding, lambda x: cast(x as double)) as c from embeddings),
cell as (select id, project, unnest(c) as push, unnest(range(len(c))) as position from emb),
ord2 as (select *, row_number() over (partition by id order by abs(push) desc, position) as place from cell)"""
NAMES = "transform(contributions, (v, i) -> concat('f', i))"


def explained(spark, sf):
    e = EmbeddingTables(spark, sf).attributions()
    return e.withColumn("labels", F.expr(NAMES)).withColumn("values", F.expr("transform(contributions, (v, i) -> cast(i as string))")).withColumn(
        "base", F.lit(-0.25))


@book.query("d2_format_drivers", o.with_(EMB) + """
select id, string_agg(concat('f', position, ' = ', position, ' ', case when push > 0 then '↑' else '↓' end), ' · ' order by place) as drivers
from ord2 where place <= 3 group by id""")
def d2_format_drivers(spark, sf):
    return explained(spark, sf).select("id", T.format_drivers("contributions", "labels", "values").alias("drivers"))


@book.query("d4_logit_gap", o.with_(EMB) + "select 0.0::double as gap, count(distinct id) as n from cell")
def d4_logit_gap(spark, sf):
    e = explained(spark, sf).withColumn("margin", F.expr("base + aggregate(contributions, 0D, (a, v) -> a + v)"))
    scored = e.withColumn("score", 1 / (1 + F.exp(-F.col("margin"))))
    return T.logit_gap(scored).select(*r9("gap")).withColumn("n", e.agg(F.count_distinct("id")).scalar())


@book.query("d18_why", o.with_(EMB) + """
select id, place - 1 as place, concat('f', position) as label, cast(position as varchar) as value, round(push, 9) as push from ord2 where place <= 8
union all select id, 8, 'all other 56 features', '', round(sum(push), 9) from ord2 where place > 8 group by id""")
def d18_why(spark, sf):
    return T.why(explained(spark, sf)).select("id", F.col("place").cast("long").alias("place"), "label", "value", *r9("push"))


@book.query("d19_importance_labels", o.with_(EMB) + """
select concat('f', position) as feature, concat('dimension ', position) as label, round(avg(abs(push)) / (select sum(m) from
   (select avg(abs(push)) as m from cell group by position)), 9) as share from cell group by position""")
def d19_importance_labels(spark, sf):
    from waitline.operators.attribution import importance

    imp = importance(EmbeddingTables(spark, sf).attributions(), [f"f{i}" for i in range(64)])
    names = imp.select("feature", F.concat(F.lit("dimension "), F.substring("feature", 2, 9)).alias("label"))
    return T.labelled_importance(imp, names).select("feature", "label", *r9("share"))


@book.query("d20_iso_week", o.with_(o.SUBJECTS) + """
select id, concat(isoyear(created_at), '-W', lpad(cast(week(created_at) as varchar), 2, '0')) as week from subj""")
def d20_iso_week(spark, sf):
    return OrderTables(spark, sf).subjects().select("id", iso_week("created_at").alias("week"))


# Waits of this binding are long, so "fine" subjects are rare; rows count as stalled above a score.
GAME = """
game as (select *, concat(isoyear(created_at), '-W', lpad(cast(week(created_at) as varchar), 2, '0')) as week from (
   select * replace (number % 3 = 0 as is_slow) from pred)),
elw as (select project, week, count(*) filter (is_slow) as n_slow, count(*) filter (not is_slow) as n_fine from game
        group by all having count(*) filter (is_slow) >= 1 and count(*) filter (not is_slow) >= 3)"""


def game(spark, sf):
    return pred(spark, sf).withColumn("is_slow", F.col("number") % 3 == 0)


@book.query("d21_eligible_weeks", o.with_(o.PREDICTIONS, GAME) + "select * from elw")
def d21_eligible_weeks(spark, sf):
    return T.eligible_weeks(game(spark, sf))


DEAL = """
wk as (select project, week, row_number() over (order by md5(concat(project, '|', week)), project, week) - 1 as slot, count(*) over () as n from elw),
rounds as (select draw, project, week from (select d.draw, ('0x' || substr(md5(concat_ws(':', '9', 'week', d.draw)), 1, 8))::bigint
             % (select max(n) from wk) as slot from range(500) d(draw)) join wk using (slot)),
mem as (select r.draw, g.*, row_number() over (partition by r.draw, is_slow order by md5(concat_ws(':', '9', r.draw, id)), id) as rn
        from rounds r join game g using (project, week)),
dealt as (select *, row_number() over (partition by draw order by md5(concat_ws(':', '9', 'place', draw, id)), id) as place
          from mem where (is_slow and rn = 1) or (not is_slow and rn <= 3))"""


@book.query("d22_deal", o.with_(o.PREDICTIONS, GAME, DEAL) + "select draw, place, id, is_slow from dealt")
def d22_deal(spark, sf):
    return T.deal(game(spark, sf), 500, 9).select("draw", F.col("place").cast("long").alias("place"), "id", "is_slow")


@book.query("d23_model_pick", o.with_(o.PREDICTIONS, GAME, DEAL) + """
select draw, id, is_slow as hit from (select *, row_number() over (partition by draw order by p_hat desc, number) as k from dealt) where k = 1""")
def d23_model_pick(spark, sf):
    return T.model_pick(T.deal(game(spark, sf), 500, 9))


@book.query("d24_game_hit_rate", o.with_(o.PREDICTIONS, GAME, """
wins as (select s.project, s.week, s.id, e.n_fine, count(f.id) as l from game s join elw e using (project, week)
   left join game f on f.project = s.project and f.week = s.week and not f.is_slow
     and (f.p_hat < s.p_hat or (f.p_hat = s.p_hat and f.number > s.number)) where s.is_slow group by all)""") + """
select round(avg(r), 9) as hit_rate, count(*) as n_groups from (select project, week,
   avg(cast(l as double) * greatest(l - 1, 0) * greatest(l - 2, 0) / (cast(n_fine as double) * (n_fine - 1) * (n_fine - 2))) as r from wins group by all)""")
def d24_game_hit_rate(spark, sf):
    return T.game_hit_rate(game(spark, sf)).select(*r9("hit_rate"), "n_groups")


def extract(spark, sf):
    t = OrderTables(spark, sf)
    s = t.scenarios()
    contributions = t.history().select("id", F.array(F.col("number") % 7, F.col("number") % 5).alias("contributions"))
    return T.serving_extract(s.where("scenario = 'A'"), s.where("scenario = 'B'"), t.subjects(), t.labels(), contributions)


@book.query("d1_serving_extract", o.with_(o.SCENARIOS) + """
select a.id, a.project, a.number, a.title, a.c_us, a.is_slow, a.p_hat as score_a, a.baseline_score, b.fold as fold_b, b.p_hat as score_b,
  a.number % 7 + a.number % 5 as total from scen a join scen b using (id) where a.scenario = 'A' and b.scenario = 'B'""")
def d1_serving_extract(spark, sf):
    return extract(spark, sf).select(
        "id", "project", "number", "title", micros("created_at").alias("c_us"), "is_slow", "score_a", "baseline_score",
        F.col("fold_b").cast("long").alias("fold_b"), "score_b",
        F.expr("contributions[0] + contributions[1]").alias("total"))


@book.query("d5_extract_problems", o.with_(o.SCENARIOS) + f"""
select 'missing number' as check, 0::bigint as n union all select 'missing first_response_at', count(*) from pred where c_us >= {o.CUT} and fe_us is null
union all select 'wrong fold', 0 union all select 'repeated id', 0""")
def d5_extract_problems(spark, sf):
    e = extract(spark, sf)
    return T.extract_problems(e, group_folds(pred(spark, sf), 5), ["number", "first_response_at"])


QUERIES, ORACLES = book.queries, book.oracles
