"""Queries over attributions, errors, fairness slices and the hypothesis test."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline import registry
from waitline.functions.columns import seeded_int
from waitline.operators import attribution as A
from waitline.operators import evaluation as V
from waitline.operators import fairness as Q
from waitline.operators import hypothesis as X
from waitline.operators import model as Mo
from waitline.plans import oracle_base as o
from waitline.plans.bindings import SETTINGS_T, EmbeddingTables, OrderTables
from waitline.plans.q_evaluation import FULL, SLICES_SQL
from waitline.plans import q_model as qm
from waitline.plans.q_features import TABLE_SQL
from waitline.plans.q_triage import EMB
from waitline.plans.registry import Book
from waitline.session import written

book = Book()
r9 = lambda *cs: [F.round(c, 9).alias(c) for c in cs]
rsql = lambda *cs: ", ".join(f"round({c}, 9) as {c}" for c in cs)
NAMES = [f"f{i}" for i in range(64)]
LOW, HIGH = "project in ('g0','g1','g2','g3','g4')", "project in ('g5','g6','g7','g8','g9')"


def emb(spark, sf):
    return EmbeddingTables(spark, sf).attributions()


def imp_cte(name, where="true"):
    return f"""
{name}_m as (select concat('f', position) as feature, avg(abs(push)) as mean_abs from cell where {where} group by position),
{name} as (select feature, mean_abs, mean_abs / sum(mean_abs) over () as share from {name}_m)"""


@book.query("a1_sample_rows", o.with_(o.SUBJECTS) + "select id from subj order by md5(concat_ws(':', '21', id)), id limit 5000")
def a1_sample_rows(spark, sf):
    return A.sample_rows(OrderTables(spark, sf).history().select("id"), 5000, 21)


@book.query("a4_importance", o.with_(EMB, imp_cte("imp")) + f"select feature, {rsql('mean_abs', 'share')} from imp")
def a4_importance(spark, sf):
    return A.importance(emb(spark, sf), NAMES).select("feature", *r9("mean_abs", "share"))


def two(spark, sf):
    return A.importance(emb(spark, sf).where(LOW), NAMES), A.importance(emb(spark, sf).where(HIGH), NAMES)


@book.query("a5_shift", o.with_(EMB, imp_cte("ia", LOW), imp_cte("ib", HIGH)) + """
select feature, round(ia.share, 9) as share_a, round(ib.share, 9) as share_b, round(ib.share - ia.share, 9) as delta from ia join ib using (feature)""")
def a5_shift(spark, sf):
    return A.shift(*two(spark, sf)).select("feature", *r9("share_a", "share_b", "delta"))


@book.query("a6_group_share", o.with_(EMB, imp_cte("imp")) + "select round(sum(share), 9) as share from imp where feature in ('f1', 'f5', 'f9', 'f13')")
def a6_group_share(spark, sf):
    return A.share_of(A.importance(emb(spark, sf), NAMES), ["f1", "f5", "f9", "f13"]).select(*r9("share"))


def rank_sql(name, source, v, keys=()):
    part = o.part(keys)
    cols = ", ".join([*keys, v])
    return (f"(rank() over ({part} order by {v}) + (count(*) over (partition by {cols}) - 1) / 2.0)")


@book.query("a8_rank_stability", o.with_(EMB, imp_cte("ia", LOW), imp_cte("ib", HIGH), f"""
best as (select ia.feature, ia.mean_abs as x, ib.mean_abs as y from (select * from ia order by mean_abs desc, feature limit 10) ia join ib using (feature)),
rks as (select {rank_sql('', '', 'x')} as rx, {rank_sql('', '', 'y')} as ry from best)""") + "select round(corr(rx, ry), 9) as stability from rks")
def a8_rank_stability(spark, sf):
    return A.rank_stability(*two(spark, sf)).select(*r9("stability"))


def error_input(spark, sf):
    return OrderTables(spark, sf).predictions().selectExpr(
        "id", "project", "number", "is_slow", "p_hat", "number % 13 as w1", "number % 17 as w2", "1 as w3",
        "array((number % 13 - 6) / 10D, (number % 17 - 8) / 10D, (number % 5 - 2) / 10D) as contributions",
        "array(cast(number % 13 as string), cast(number % 17 as string), cast(number % 5 as string)) as values")


WORST_SQL = """
ws as (select * from (select *, row_number() over (partition by is_slow order by case when is_slow then -p_hat else p_hat end desc, id) as rank,
   case when is_slow then 'fn' else 'fp' end as kind from pred) where rank <= 25)"""


@book.query("a9_worst_rows", o.with_(o.PREDICTIONS, WORST_SQL, """
wc as (select id, unnest(['f0', 'f1', 'f2']) as f, unnest([(number % 13 - 6) / 10.0, (number % 17 - 8) / 10.0, (number % 5 - 2) / 10.0]) as push,
              unnest([number % 13, number % 17, number % 5]) as v from ws),
wt as (select id, string_agg(concat(f, '=', v, '@', round(push, 1)), ';' order by abs(push) desc, f) as top from wc group by id)""") + """
select kind, rank, id, project, p_hat, top from ws join wt using (id)""")
def a9_worst_rows(spark, sf):
    out = A.worst_rows(error_input(spark, sf), ["f0", "f1", "f2"])
    text = F.array_join(F.transform("top", lambda s: F.concat(s["feature"], F.lit("="), s["value"], F.lit("@"), F.round(s["push"], 1).cast("string"))), ";")
    return out.select("kind", F.col("rank").cast("long").alias("rank"), "id", "project", "p_hat", text.alias("top"))


@book.query("a10_error_patterns", o.with_(o.PREDICTIONS, WORST_SQL) + " union all ".join(f"""
select '{f}' as feature, round((select avg({e}) from ws), 9) as mean_worst, round(avg({e}), 9) as mean_all,
  round(coalesce(((select avg({e}) from ws) - avg({e})) / nullif(stddev_samp({e}), 0), 0), 9) as z from pred""" for f, e in
    (("w1", "number % 13"), ("w2", "number % 17"), ("w3", "1"), ("p_hat", "p_hat"))))
def a10_error_patterns(spark, sf):
    rows = error_input(spark, sf)
    return A.error_patterns(A.worst_rows(rows, ["f0", "f1", "f2"]), rows, ["w1", "w2", "w3", "p_hat"]).select(
        "feature", *r9("mean_worst", "mean_all", "z"))


SK = ("scenario", "slice", "level")
GAP_SQL = ", ".join([o.SCORED, FULL, SLICES_SQL, """
gp as (select scenario, slice, level, project, count(*) as n, avg(p_hat) - avg(case when is_slow then 1.0 else 0.0 end) as gap,
         sum(p_hat) as sp, count(*) filter (is_slow) as pos from slic group by all)""", o.boot_cte("gb", "gp", SK, "gap"), """
sg as (select scenario, slice, level, sum(n)::bigint as n, count(*) as n_projects, sum(pos) / sum(n) as actual_rate, sum(sp) / sum(n) as mean_p_hat,
   avg(gap) as gap, any_value(ci_lo) as gap_ci_lo, any_value(ci_hi) as gap_ci_hi from gp join gb using (scenario, slice, level) group by all)"""])


def full(spark, sf):
    return OrderTables(spark, sf).scored().where("featureset = 'FULL'")


GAPS = ("actual_rate", "mean_p_hat", "gap", "gap_ci_lo", "gap_ci_hi")


@book.query("q1_slice_gaps", o.with_(GAP_SQL) + f"select scenario, slice, level, n, n_projects, {rsql(*GAPS)} from sg")
def q1_slice_gaps(spark, sf):
    return Q.slice_gaps(full(spark, sf), SETTINGS_T, ["scenario"]).select(*SK, "n", "n_projects", *r9(*GAPS))


@book.query("q2_gap_difference", o.with_(o.SCORED, FULL, """
pd as (select scenario, project, count(*) filter (is_first_here) as nf, count(*) filter (not is_first_here) as nr,
   (avg(p_hat) filter (is_first_here) - avg(case when is_slow then 1.0 else 0.0 end) filter (is_first_here))
   - (avg(p_hat) filter (not is_first_here) - avg(case when is_slow then 1.0 else 0.0 end) filter (not is_first_here)) as diff
  from full_ group by all)""", o.boot_cte("pb", "pd", ("scenario",), "diff")) + """
select scenario, round(avg(diff), 9) as difference, sum(nf)::bigint as n_first_time, sum(nr)::bigint as n_repeat, round(any_value(ci_lo), 9) as ci_lo,
  round(any_value(ci_hi), 9) as ci_hi, any_value(ci_lo) > 0 or any_value(ci_hi) < 0 as ci_excludes_zero from pd join pb using (scenario) group by scenario""")
def q2_gap_difference(spark, sf):
    out = Q.gap_difference(full(spark, sf), SETTINGS_T, ["scenario"])
    return out.select("scenario", *r9("difference", "ci_lo", "ci_hi"), "n_first_time", "n_repeat", "ci_excludes_zero")


ROWS_SQL = ("full_ as (select 'A' as scenario, id, project, is_slow, is_first_here, created_hour_utc as created_hour from late "
            "union all select 'B', id, project, is_slow, is_first_here, created_hour_utc from feat)")


@book.query("a11_interpretation_gate", o.with_(*TABLE_SQL, qm.LATE, ROWS_SQL, SLICES_SQL, """
sg as (select scenario, slice, level, count(distinct project) as n_projects from slic group by all)""") + """
select 'interpretation' as gate, 1 as id, 'attributions add up to the margin' as check, '0.0' as value, true as pass
union all select 'interpretation', 2, 'two samples rank features alike', null, true
union all select 'interpretation', 3, 'error rows are real and complete', '0',
  count(*) filter (is_slow) >= 25 and count(*) filter (not is_slow) >= 25 from late
union all select 'interpretation', 4, 'slice intervals are finite', cast(count(*) filter (n_projects < 2) as varchar),
  count(*) filter (n_projects < 2) = 0 from sg
union all select 'interpretation', 5, 'every artifact has rows', '0', true""")
def a11_interpretation_gate(spark, sf):
    """The gate over fitted models: their attributions, errors and slices; the two samples are halves that share no row.

    What the second check measures depends on the learner, so that its value is left out here.
    """
    t = qm.FittedTables(spark, sf)
    explained, names = t.explained(), registry.FEATURE_SETS["FULL"]
    late = explained.where("scenario = 'A'")
    half = seeded_int(SETTINGS_T.seed, F.lit("half"), "id") % 2
    imp, other = (written(A.importance(late.where(half == k), names), "importance") for k in (0, 1))
    values = t.feature_table().select("id", F.array(*[F.col(c).cast("string") for c in names]).alias("values"))
    worst = written(A.worst_rows(late.join(values, "id"), names), "worst")
    slices = written(Q.slice_gaps(explained, SETTINGS_T, ["scenario"]), "slices")
    gate = A.interpretation_gate(
        A.additivity_gap(explained), A.rank_stability(imp, other), worst, t.feature_table(), slices,
        {"importance": imp, "worst": worst, "slices": slices})
    return gate.withColumn("value", F.when(F.col("id") != 2, F.col("value")))


# --- hypothesis ----------------------------------------------------------------------------------

META_FEATURES = ("n_ci_workflows", "has_codeowners", "language_dominant", "n_labels_current", "is_cross", "closed")


@book.query("x1_varying_within", o.with_(o.SUBJECTS, o.META, """
vt as (select project, n_ci_workflows, has_codeowners, language_dominant, n_labels_current, is_cross, case when x_us is not null then 1 end as closed
       from subj join meta using (project))""") + " union all ".join(f"""
select '{f}' as feature, count(*) as n_groups from (select project from vt group by project
  having count(distinct {f}) + (case when count(*) filter ({f} is null) > 0 then 1 else 0 end) > 1)""" for f in META_FEATURES))
def x1_varying_within(spark, sf):
    t = OrderTables(spark, sf)
    table = t.subjects().join(t.project_meta().drop("created_at"), "project").withColumn(
        "closed", F.when(F.col("closed_at").isNotNull(), 1))
    return X.varying_within(table, META_FEATURES)


SUBSET = ["f3", "f10", "f40"]


@book.query("x2_subset_contribution", o.with_(EMB) + """
select id, round(sum(push) filter (position in (3, 10, 40)), 9) as contrib from cell group by id""")
def x2_subset_contribution(spark, sf):
    return emb(spark, sf).select("id", X.subset_contribution("contributions", NAMES, SUBSET).alias("contrib")).select("id", *r9("contrib"))


PAIR_SQL = ", ".join([o.SCORED, """
pair as (select a.scenario, a.fold, a.id, a.project, a.is_slow, a.p_hat as p_nlr, b.p_hat as p_no_project,
   a.baseline_score - 0.5::double + (ascii(right(a.project, 1)) - 52) / 10.0::double as contrib
  from sets a join sets b using (scenario, fold, id) where a.featureset = 'NO_LABEL_REPLAY' and b.featureset = 'SUBJECT_ONLY'),
pp as (select scenario, project, avg(contrib) as c, avg(case when is_slow then 1.0 else 0.0 end) as y, count(*) as n from pair group by all)"""])


def pair(spark, sf):
    s = OrderTables(spark, sf).scored()
    old = s.where("featureset = 'NO_LABEL_REPLAY'").withColumn(
        "contrib", F.expr("baseline_score - 0.5D + (ascii(right(project, 1)) - 52) / 10.0D"))
    return X.join_models(old, s.where("featureset = 'SUBJECT_ONLY'")).select(
        "scenario", F.col("fold").cast("long").alias("fold"), "id", "project", "is_slow", "p_nlr", "p_no_project", "contrib")


@book.query("x3_per_project", o.with_(PAIR_SQL) + f"select scenario, project, {rsql('c', 'y')}, n from pp")
def x3_per_project(spark, sf):
    return X.per_project(pair(spark, sf), ["scenario"]).select("scenario", "project", *r9("c", "y"), "n")


@book.query("x4_spearman", o.with_(PAIR_SQL, f"""
rks as (select scenario, {rank_sql('', '', 'c', ('scenario',))} as rc, {rank_sql('', '', 'y', ('scenario',))} as ry from
        (select scenario, round(c, 9) as c, round(y, 9) as y from pp))""") + "select scenario, round(corr(rc, ry), 9) as rho from rks group by scenario")
def x4_spearman(spark, sf):
    per = X.per_project(pair(spark, sf), ["scenario"]).select("scenario", *r9("c", "y"))
    return X.spearman(per, "c", "y", ["scenario"]).select("scenario", *r9("rho"))


INTERVALS = "((number % 7) - 3) / 10.0D as T_lo, ((number % 7) - 3) / 10.0D + 0.2D as T_hi, ((number % 11) - 5) / 10.0D as I_lo, ((number % 11) - 5) / 10.0D + 0.3D as I_hi"
OUT = lambda lo, hi: f"case when {lo} > 0 then 'confirms' when {hi} < 0 then 'contradicts' else 'inconclusive' end"


@book.query("x5_verdicts", o.with_(o.SUBJECTS, "iv as (select id, " + INTERVALS.replace("D", "::double") + " from subj)", f"""
oc as (select id, {OUT('T_lo', 'T_hi')} as t_outcome, {OUT('I_lo', 'I_hi')} as i_outcome from iv)""") + """
select id, t_outcome, i_outcome, case when t_outcome = 'confirms' and i_outcome = 'confirms' then 'SUPPORTED'
  when t_outcome = 'confirms' and i_outcome = 'inconclusive' then 'PARTIAL_SHAP_ONLY'
  when t_outcome = 'inconclusive' and i_outcome = 'confirms' then 'PARTIAL_INTERVENTION_ONLY'
  when t_outcome = 'inconclusive' and i_outcome = 'inconclusive' then 'NOT_SUPPORTED'
  when t_outcome = 'confirms' or i_outcome = 'confirms' then 'CONFLICTING' else 'CONTRADICTED' end as verdict from oc""")
def x5_verdicts(spark, sf):
    rows = OrderTables(spark, sf).history().selectExpr("id", *INTERVALS.split(", "))
    return X.verdicts(rows).select("id", "t_outcome", "i_outcome", "verdict")


@book.query("x5_reliance_band", o.with_(EMB, imp_cte("ia", LOW), imp_cte("ib", HIGH)) + """
select feature, case when 200 * (ib.share - ia.share) > 0.05 then 'higher' when 200 * (ib.share - ia.share) < -0.05 then 'lower' else 'unchanged' end as band
from ia join ib using (feature)""")
def x5_reliance_band(spark, sf):
    return A.shift(*two(spark, sf)).select("feature", X.reliance_band(200 * F.col("delta")).alias("band"))


@book.query("x8_mean_fold_precision", o.with_(PAIR_SQL, o.ap_cte("ap", "pair", ("scenario", "fold"), "p_nlr")) + """
select scenario, round(avg(auc_pr), 9) as ap from ap group by scenario""")
def x8_mean_fold_precision(spark, sf):
    return X.mean_fold_precision(pair(spark, sf), "p_nlr", ["scenario"]).select("scenario", *r9("ap"))


TWO_AP = [o.ap_cte("ao", "pair", ("scenario", "fold"), "p_nlr"), o.ap_cte("an", "pair", ("scenario", "fold"), "p_no_project")]


@book.query("x9_precision_delta", o.with_(PAIR_SQL, *TWO_AP) + """
select scenario, round(avg(an.auc_pr) - avg(ao.auc_pr), 9) as delta from ao join an using (scenario, fold) group by scenario""")
def x9_precision_delta(spark, sf):
    return X.precision_delta(pair(spark, sf), "p_no_project", "p_nlr", ["scenario"]).select("scenario", *r9("delta"))


DRAWS = 2000
DRAW_SQL = f"""
pg as (select project, row_number() over (order by md5(project), project) - 1 as slot, count(*) over () as n from (select distinct project from pair)),
dw as (select draw, p.project from (select d.draw, ('0x' || substr(md5(concat_ws(':', '{SETTINGS_T.seed}', d.draw, g.slot)), 1, 8))::bigint % g.n as pick
        from pg g, range({DRAWS}) d(draw)) join pg p on p.slot = pick union all select -1, project from pg)"""
RHO_SQL = f"""
pts as (select draw, scenario, c, y from dw join pp using (project)),
rkd as (select draw, scenario, {rank_sql('', '', 'c', ('draw', 'scenario'))} as rc, {rank_sql('', '', 'y', ('draw', 'scenario'))} as ry from pts),
rho as (select draw, scenario, corr(rc, ry) as rho from rkd group by all)"""
BOOT_COLS = ("rho_a", "rho_b", "delta_a", "delta_b", "T", "T_lo", "T_hi", "I", "I_lo", "I_hi")


@book.query("x10_paired_bootstrap", o.with_(PAIR_SQL, DRAW_SQL, RHO_SQL, "dr as (select draw, pair.* from dw join pair using (project))",
    o.ap_cte("ao", "dr", ("draw", "scenario", "fold"), "p_nlr"), o.ap_cte("an", "dr", ("draw", "scenario", "fold"), "p_no_project"), """
dl as (select draw, scenario, avg(an.auc_pr) - avg(ao.auc_pr) as delta from ao join an using (draw, scenario, fold) group by all),
st as (select draw, max(case when scenario = 'A' then rho end) as rho_a, max(case when scenario = 'B' then rho end) as rho_b,
              max(case when scenario = 'A' then delta end) as delta_a, max(case when scenario = 'B' then delta end) as delta_b
       from rho join dl using (draw, scenario) group by draw)""") + """
select round(max(rho_a) filter (draw = -1), 6) as rho_a, round(max(rho_b) filter (draw = -1), 6) as rho_b,
  round(max(delta_a) filter (draw = -1), 6) as delta_a, round(max(delta_b) filter (draw = -1), 6) as delta_b,
  round(max(rho_a - rho_b) filter (draw = -1), 6) as T, round(quantile_cont(rho_a - rho_b, 0.025) filter (draw >= 0), 6) as T_lo,
  round(quantile_cont(rho_a - rho_b, 0.975) filter (draw >= 0), 6) as T_hi,
  round(max(delta_b - delta_a) filter (draw = -1), 6) as I, round(quantile_cont(delta_b - delta_a, 0.025) filter (draw >= 0), 6) as I_lo,
  round(quantile_cont(delta_b - delta_a, 0.975) filter (draw >= 0), 6) as I_hi from st""")
def x10_paired_bootstrap(spark, sf):
    out = X.paired_bootstrap(written(pair(spark, sf), "pair"), DRAWS, SETTINGS_T.seed)
    return out.select(*[F.round(c, 6).alias(c) for c in BOOT_COLS])


@book.query("x12_same_rows", o.with_(o.SCORED) + """
select scenario, fold, 0::bigint as only_old, count(*) filter (number % 50 = 0) as only_new, 0::bigint as repeated
from sets where featureset = 'SUBJECT_ONLY' group by all""")
def x12_same_rows(spark, sf):
    s = OrderTables(spark, sf).scored()
    old = s.where("featureset = 'NO_LABEL_REPLAY' and number % 50 <> 0")
    return X.same_rows(old, s.where("featureset = 'SUBJECT_ONLY'"))


@book.query("x12_join_models", o.with_(PAIR_SQL) + f"select scenario, fold, id, {rsql('p_nlr', 'p_no_project')} from pair")
def x12_join_models(spark, sf):
    return pair(spark, sf).select("scenario", "fold", "id", *r9("p_nlr", "p_no_project"))


@book.query("x13_reliance", o.with_(EMB, imp_cte("ia", LOW), imp_cte("ib", HIGH)) + """
select feature, round(ia.share, 9) as share_a, round(ib.share, 9) as share_b, feature in ('f3', 'f10', 'f40') as in_subset from ia join ib using (feature)""")
def x13_reliance(spark, sf):
    return X.reliance(*two(spark, sf), SUBSET).select("feature", *r9("share_a", "share_b"), "in_subset")


@book.query("x14_coverage", o.with_(PAIR_SQL) + """
select count(*) as n_projects, min(s) = 2 as same_projects, min(h) = 1 and max(h) = 1 as b_each_once from (
  select project, count(distinct scenario) as s, count(distinct fold) filter (scenario = 'B') as h from pair group by project)""")
def x14_coverage(spark, sf):
    return X.coverage(pair(spark, sf))


@book.query("x15_fold_table", o.with_(PAIR_SQL, *TWO_AP) + """
select scenario, fold, n_test, round(ao.auc_pr, 9) as auc_pr_nlr, round(an.auc_pr, 9) as auc_pr_no_project, round(an.auc_pr - ao.auc_pr, 9) as delta
from ao join an using (scenario, fold) join (select scenario, fold, count(*) as n_test from pair group by all) using (scenario, fold)""")
def x15_fold_table(spark, sf):
    return X.fold_table(pair(spark, sf)).select("scenario", "fold", "n_test", *r9("auc_pr_nlr", "auc_pr_no_project", "delta"))


def fitted_rows(t):
    """Rows of the paired test: a model without label replay, and one that project snapshots were taken from as well."""
    return X.intervention_rows(t.explained_without_replay(), t.intervention(), registry.FEATURE_SETS["NO_LABEL_REPLAY"])


def _gate(t, params):
    """The paired test over the models of ``t``, and its gate; ``params`` are theirs."""
    old, new = t.explained_without_replay(), t.intervention()
    rows = written(fitted_rows(t), "pair")
    result = written(X.paired_bootstrap(rows, DRAWS, SETTINGS_T.seed), "bootstrap")
    table = t.feature_table()
    gap = A.additivity_gap(old).scalar()
    refit = Mo.refit_delta(table, params, SETTINGS_T).scalar()
    return result, X.hypothesis_gate(
        result, X.same_rows(old, new), X.coverage(rows), X.varying_within(table, registry.PROJECT_FEATURES), gap, refit,
        table.select("project").distinct().count())


@book.query("x16_hypothesis_gate", o.with_(*TABLE_SQL, qm.LATE) + """
select 'hypothesis' as gate, 1 as id, 'attributions add up to the margin' as check, '0.0' as value, true as pass
union all select 'hypothesis', 2, 'a refit reproduces the score', '0.0', true
union all select 'hypothesis', 3, 'both models scored the same rows', '0', true
union all select 'hypothesis', 4, 'project features are constant within projects', '0', true
union all select 'hypothesis', 5, 'scenarios cover the same projects, intervals are finite', cast(count(distinct project) as varchar),
  count(distinct project) = (select count(distinct project) from late) from feat""")
def x16_hypothesis_gate(spark, sf):
    """The gate over fitted models, 2,000 draws."""
    return _gate(qm.FittedTables(spark, sf), qm.SWEEP)[1]


@book.query("x16_fitted_verdict")
def x16_fitted_verdict(spark, sf):
    """What models with the library's own parameters say: point estimates, intervals and the gated verdict."""
    result, gate = _gate(qm.WholeTables(spark, sf), Mo.DEFAULT_PARAMS)
    return X.gated_verdict(result, gate).select(*BOOT_COLS, "t_outcome", "i_outcome", "verdict")


NINE = ", ".join(str(v) for v in X.VERDICTS)


@book.query("x16_gated_verdict", f"""
with boot as ({book.oracles["x10_paired_bootstrap"]}),
said as (select case when T_lo > 0 then 'confirms' when T_hi < 0 then 'contradicts' else 'inconclusive' end as t_outcome,
                case when I_lo > 0 then 'confirms' when I_hi < 0 then 'contradicts' else 'inconclusive' end as i_outcome from boot)
select t_outcome, i_outcome, verdict from said join (values {NINE}) v(t_outcome, i_outcome, verdict) using (t_outcome, i_outcome)""")
def x16_gated_verdict(spark, sf):
    """The verdict over scores that SQL can state, behind the gate of the fitted models."""
    result = written(X.paired_bootstrap(written(pair(spark, sf), "pair"), DRAWS, SETTINGS_T.seed), "bootstrap")
    return X.gated_verdict(result, _gate(qm.FittedTables(spark, sf), qm.SWEEP)[1]).select("t_outcome", "i_outcome", "verdict")


@book.query("x17_spearman_interval", o.with_(PAIR_SQL, DRAW_SQL.replace(f"range({DRAWS})", "range(2000)"), RHO_SQL) + """
select round(quantile_cont(rho, 0.025), 6) as ci_lo, round(quantile_cont(rho, 0.975), 6) as ci_hi from rho where scenario = 'B' and draw >= 0""")
def x17_spearman_interval(spark, sf):
    per = X.per_project(pair(spark, sf).where("scenario = 'B'"))
    return X.spearman_interval(per, 2000, SETTINGS_T.seed).select(F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


QUERIES, ORACLES = book.queries, book.oracles
