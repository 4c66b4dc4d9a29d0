"""The leak-free feature table: assembly, contract, audit and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline import registry
from waitline.conf import Settings
from waitline.functions.columns import instant, truthy
from waitline.operators import atopen, labels, replay
from waitline.session import written


def priors(rows: DataFrame, settings: Settings) -> DataFrame:
    """One row (g, g_merge): rates over rows opened before the cutoff, or over all if there are none."""
    cutoff = instant(settings.cutoff)
    early = F.col("created_at") < cutoff
    slow = F.col("is_slow").cast("double")
    merged = F.coalesce(F.col("merged_at") < cutoff, F.lit(False)).cast("double")
    return rows.agg(
        F.coalesce(F.avg(F.when(early, slow)), F.avg(slow)).alias("g"),
        F.coalesce(F.avg(F.when(early, merged)), F.avg(merged)).alias("g_merge"),
    )


def build(
    subjects: DataFrame,
    history: DataFrame,
    responses: DataFrame,
    timeline: DataFrame,
    at_open_diff: DataFrame,
    project_meta: DataFrame,
    kept: DataFrame,
    settings: Settings,
) -> DataFrame:
    """One row per modelling subject with every registered column.

    Raises if a project has no metadata.  The chosen subjects and their labels feed several places, so each is written
    once; so is the metadata, whose size is known then, so that no wide row is shuffled to its project.  What a row or its project says by itself is added in place and travels through the at-open join; only labels
    and replay meet it on the id.
    """
    project_meta = written(project_meta, "project-meta")
    chosen = written(labels.modelling_rows(subjects, settings).join(kept.select("project"), "project", "left_semi"), "chosen")
    atopen.require_meta(chosen, project_meta)
    marks = written(labels.label(chosen, responses, settings), "labels")
    rows = chosen.join(marks.select("id", "is_slow"), "id")
    g, g_merge = priors(rows, settings).first()
    outcome = marks.select("id", "is_slow", "wait_h", "wait_h_censored", "event_observed", "never_answered")
    wide = chosen.select("*", *atopen.static_columns())
    added = [c for c in wide.columns if c not in chosen.columns]
    known = atopen.at_open_features(
        wide, timeline, project_meta, settings, at_open_diff, ["project", "number", "created_at", *added])
    table = atopen.with_project_columns(known, project_meta).join(outcome, "id").join(
        replay.replay_features(chosen, history, marks, settings, g, g_merge), "id")
    return conform(table)


def conform(table: DataFrame) -> DataFrame:
    """Registered columns, in order and type; a missing or extra column is an error."""
    missing = [c for c in registry.COLUMNS if c not in table.columns]
    extra = [c for c in table.columns if c not in registry.COLUMNS]
    if missing or extra:
        raise ValueError(f"feature table drift: missing={missing} extra={extra}")
    return table.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in registry.table_schema()
    ])


def contract_violations(table: DataFrame) -> DataFrame:
    """One row per broken rule (column, problem, n): missing, extra, wrong type, illegal nulls."""
    spark = table.sparkSession
    declared = {f.name: f for f in registry.table_schema()}
    actual = {f.name: f.dataType for f in table.schema}
    found = [(c, "missing", 1) for c in declared if c not in actual]
    found += [(c, "extra", 1) for c in actual if c not in declared]
    found += [(c, "type", 1) for c, t in actual.items() if c in declared and t != declared[c].dataType]
    static = spark.createDataFrame(found, "column string, problem string, n long")
    strict = [c for c, f in declared.items() if c in actual and not f.nullable]
    nulls = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in strict])
    cells = ", ".join(f"'{c}', `{c}`" for c in strict)
    illegal = nulls.selectExpr(f"stack({len(strict)}, {cells}) as (column, n)").where("n > 0")
    return static.unionByName(illegal.select("column", F.lit("null").alias("problem"), "n"))


def project_set(table: DataFrame, name: str) -> DataFrame:
    """The table cut to one ablation set, with its key and outcome."""
    columns = registry.FEATURE_SETS[name]
    registry.check_hygiene(columns)
    return table.select("id", "is_slow", *columns)


def load_for_modelling(table: DataFrame) -> DataFrame:
    """Rows whose timeline was surely complete; order is by (created_at, id) wherever it matters."""
    return table.where(~truthy("timeline_may_be_truncated"))


def audit_differences(table: DataFrame, brute: DataFrame) -> DataFrame:
    """Largest difference per replay column between the table and a brute-force sample of it.

    A null or flag that differs counts as 1.
    """
    b = brute.select(F.col("probe_id").alias("id"), *[F.col(c).alias("b_" + c) for c in replay.REPLAY_COLUMNS])
    both = table.join(b, "id")

    def difference(c: str) -> Column:
        x, y = F.col(c).cast("double"), F.col("b_" + c).cast("double")
        one_null = x.isNull() != y.isNull()
        return F.when(one_null, 1.0).otherwise(F.coalesce(F.abs(x - y), F.lit(0.0)))

    wide = both.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(difference(c)).alias(c) for c in replay.REPLAY_COLUMNS],
    )
    cells = ", ".join(f"'{c}', {c}" for c in replay.REPLAY_COLUMNS)
    return wide.selectExpr("n", f"stack({len(replay.REPLAY_COLUMNS)}, {cells}) as (column, max_abs_diff)")


def audit(table: DataFrame, brute: DataFrame, expected_rows: Column) -> DataFrame:
    """The validity gate: conservation, replay equality, legal nulls, rate of capped timelines."""
    from waitline.operators.gates import checks

    strict = [c.name for c in registry.COLUMNS.values() if not c.nullable]
    facts = table.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(sum((F.col(c).isNull().cast("long") for c in strict), F.lit(0))).alias("illegal_nulls"),
        F.avg(F.col("timeline_may_be_truncated").cast("double")).alias("capped_rate"),
    )
    worst = audit_differences(table, brute).agg(F.max("max_abs_diff").alias("worst"))
    row = facts.withColumn("worst", worst.scalar()).withColumn("expected", expected_rows)
    return checks(row, "features", [
        (1, "row count is conserved", F.col("n_rows"), F.col("n_rows") == F.col("expected")),
        (2, "replay equals brute force", F.round("worst", 9), F.col("worst") < 1e-9),
        (3, "nulls only where allowed", F.col("illegal_nulls"), F.col("illegal_nulls") == 0),
        (4, "capped timelines below 2 %", F.round("capped_rate", 9), F.coalesce("capped_rate", F.lit(0.0)) < 0.02),
    ])


def explain(history: DataFrame, marks: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """The history rows behind each replay value of the asked probes, tagged counted or not.

    ``asked`` (probe_id, project, at, actor_login) is the handful of subjects a person looks at.
    """
    m = marks.select("id", "first_event_at", "is_slow")
    h = history.select("project", "id", "actor_login", "created_at", "closed_at").join(m, "id", "left")
    q = asked.select("probe_id", F.col("project").alias("_p"), "at", F.col("actor_login").alias("_who"))
    near = h.join(q, (F.col("project") == F.col("_p")) & (F.col("created_at") < F.col("at")))
    ago = lambda unit, n: F.expr(f"timestampadd({unit}, -{n}, at)")
    labelled = F.col("is_slow").isNotNull()
    usable = labelled & (
        (F.col("created_at") <= ago("SECOND", int(settings.threshold_h * 3600)))
        | F.coalesce(F.col("first_event_at") < F.col("at"), F.lit(False))
    )
    tag = F.when(usable, "counted").otherwise("not yet resolvable")
    reasons = F.array(
        F.when(F.col("closed_at").isNull() | (F.col("closed_at") > F.col("at")),
               F.struct(F.lit("backlog").alias("reason"), F.lit("counted").alias("tag"))),
        F.when(F.col("created_at") >= ago("DAY", settings.recent_days),
               F.struct(F.lit("recent").alias("reason"), F.lit("counted").alias("tag"))),
        F.when(F.col("actor_login") == F.col("_who"), F.struct(F.lit("actor").alias("reason"), tag.alias("tag"))),
        F.when(labelled & (F.col("created_at") >= ago("DAY", settings.trailing_days)),
               F.struct(F.lit("trailing").alias("reason"), tag.alias("tag"))),
    )
    return near.select("probe_id", F.explode(F.array_compact(reasons)).alias("r"), F.col("id").alias("evidence_id"),
                       "created_at").select("probe_id", "r.reason", "r.tag", "evidence_id", "created_at")
