"""The state a subject had when it was opened, from its current state and later events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.conf import Settings
from waitline.functions.columns import days_between, micros, truthy


def static_columns() -> list[Column]:
    """Facts of the subject itself that are fixed at opening, as columns of its row."""
    weekday = F.weekday("created_at")
    body = F.length(F.coalesce("body_current", F.lit("")))
    return [
        F.hour("created_at").alias("created_hour_utc"),
        weekday.alias("created_dayofweek"),
        (weekday >= 5).alias("is_weekend"),
        truthy("is_cross").alias("is_cross_project"),
        days_between("actor_created_at", "created_at").alias("actor_account_age_days"),
        body.alias("body_len"),
        (body > 0).alias("has_body"),
        F.col("last_edited_at").isNotNull().alias("body_edited"),
    ]


def static_features(rows: DataFrame) -> DataFrame:
    return rows.select("id", *static_columns())


def timeline_summary(rows: DataFrame, timeline: DataFrame, settings: Settings) -> DataFrame:
    """Per subject with events: everything needed to undo what happened after opening.

    One join and one aggregation answer all of it.  The earliest change wins even when its previous
    value is null, so the value travels inside a struct.
    """
    opened = rows.select("id", F.col("created_at").alias("opened_at"))
    e = timeline.join(opened, "id")
    after = F.col("created_at") > F.col("opened_at")
    kind = F.col("event_type")
    order = F.struct("created_at", "event_key")
    requested = (kind == "ReviewRequestedEvent") & (
        micros("created_at") <= micros("opened_at") + settings.request_grace_s * 1_000_000
    )
    return e.groupBy("id").agg(
        F.count_if(after & kind.isin("ReadyForReviewEvent", "ConvertToDraftEvent")).alias("flips"),
        F.count_if(after & (kind == "LabeledEvent")).alias("labels_added"),
        F.count_if(after & (kind == "UnlabeledEvent")).alias("labels_removed"),
        F.min_by(F.struct("previous_title"), F.when(after & (kind == "RenamedTitleEvent"), order)).alias("rename"),
        F.min_by(F.struct("previous_ref"), F.when(after & (kind == "BaseRefChangedEvent"), order)).alias("rebase"),
        F.count_if(requested).alias("requests"),
        F.count_if(requested & (F.col("requested_type") == "Team")).alias("team_requests"),
        F.count(F.lit(1)).alias("n_events"),
    )


def require_meta(rows: DataFrame, project_meta: DataFrame) -> None:
    """Raise when a project has no metadata row, naming a few of them."""
    missing = missing_meta(rows, project_meta).limit(6).collect()
    if missing:
        raise KeyError(f"no metadata for project(s) {sorted(str(r.project) for r in missing)[:5]}")


def missing_meta(rows: DataFrame, project_meta: DataFrame) -> DataFrame:
    """(project): the projects of ``rows`` without a metadata row."""
    return rows.select("project").distinct().join(project_meta.select("project"), "project", "left_anti")


def at_open_features(
    rows: DataFrame, timeline: DataFrame, project_meta: DataFrame, settings: Settings, at_open_diff: DataFrame,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Reconstructed at-open columns; ``at_open_diff`` is ``commits_at_open`` or an ingested equal.

    ``keep`` names columns of ``rows`` that travel along, which saves joining them again.
    """
    facts = timeline_summary(rows, timeline, settings)
    branches = project_meta.select("project", "default_branch")
    r = rows.join(facts, "id", "left").join(branches, "project", "left").join(at_open_diff, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    title = F.coalesce("rename.previous_title", "title_current", F.lit(""))
    base = F.coalesce("rebase.previous_ref", "base_ref_current")
    return r.select(
        "id", *keep,
        (truthy("is_draft_current") != (zero("flips") % 2 == 1)).alias("is_draft_at_open"),
        F.greatest(
            F.lit(0), F.coalesce("n_labels_current", F.lit(0)) - zero("labels_added") + zero("labels_removed")
        ).cast("long").alias("n_labels_at_open"),
        F.length(title).alias("title_len_at_open"),
        F.coalesce(base == F.col("default_branch"), F.lit(False)).alias("base_is_default"),
        (zero("requests") > 0).alias("reviewer_requested_at_open"),
        zero("requests").alias("n_reviewers_requested_at_open"),
        (zero("team_requests") > 0).alias("requested_team_at_open"),
        F.col("additions_at_open").cast("double").alias("additions_at_open"),
        F.col("deletions_at_open").cast("double").alias("deletions_at_open"),
        F.col("n_commits_at_open").cast("double").alias("n_commits_at_open"),
        truthy("diff_is_exact").alias("diff_is_exact"),
        (zero("n_events") >= settings.timeline_cap).alias("timeline_may_be_truncated"),
    )


def commits_at_open(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Size of the change at opening: commits authored no later than the opening.

    No such commit means unknown (null); a real zero stays zero.  Exact only for the one-commit case.
    """
    c = commits.join(rows.select("id", "created_at"), "id")
    early = F.coalesce(F.col("authored_date") <= F.col("created_at"), F.lit(False))
    part = lambda col: F.sum(F.when(early, F.coalesce(F.col(col), F.lit(0))))
    n = F.count_if(early)
    return c.groupBy("id").agg(
        part("additions").alias("additions_at_open"),
        part("deletions").alias("deletions_at_open"),
        F.when(n > 0, n).alias("n_commits_at_open"),
        ((F.count(F.lit(1)) == 1) & (n == 1)).alias("diff_is_exact"),
    )


def with_project_columns(rows: DataFrame, project_meta: DataFrame) -> DataFrame:
    """Rows with project-level snapshots and the project's age at opening; metadata is one row per project.

    A project without metadata keeps its rows, with nulls; ``require_meta`` is the check before.
    """
    meta = project_meta.select(
        F.col("project").alias("_project"), F.col("created_at").alias("project_created_at"), "n_assignable_users", "n_mentionable_users",
        "owner_type", "has_codeowners", "has_pr_template", "has_contributing", "n_ci_workflows", "language_dominant")
    return rows.join(meta, F.col("project") == F.col("_project"), "left").select(
        *rows.columns,
        F.col("n_assignable_users").cast("long").alias("n_assignable_users"),
        F.col("n_mentionable_users").cast("long").alias("n_mentionable_users"),
        (F.col("owner_type") == "Organization").alias("owner_is_org"),
        "has_codeowners", "has_pr_template", "has_contributing",
        F.col("n_ci_workflows").cast("long").alias("n_ci_workflows"),
        "language_dominant",
        days_between("project_created_at", "created_at").alias("project_age_days_at_open"),
    )


def project_features(rows: DataFrame, project_meta: DataFrame) -> DataFrame:
    return with_project_columns(rows.select("id", "project", "created_at"), project_meta).drop("project", "created_at")
