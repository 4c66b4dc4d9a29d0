"""The feature table's contract: 50 columns, their role, type and whether nulls are legal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Statuses a model may train on, and the baseline's own signal.
TRAINABLE = ("static", "reconstructed", "replay", "snapshot")
LABEL_REPLAY = ("trailing_90d_slow_rate", "trailing_n", "actor_prior_slow_rate_here", "actor_prior_n")

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "integer": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    group: str
    status: str
    type: str
    nullable: bool


# Column, group, status, type, nullable.
SPECS = (
    ColumnSpec("project", "key", "key", "string", False),
    ColumnSpec("id", "key", "key", "string", False),
    ColumnSpec("number", "key", "key", "long", False),
    ColumnSpec("created_at", "key", "key", "timestamp", False),
    ColumnSpec("is_slow", "label", "label", "boolean", False),
    ColumnSpec("wait_h", "label", "label", "double", True),
    ColumnSpec("wait_h_censored", "label", "label", "double", False),
    ColumnSpec("event_observed", "label", "label", "boolean", False),
    ColumnSpec("never_answered", "label", "label", "boolean", False),
    ColumnSpec("created_hour_utc", "static", "static", "integer", False),
    ColumnSpec("created_dayofweek", "static", "static", "integer", False),
    ColumnSpec("is_weekend", "static", "static", "boolean", False),
    ColumnSpec("is_cross_project", "static", "static", "boolean", False),
    ColumnSpec("actor_account_age_days", "static", "static", "double", True),
    ColumnSpec("body_len", "static", "static", "integer", False),
    ColumnSpec("has_body", "static", "static", "boolean", False),
    ColumnSpec("body_edited", "flag", "flag", "boolean", False),
    ColumnSpec("is_draft_at_open", "at_open", "reconstructed", "boolean", False),
    ColumnSpec("n_labels_at_open", "at_open", "reconstructed", "long", False),
    ColumnSpec("title_len_at_open", "at_open", "reconstructed", "integer", False),
    ColumnSpec("base_is_default", "at_open", "reconstructed", "boolean", False),
    ColumnSpec("reviewer_requested_at_open", "at_open", "static", "boolean", False),
    ColumnSpec("n_reviewers_requested_at_open", "at_open", "static", "long", False),
    ColumnSpec("requested_team_at_open", "at_open", "static", "boolean", False),
    ColumnSpec("additions_at_open", "at_open", "reconstructed", "double", True),
    ColumnSpec("deletions_at_open", "at_open", "reconstructed", "double", True),
    ColumnSpec("n_commits_at_open", "at_open", "reconstructed", "double", True),
    ColumnSpec("diff_is_exact", "flag", "flag", "boolean", False),
    ColumnSpec("timeline_may_be_truncated", "flag", "flag", "boolean", False),
    ColumnSpec("open_backlog_at_t", "replay", "replay", "long", False),
    ColumnSpec("opened_trailing_7d", "replay", "replay", "long", False),
    ColumnSpec("trailing_90d_slow_rate", "replay", "replay", "double", False),
    ColumnSpec("trailing_n", "replay", "replay", "long", False),
    ColumnSpec("trailing_window_complete", "flag", "flag", "boolean", False),
    ColumnSpec("is_first_here", "replay", "replay", "boolean", False),
    ColumnSpec("n_prior_here", "replay", "replay", "long", False),
    ColumnSpec("n_prior_merged_here", "replay", "replay", "long", False),
    ColumnSpec("prior_merge_rate_here", "replay", "replay", "double", False),
    ColumnSpec("days_since_first_here", "replay", "replay", "double", True),
    ColumnSpec("actor_prior_slow_rate_here", "replay", "replay", "double", False),
    ColumnSpec("actor_prior_n", "replay", "replay", "long", False),
    ColumnSpec("n_assignable_users", "project", "snapshot", "long", False),
    ColumnSpec("n_mentionable_users", "project", "snapshot", "long", False),
    ColumnSpec("owner_is_org", "project", "snapshot", "boolean", False),
    ColumnSpec("has_codeowners", "project", "snapshot", "boolean", False),
    ColumnSpec("has_pr_template", "project", "snapshot", "boolean", False),
    ColumnSpec("has_contributing", "project", "snapshot", "boolean", False),
    ColumnSpec("n_ci_workflows", "project", "snapshot", "long", False),
    ColumnSpec("language_dominant", "project", "snapshot", "string", False),
    ColumnSpec("project_age_days_at_open", "project", "static", "double", False),
)

# Features shown as rates, with two decimals.
RATES = ("trailing_90d_slow_rate", "prior_merge_rate_here", "actor_prior_slow_rate_here")

COLUMNS = {c.name: c for c in SPECS}


def feature_columns() -> list[str]:
    return [c.name for c in COLUMNS.values() if c.status in TRAINABLE]


PROJECT_FEATURES = tuple(c.name for c in COLUMNS.values() if c.group == "project" and c.status == "snapshot")

FEATURE_SETS = {
    "FULL": feature_columns(),
    "NO_SNAPSHOT": [c for c in feature_columns() if COLUMNS[c].status != "snapshot"],
    "NO_LABEL_REPLAY": [c for c in feature_columns() if c not in LABEL_REPLAY],
    "SUBJECT_ONLY": [c for c in feature_columns() if COLUMNS[c].group in ("static", "at_open")],
}


def no_project_columns() -> list[str]:
    """The intervention's set: no label replay and no project-level snapshots."""
    return [c for c in FEATURE_SETS["NO_LABEL_REPLAY"] if c not in PROJECT_FEATURES]


def check_hygiene(columns) -> None:
    """Refuse keys, labels, flags and unknown names."""
    bad = [c for c in columns if c not in COLUMNS or COLUMNS[c].status not in TRAINABLE]
    if bad:
        raise ValueError(f"not usable as features: {bad}")


def table_schema() -> T.StructType:
    return T.StructType([
        T.StructField(c.name, _TYPES[c.type], c.nullable, {"group": c.group, "status": c.status})
        for c in COLUMNS.values()
    ])
