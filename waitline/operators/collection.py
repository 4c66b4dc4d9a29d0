"""Gate over collected data: coverage, truncation, degeneracy, contamination, warm-up, cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from waitline.conf import Settings
from waitline.functions.columns import instant
from waitline.functions.ordered import join_null_safe


def in_window(subjects: DataFrame, settings: Settings) -> DataFrame:
    """Subjects opened inside the window, which the gate's rates are about."""
    return subjects.where(F.col("created_at").between(instant(settings.window_start), instant(settings.window_end)))


def coverage(subjects: DataFrame, settings: Settings, keys: Sequence[str] = ()) -> DataFrame:
    """Date range, rows inside the window and the share outside, of all rows or per ``keys``."""
    inside = F.col("created_at").between(instant(settings.window_start), instant(settings.window_end))
    return subjects.groupBy(*keys).agg(
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n"),
        F.count_if(inside).alias("n_in_window"), F.avg((~inside).cast("double")).alias("outside_share"))


def truncation_rate(subjects: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return subjects.groupBy(*keys).agg(F.avg(F.col("is_truncated").cast("double")).alias("truncation_rate"))


def degeneracy(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Never and slow rate and whether both lie in the usable ranges."""
    r = labels.groupBy(*keys).agg(F.avg(F.col("never_answered").cast("double")).alias("never"), F.avg(F.col("is_slow").cast("double")).alias("slow"))
    return r.withColumn("pass", F.col("never").between(0.10, 0.35) & F.col("slow").between(0.05, 0.60))


def by_level(df: DataFrame, keys: Sequence[str], *more: str) -> GroupedData:
    """Groups of every key and of all rows at once, in one scan; without keys only the latter.  ``more`` splits both."""
    if not keys:
        return df.groupBy(*more)
    return df.groupingSets([[F.col(c) for c in (*keys, *more)], [F.col(c) for c in more]], *keys, *more)


def level(keys: Sequence[str]) -> list[Column]:
    """Tells the rows of ``by_level`` apart, as a key may be null itself: each key's, or all."""
    return [F.when(F.grouping(keys[0]) == 1, "all").otherwise("each").alias("level")] if keys else []


def contamination(subjects: DataFrame, timeline: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of subjects with a post-open event of each type: how wrong the current state would be.

    With ``keys`` the rates of each key and, as ``level`` says, of all together.
    """
    opened = subjects.select("id", *keys, F.col("created_at").alias("opened_at"))
    events = timeline.select("id", "event_type", F.col("created_at").alias("event_at"))
    hit = events.join(opened, "id").where(F.col("event_at") > F.col("opened_at"))
    # One row per (type, id) before counting, so a flood of events on one id is combined early.
    per = by_level(hit.groupBy(*keys, "event_type", "id").agg(F.lit(1).alias("one")), keys, "event_type").agg(
        *level(keys), F.count(F.lit(1)).alias("n"))
    total = by_level(subjects, keys).agg(*level(keys), F.count(F.lit(1)).alias("_all"))
    if not keys:
        return per.select("event_type", "n", (F.col("n") / total.scalar()).alias("share"))
    both = join_null_safe(per, total, [*keys, "level"])
    return both.select("level", *keys, "event_type", "n", (F.col("n") / F.col("_all")).alias("share"))


def diff_rates(diffs: DataFrame, commit_counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of subjects with several commits and with an exactly known at-open size; ``keys`` are in ``commit_counts``."""
    j = commit_counts.join(diffs.select("id", "diff_is_exact"), "id", "left")
    return by_level(j, keys).agg(
        *level(keys), F.avg((F.col("n_commits") > 1).cast("double")).alias("multi_commit_rate"),
        F.avg(F.coalesce("diff_is_exact", F.lit(False)).cast("double")).alias("diff_exact_rate"))


def warm_up(history: DataFrame, settings: Settings, early_days: int = 90, keys: Sequence[str] = ()) -> DataFrame:
    """Rows open when the window starts, and early rows whose actor already had history in the same project."""
    start = instant(settings.window_start)
    end = F.expr(f"timestampadd(DAY, {early_days}, _start)")
    h = history.withColumn("_start", start)
    before = F.col("created_at") < F.col("_start")
    open_ = before & (F.col("closed_at").isNull() | (F.col("closed_at") > F.col("_start")))
    early = (F.col("created_at") >= F.col("_start")) & (F.col("created_at") < end)
    veterans = h.where(before & F.col("actor_login").isNotNull()).select("project", "actor_login").distinct().withColumn("veteran", F.lit(1.0))
    # Only what is counted goes on; rows without an actor have no veteran to meet and stay out of the join.
    flags = h.select("project", *[k for k in keys if k != "project"], "actor_login", open_.alias("_open"), early.alias("_early")).where("_open or _early")
    told = flags.where("_early and actor_login is not null").join(veterans, ["project", "actor_login"], "left")
    rest = flags.where("not _early or actor_login is null").withColumn("veteran", F.lit(None).cast("double"))
    return by_level(told.unionByName(rest), keys).agg(
        *level(keys), F.count_if("_open").alias("open_at_window_start"),
        F.avg(F.when(F.col("_early"), F.coalesce("veteran", F.lit(0.0)))).alias("early_actors_with_history"))


def mutability(history: DataFrame, status: str = "CONTRIBUTOR", keys: Sequence[str] = ()) -> DataFrame:
    """Share of a project's actors whose first known status there is one that only later rows could have earned.

    The first non-null status in (created_at, id) order; an ordered minimum, so no window is needed.
    """
    known = F.when(F.col("association_current").isNotNull(), F.struct("created_at", "id"))
    first = history.where("actor_login is not null").groupBy("project", "actor_login").agg(
        F.min_by("association_current", known).alias("first_status"))
    return by_level(first, keys).agg(
        *level(keys), F.count(F.lit(1)).alias("n_actors"), F.count_if(F.col("first_status") == status).alias("n_status"),
        F.avg(F.coalesce(F.col("first_status") == status, F.lit(False)).cast("double")).alias("rate"))


def cost(manifest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points and bytes per collected row over the rich pages."""
    t = by_level(manifest.where((F.col("tier") == 2) & (F.col("pr_count") > 0)), keys).agg(
        *level(keys), F.sum(F.coalesce("rate_limit_cost", F.lit(0))).alias("points"), F.sum("pr_count").alias("rows"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))
    return t.select(
        *(["level", *keys] if keys else []), "points", "rows", (F.col("points") / F.nullif("rows", F.lit(0)) * 1000).alias("points_per_1k"),
        (F.col("bytes") / F.nullif("rows", F.lit(0))).alias("bytes_per_row"))


def study_gate(checked: DataFrame, labels: DataFrame, test_a: DataFrame, folds: DataFrame, audits: DataFrame) -> DataFrame:
    """The study's go / no-go gate."""
    from waitline.operators.gates import checks

    per = test_a.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    facts = checked.agg(F.count_if("kept").alias("kept")
    ).withColumn("rate", labels.agg(F.avg(F.col("is_slow").cast("double")).alias("r")).scalar()
    ).withColumn("covered", per.agg(F.count_if(F.col("n") >= 10).alias("c")).scalar()
    ).withColumn("smallest", folds.groupBy("fold").agg(F.count(F.lit(1)).alias("g")).agg(F.min("g").alias("m")).scalar()
    ).withColumn("audited", audits.agg(F.min(F.col("pass").cast("int")).alias("a")).scalar())
    return checks(facts, "study", [
        (1, "projects kept >= 30", F.col("kept"), F.col("kept") >= 30),
        (2, "slow rate in [10 %, 70 %]", F.round("rate", 4), F.col("rate").between(0.10, 0.70)),
        (3, ">= 20 test projects with >= 10 rows", F.col("covered"), F.col("covered") >= 20),
        (4, "every fold holds out >= 6 projects", F.col("smallest"), F.col("smallest") >= 6),
        (5, "replay audit passes", F.col("audited"), F.col("audited") == 1),
    ])


def split_coverage(test_a: DataFrame, folds: DataFrame) -> DataFrame:
    per = test_a.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    groups = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("g"))
    return per.agg(F.count_if(F.col("n") >= 10).alias("test_projects_with_10")).withColumn(
        "min_projects_per_fold", groups.agg(F.min("g").alias("m")).scalar())
