"""Choosing and checking the projects of a study.  The outcome is reported, never a reason to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.conf import LANGUAGE_FAMILY, Settings
from waitline.functions.columns import instant, seeded, truthy
from waitline.functions.ordered import running_totals, with_scalars

# Structural limits of the quality check.
MAX_BOT_SHARE = 0.50
MIN_HUMAN_ROWS = 100
LOOK_ROW_SHARE = 0.08
LOOK_SPREAD = 0.15


def dominant_language(candidates: DataFrame) -> DataFrame:
    """Add ``language_dominant``: the language with most bytes (first on ties), else the primary one."""
    best = F.expr(
        "aggregate(languages, cast(null as struct<name: string, size: bigint>),"
        " (a, x) -> if(a is null or coalesce(x.size, 0) > a.size, named_struct('name', x.name, 'size', coalesce(x.size, 0)), a)).name"
    )
    return candidates.withColumn("language_dominant", F.when(F.size("languages") > 0, best).otherwise(F.col("primary_language")))


def structural_filter(candidates: DataFrame, language: str, low: int, high: int, pushed_since) -> DataFrame:
    """Original, public, live projects of one language and size range, recently active."""
    off = lambda c: ~truthy(c)
    return candidates.where(
        (F.col("primary_language") == language) & F.col("stars").between(low, high)
        & (F.col("pushed_at") > pushed_since)
        & off("is_fork") & off("is_archived") & off("is_mirror") & off("is_private"))


def stratified_draw(candidates: DataFrame, per_cell: int, floor: int, seed: int) -> DataFrame:
    """Walk each cell's pool in a seeded order, take the first ``per_cell`` that clear the volume floor.

    Rows walked before the cell is full come back with ``chosen`` and, if passed over, ``reason``.
    """
    reason = F.when(F.col("n_all") < floor, "all-time volume").when(F.col("n_window") < floor, "in-window volume")
    walk = candidates.withColumn("reason", reason).withColumn("_h", seeded(seed, "cell", "id")).withColumn(
        "_ok", F.col("reason").isNull().cast("int"))
    # Two-level running count: a cell may hold any share of the pool.
    counted = running_totals(walk, ["cell"], "_h", ["_ok"], F.substring("_h", 1, 2))
    return counted.where(F.col("cum__ok") - F.col("_ok") < per_cell).withColumn(
        "chosen", F.col("reason").isNull()).drop("_h", "_ok", "cum__ok")


def check_projects(
    cohort: DataFrame, subjects: DataFrame, project_meta: DataFrame, labelled: DataFrame, settings: Settings,
    families: dict = LANGUAGE_FAMILY,
) -> DataFrame:
    """One row per cohort project: sizes, bot share, label rates under D3 and D5, drop reasons, kept.

    A project without collected rows is dropped for that reason alone.  Sizes count the window;
    ``labelled`` is ``label_all`` of the human rows.
    """
    inside = (F.col("created_at") >= instant(settings.window_start)) & (F.col("created_at") <= instant(settings.window_end))
    n = subjects.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_collected"), F.count_if(inside).alias("n_in_window"),
        F.count_if(inside & truthy("actor_is_bot")).alias("n_bot"))
    rate = lambda d: F.avg(F.when(F.col("definition") == d, F.col("is_slow").cast("double")))
    rates = labelled.where(F.col("definition").isin("D3", "D5")).groupBy("project").agg(
        rate("D5").alias("is_slow_d5"), rate("D3").alias("is_slow_d3"))
    languages = project_meta.select("project", "language_dominant")
    fits = F.lit(False)
    for stratum, members in families.items():
        fits = fits | ((F.col("language_stratum") == stratum) & F.coalesce(F.col("language_dominant").isin(*members), F.lit(False)))
    human = F.col("n_in_window") - F.col("n_bot")
    share = F.coalesce(F.col("n_bot") / F.nullif(F.col("n_in_window"), F.lit(0)), F.lit(0.0))
    j = cohort.join(n, "project", "left").join(rates, "project", "left").join(languages, "project", "left")
    empty = F.col("n_collected").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.when(empty, F.array(F.lit("no data collected"))).otherwise(F.array_compact(F.array(
        F.when(share > MAX_BOT_SHARE, "bot share"), F.when(human < MIN_HUMAN_ROWS, "too few human rows"),
        F.when(~fits, "language outside the stratum's family"))))
    return j.select(
        "project", "language_stratum", "size_tier",
        zero(F.col("n_in_window")).alias("n_in_window"), zero(human).alias("n_human"), share.alias("bot_share"),
        F.when(~empty, F.col("language_dominant")).alias("language_dominant"), "is_slow_d5", "is_slow_d3",
        F.abs(F.col("is_slow_d5") - F.col("is_slow_d3")).alias("spread_d3_d5"),
        reasons.alias("reasons"), (F.size(reasons) == 0).alias("kept"))


def look_list(checked: DataFrame) -> DataFrame:
    """Kept projects with their share of kept human rows, and why a person should look at them."""
    kept = checked.where("kept")
    total = kept.agg(F.greatest(F.sum("n_human"), F.lit(1)).alias("_total"))
    share = with_scalars(kept, total).withColumn("row_share", F.col("n_human") / F.col("_total"))
    why = F.array_compact(F.array(
        F.when(F.col("row_share") > LOOK_ROW_SHARE, "row share"),
        F.when(F.col("spread_d3_d5") > LOOK_SPREAD, "definition spread")))
    return share.select("project", "n_human", "row_share", "spread_d3_d5", why.alias("why"))


def keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of kept projects (one small row per project on the right)."""
    return rows.join(kept.select("project"), "project", "left_semi")
