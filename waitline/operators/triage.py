"""Who is still waiting at an instant, ranked by risk, and what happened to them.

Rows: project, id, number, url, title, created_at, closed_at, first_response_at, is_slow, p_hat.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline import registry
from waitline.conf import DAY_US, Settings
from waitline.functions.columns import as_col, days_between, format_value, instant, iso_week, micros, nearest, seeded, seeded_int
from waitline.functions.ordered import hash_numbers, quantile_buckets, row_numbers, running_totals, with_scalars
from waitline.operators.metrics import BLOCKS

# The exhaustive wait buckets; the last three are the stalled ones.
WAIT_BUCKETS = (
    "within an hour", "1 hour to 1 day", "1 to 7 days", "after more than 7 days",
    "closed without a review", "never reviewed, still open",
)

# The accepted forms of a reference.
LINK_PATTERN = r"github\.com/([^/\s]+/[^/\s]+)/pull/(\d+)"
SHORT_PATTERN = r"^([^/\s#]+/[^/\s#]+)#(\d+)$"
BARE_PATTERN = r"^#*(\d+)$"


def still_waiting(at: Column) -> Column:
    """Opened before ``at``, not yet closed and not yet answered; an end exactly at ``at`` counts."""
    return (
        (F.col("created_at") < at)
        & (F.col("closed_at").isNull() | (F.col("closed_at") > at))
        & (F.col("first_response_at").isNull() | (F.col("first_response_at") > at))
    )


def awaiting(rows: DataFrame, at: Column) -> DataFrame:
    return rows.where(still_waiting(at))


def waiting_counts(rows: DataFrame, days: Sequence[datetime], settings: Settings) -> DataFrame:
    """(project, at, n_waiting) for every project and instant, from signed steps instead of a cross join."""
    born = micros("created_at") + 1
    end = F.least(micros("closed_at"), micros("first_response_at"))
    steps = rows.select("project", F.explode(F.array(
        F.struct(born.alias("at_us"), F.lit(1).cast("long").alias("step")),
        F.struct(F.when(end.isNotNull(), F.greatest(end, born)).alias("at_us"), F.lit(-1).cast("long").alias("step")),
    )).alias("s")).select("project", "s.*").where("at_us is not null").groupBy("project", "at_us").agg(
        F.sum("step").alias("step"))
    calendar = F.array(*[micros(instant(d)) for d in days])
    asked = rows.select("project").distinct().select(
        "project", F.explode(calendar).alias("at_us"), F.lit(0).cast("long").alias("step"), F.lit(True).alias("_asked"))
    both = steps.withColumn("_asked", F.lit(False)).unionByName(asked)
    bucket = F.floor(F.col("at_us") / (settings.bucket_days * DAY_US)).cast("long")
    ran = running_totals(both, ["project"], "at_us", ["step"], bucket)
    return ran.where("_asked").select("project", F.timestamp_micros("at_us").alias("at"), F.col("cum_step").alias("n_waiting"))


def default_project(counts: DataFrame) -> DataFrame:
    """Per instant the project with most waiting subjects, first by name on ties."""
    return counts.groupBy("at").agg(
        F.min_by("project", F.struct(-F.col("n_waiting"), F.col("project"))).alias("project"),
        F.max("n_waiting").alias("n_waiting"))


def outcome() -> Column:
    """What happened: answered, closed without an answer, or neither, and whether it stalled."""
    days = lambda end: F.format_string("%.1f", nearest(days_between("created_at", end), 1))
    text = (
        F.when(F.col("first_response_at").isNotNull(), F.concat(F.lit("reviewed after "), days("first_response_at"), F.lit(" days")))
        .when(F.col("closed_at").isNotNull(), F.concat(F.lit("closed after "), days("closed_at"), F.lit(" days without a review")))
        .otherwise("never reviewed")
    )
    return F.concat(text, F.when(F.col("is_slow"), ", stalled").otherwise(""))


def ranked(rows: DataFrame, at: Column, top: int | None = None) -> DataFrame:
    """Each project's waiting subjects by risk, then age, then number.  ``top`` keeps a top-k report.

    The full list is numbered in two levels, over buckets of the score that a quantile sketch sets for each project;
    a top-k is cut in every partition first.
    """
    order = [F.desc("p_hat"), "created_at", "number"]
    if top is None:
        cut = quantile_buckets(awaiting(rows, at), ["project"], "p_hat", BLOCKS, "_cut")
        out = row_numbers(cut, ["project"], order, -F.col("_cut"), "rank")
    else:
        w = W.partitionBy("project").orderBy(*order)
        out = awaiting(rows, at).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return out.select(
        "project", "id", F.col("rank").cast("long").alias("rank"), F.col("p_hat").alias("risk"), "url", "title",
        days_between("created_at", at).alias("days_waited"), outcome().alias("outcome"), F.col("is_slow").alias("stalled"))


def tally(rows: DataFrame, at: Column, k: int = 3) -> DataFrame:
    """Per project: how many of the top k stalled, with k cut to the list's length."""
    return ranked(rows, at, k).groupBy("project").agg(F.count_if("stalled").alias("stalled"), F.count(F.lit(1)).alias("k"))


def parse_reference(text, default_project) -> Column:
    """(project, number) from a link, ``owner/name#N`` or a bare number; null when it is none of them or the number does not fit."""
    t = F.trim(as_col(text))
    part = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    project = F.coalesce(part(LINK_PATTERN, 1), part(SHORT_PATTERN, 1))
    number = F.coalesce(part(LINK_PATTERN, 2), part(SHORT_PATTERN, 2))
    bare = part(BARE_PATTERN, 1)
    named = F.struct(project.alias("project"), number.try_cast("long").alias("number"))
    plain = F.struct(as_col(default_project).alias("project"), bare.try_cast("long").alias("number"))
    return F.when(number.try_cast("long").isNotNull(), named).when(bare.try_cast("long").isNotNull(), plain)


def find(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Rows named by (project, number), letter case of the project ignored."""
    asked = references.select(F.lower("project").alias("_p"), F.col("number").alias("_n")).distinct()
    return rows.join(asked, (F.lower("project") == F.col("_p")) & (F.col("number") == F.col("_n"))).drop("_p", "_n")


def rank_in_project(rows: DataFrame) -> DataFrame:
    """(id, share_lower, n_others): share of the project's other rows with a strictly lower score."""
    counts = rows.groupBy("project", "p_hat").agg(F.count(F.lit(1)).alias("n"))
    cut = quantile_buckets(counts, ["project"], "p_hat", BLOCKS, "_cut")
    below = running_totals(cut, ["project"], "p_hat", ["n"], F.col("_cut"))
    total = counts.groupBy("project").agg(F.sum("n").alias("_all"))
    table = below.join(total, "project").select(
        "project", "p_hat", (F.col("cum_n") - F.col("n")).alias("lower"), (F.col("_all") - 1).alias("n_others"))
    share = F.coalesce(F.col("lower") / F.nullif("n_others", F.lit(0)), F.lit(0.0))
    return rows.join(table, ["project", "p_hat"]).select("id", share.alias("share_lower"), "n_others")


def random_pick(rows: DataFrame, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """One row id per keys, drawn by hash."""
    return rows.groupBy(*keys).agg(F.min_by("id", F.struct(seeded(seed, "id"), F.col("id"))).alias("id"))


def wait_bucket() -> Column:
    hours = (micros("first_response_at") - micros("created_at")) / 3.6e9
    b = WAIT_BUCKETS
    return (
        F.when(hours < 1, b[0]).when(hours < 24, b[1]).when(hours <= 168, b[2]).when(hours > 168, b[3])
        .when(F.col("closed_at").isNotNull(), b[4]).otherwise(b[5])
    )


def wait_buckets(rows: DataFrame) -> DataFrame:
    """Count and share per wait bucket, empty buckets included."""
    names = rows.sparkSession.createDataFrame([(b, i >= 3) for i, b in enumerate(WAIT_BUCKETS)], "bucket string, stalled boolean")
    n = rows.groupBy(wait_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    out = names.join(n, "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = n.agg(F.greatest(F.coalesce(F.sum("count"), F.lit(0)), F.lit(1)).alias("_total"))
    return with_scalars(out, total).select("bucket", "count", (F.col("count") / F.col("_total")).alias("share"), "stalled")


def wait_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shares answered within a day, stalled, closed within a day (of those closed unanswered), left in limbo."""
    waited = micros("first_response_at") - micros("created_at")
    lasted = micros("closed_at") - micros("created_at")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    unanswered = F.col("first_response_at").isNull() & F.col("closed_at").isNotNull()
    late = F.col("first_response_at").isNull() | (waited > 7 * DAY_US)
    lingering = F.col("closed_at").isNull() | (lasted > 7 * DAY_US)
    return rows.groupBy(*keys).agg(
        share(waited < DAY_US).alias("quick"), share(F.col("is_slow")).alias("stalled"),
        F.coalesce(F.avg(F.when(unanswered, (lasted < DAY_US).cast("double"))), F.lit(0.0)).alias("closed_fast"),
        share(late & lingering).alias("limbo"))


def timeline(rows: DataFrame, at: Column) -> DataFrame:
    return rows.select(
        "project", "id", "number", "title", "created_at", F.col("p_hat").alias("risk"), F.col("is_slow").alias("stalled"),
        F.coalesce(still_waiting(at), F.lit(False)).alias("waiting"), outcome().alias("outcome"))


# --- why ---------------------------------------------------------------------------------------


def pushes(contributions, labels, values) -> Column:
    """Features of one row ordered by size of their push (ties by feature position)."""
    c = as_col(contributions)
    cells = F.zip_with(c, F.sequence(F.lit(0), F.size(c) - 1), lambda v, i: F.struct(
        (-F.abs(v)).alias("size"), i.alias("position"), v.alias("push")))
    cells = F.zip_with(cells, as_col(labels), lambda s, x: F.struct(s["size"], s["position"], s["push"], x.alias("label")))
    cells = F.zip_with(cells, as_col(values), lambda s, x: F.struct(
        s["size"], s["position"], s["push"], s["label"], x.alias("value")))
    return F.array_sort(cells)


def format_drivers(contributions, labels, values, k: int = 3) -> Column:
    """Text of the k strongest pushes; the arrow shows the direction, up towards slow."""
    top = F.slice(pushes(contributions, labels, values), 1, k)
    return F.array_join(F.transform(top, lambda s: F.concat(
        s["label"], F.lit(" = "), s["value"], F.lit(" "), F.when(s["push"] > 0, "↑").otherwise("↓"))), " · ")


def why(rows: DataFrame, k: int = 8) -> DataFrame:
    """Per id: the k strongest pushes in order, then one row for all the others, with the base value.

    ``rows``: id, contributions, labels, values, base.
    """
    sorted_ = rows.withColumn("_p", pushes("contributions", "labels", "values"))
    rest = F.aggregate(F.slice("_p", k + 1, F.greatest(F.size("_p") - k, F.lit(0))), F.lit(0.0), lambda a, s: a + s["push"])
    other = F.struct(
        F.concat(F.lit("all other "), F.greatest(F.size("_p") - k, F.lit(0)).cast("string"), F.lit(" features")).alias("label"),
        F.lit("").alias("value"), rest.alias("push"))
    top = F.transform(F.slice("_p", 1, k), lambda s: F.struct(s["label"].alias("label"), s["value"].alias("value"), s["push"].alias("push")))
    return sorted_.select("id", "base", F.posexplode(F.concat(top, F.array(other))).alias("place", "w")).select(
        "id", "base", "place", "w.label", "w.value", "w.push")


def logit_gap(rows: DataFrame) -> DataFrame:
    """Largest difference between base + pushes and the log-odds of the score."""
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return rows.agg(F.max(F.abs(total - F.ln(F.col("score") / (1 - F.col("score"))))).alias("gap"))


def labelled_importance(importance: DataFrame, labels: DataFrame) -> DataFrame:
    """Importance shares with reader-facing names (one small row per feature)."""
    return importance.join(labels, "feature", "left").select("feature", "label", "share")


# --- the matched draw ---------------------------------------------------------------------------


def with_week(rows: DataFrame) -> DataFrame:
    return rows.withColumn("week", iso_week("created_at"))


def eligible_weeks(rows: DataFrame, size: int = 4) -> DataFrame:
    """(project, week) groups with at least one stalled and ``size - 1`` other subjects."""
    n = with_week(rows).groupBy("project", "week").agg(
        F.count_if("is_slow").alias("n_slow"), F.count_if(~F.col("is_slow")).alias("n_fine"))
    return n.where((F.col("n_slow") >= 1) & (F.col("n_fine") >= size - 1))


def deal(rows: DataFrame, draws: int, seed: int, size: int = 4) -> DataFrame:
    """Matched rounds: per draw one eligible (project, week), one stalled and ``size - 1`` other subjects.

    All draws are answered in one job; the shown order within a round is hashed too.
    """
    weeks = eligible_weeks(rows, size).select("project", "week", F.concat_ws("|", "project", "week").alias("key"))
    numbered = hash_numbers(weeks, "key", total="_weeks").drop("key")
    n = numbered.agg(F.max("_weeks").alias("n")).scalar()
    picks = rows.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn(
        "slot", seeded_int(seed, F.lit("week"), "draw") % n)
    rounds = picks.join(numbered.drop("_weeks"), "slot").select("draw", "project", "week")
    members = with_week(rows).join(rounds, ["project", "week"])
    w = W.partitionBy("draw", "is_slow").orderBy(seeded(seed, "draw", "id"), "id")
    # Two literal limits, so each partition keeps only the few rows that can win before the shuffle.
    best = members.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size - 1)
    dealt = best.where(~F.col("is_slow") | (F.col("_rn") == 1))
    place = W.partitionBy("draw").orderBy(seeded(seed, F.lit("place"), "draw", "id"), "id")
    return dealt.withColumn("place", F.row_number().over(place)).drop("_rn")


def model_pick(rounds: DataFrame) -> DataFrame:
    """Per draw the id with the highest score, the lower number on ties, and whether it stalled."""
    best = F.struct(F.col("p_hat"), -F.col("number"))
    return rounds.groupBy("draw").agg(F.max_by("id", best).alias("id"), F.max_by("is_slow", best).alias("hit"))


def game_hit_rate(rows: DataFrame, size: int = 4) -> DataFrame:
    """Exact chance that the model picks the stalled subject of a matched round.

    A stalled subject wins when all its companions rank below it: C(L, size-1) / C(N, size-1), with
    L the group's other subjects of lower score, or equal score and higher number.  Averaged over
    stalled subjects within a group, then over groups.
    """
    groups = eligible_weeks(rows, size).select("project", "week", "n_fine")
    members = with_week(rows).join(groups, ["project", "week"]).select(
        "project", "week", "n_fine", "is_slow", "p_hat",
        F.struct(F.col("p_hat"), (-F.col("number")).alias("minus")).alias("place"),
        (~F.col("is_slow")).cast("int").alias("fine"))
    members = quantile_buckets(members, ["project", "week"], "p_hat", BLOCKS, "_cut")
    below = running_totals(members, ["project", "week"], "place", ["fine"], F.col("_cut"))
    ways = lambda c: [F.greatest(F.col(c) - i, F.lit(0)).cast("double") for i in range(size - 1)]
    chance = F.lit(1.0)
    for top, bottom in zip(ways("cum_fine"), ways("n_fine")):
        chance = chance * top / bottom
    per = below.where("is_slow").groupBy("project", "week").agg(F.avg(chance).alias("rate"))
    return per.agg(F.avg("rate").alias("hit_rate"), F.count(F.lit(1)).alias("n_groups"))


# --- serving extract ------------------------------------------------------------------------------


def serving_extract(
    a: DataFrame, b: DataFrame, subjects: DataFrame, labels: DataFrame, contributions: DataFrame
) -> DataFrame:
    """Scenario A's test rows with both scores, the fold that held the project out, texts and attributions.

    ``row_no`` fixes the order wherever a reader needs one.
    """
    text = subjects.select("id", "number", "url", F.col("title_current").alias("title"), "closed_at")
    first = labels.select("id", F.col("first_event_at").alias("first_response_at"))
    held = b.select("id", F.col("fold").alias("fold_b"), F.col("p_hat").alias("score_b"))
    w = ["created_at", "id"]
    return (
        a.select("project", "id", "created_at", "is_slow", F.col("p_hat").alias("score_a"), "baseline_score")
        .join(text, "id").join(first, "id").join(held, "id").join(contributions, "id").select(
            "*", F.struct(*w).alias("row_order"))
    )


def driver_text(contributions: str, features: Sequence[str], names: dict[str, str] | None = None, k: int = 3) -> Column:
    """The k features that push most, largest first (ties in feature order), with their values and direction.

    Reads the features' own columns; ``names`` gives readable names, else underscores become spaces.
    """
    kind = {"boolean": "bool", "string": "str"}
    name = lambda f: (names or {}).get(f, f.replace("_", " "))
    texts = F.array(*[
        F.concat(F.lit(f"{name(f)} = "), format_value(f, kind.get(registry.COLUMNS[f].type, "number"), f in registry.RATES)) for f in features])
    cells = F.transform(contributions, lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("at"), (v > 0).alias("up")))
    best = F.slice(F.array_sort(cells), 1, k)
    return F.array_join(F.transform(best, lambda s: F.concat(
        F.element_at(texts, s["at"] + 1), F.when(s["up"], " ↑").otherwise(" ↓"))), " · ")


def serving_table(explained: DataFrame, subjects: DataFrame, labels: DataFrame, table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scenario A's test rows with both models' scores, drivers, bases and pushes, and every feature's value.

    ``explained``: predictions of both scenarios with base and contributions, in the order of ``features``.  A row that
    the other tables lack keeps nulls there, which ``extract_problems`` counts.
    """
    side = lambda s: explained.where(F.col("scenario") == s)
    a = side("A").select(
        "project", "id", "created_at", "is_slow", "baseline_score", F.col("p_hat").alias("score_a"), F.col("base").alias("base_a"),
        F.col("contributions").alias("_a"))
    b = side("B").select(
        "id", F.col("fold").alias("fold_b"), F.col("p_hat").alias("score_b"), F.col("base").alias("base_b"), F.col("contributions").alias("_b"))
    text = subjects.select("id", "number", "url", F.col("title_current").alias("title"), "closed_at")
    first = labels.select("id", F.col("first_event_at").alias("first_response_at"))
    joined = a.join(b, "id", "left").join(text, "id", "left").join(first, "id", "left").join(table.select("id", *features), "id", "left")
    push = lambda side: [F.element_at(f"_{side}", i + 1).cast("float").alias(f"push_{side}__{f}") for i, f in enumerate(features)]
    return joined.select(
        "project", "id", "number", "url", "title", "created_at", "closed_at", "first_response_at", "is_slow", "score_a", "fold_b", "score_b",
        "baseline_score", driver_text("_a", features).alias("drivers_a"), driver_text("_b", features).alias("drivers_b"), "base_a", "base_b",
        *push("a"), *push("b"), *[F.col(f).alias(f"x__{f}") for f in features])


def logit_problems(explained: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(check, n): rows whose base and pushes do not give the logit of their stored score, by scenario."""
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)
    off = F.abs(total - F.log(F.col("p_hat") / (1 - F.col("p_hat"))))
    return explained.groupBy("scenario").agg(F.count_if(~F.coalesce(off <= tolerance, F.lit(False))).alias("n")).select(
        F.concat(F.lit("logit "), "scenario").alias("check"), "n")


def extract_problems(extract: DataFrame, fold_of: DataFrame, required: Sequence[str]) -> DataFrame:
    """(check, n) for missing values, rows outside their project's fold and repeated ids."""
    missing = extract.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    cells = ", ".join(f"'missing {c}', {c}" for c in required)
    rows = missing.selectExpr(f"stack({len(required)}, {cells}) as (check, n)")
    wrong = extract.join(fold_of.select("project", F.col("fold").alias("_f")), "project", "left").agg(
        F.count_if(~F.col("fold_b").eqNullSafe(F.col("_f"))).alias("n")).select(F.lit("wrong fold").alias("check"), "n")
    twice = extract.groupBy("id").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(
        F.lit("repeated id").alias("check"), "n")
    return rows.unionByName(wrong).unionByName(twice)
