"""What was knowable at an instant, rebuilt from history without looking ahead.

At instant t only history rows with ``created_at < t`` exist.  Every counter is a sum of step
functions of t, so each history row becomes a few signed steps and one running total answers all
probes together: no range self-join, no per-probe scan.  Steps sit on integer microseconds; a
strict ``<`` enters one microsecond later.

    backlog        enters created+1                        leaves max(closed, created+1)
    opened 7 d     enters created+1                        leaves created+7d+1
    trailing n     enters max(created+1, resolvable at)    leaves max(created+90d+1, its entry)
    actor history  enters created+1 / merged+1 / resolvable at, never leaves

A label is resolvable once its threshold has passed or its first response has been seen.

Columns used: history(project, id, actor_login, created_at, closed_at, merged_at),
labels(id, first_event_at, is_slow), probes(probe_id, project, at, actor_login).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline.conf import DAY_US, HOUR_US, Settings
from waitline.functions.columns import instant_us, micros, seeded
from waitline.functions.ordered import running_totals
from waitline.session import written

PROJECT_STEPS = ("backlog", "recent", "trail_n", "trail_slow")
ACTOR_STEPS = ("prior", "prior_merged", "actor_n", "actor_slow")
#: Rows and probes of one actor in one project that one window takes, a few times as many steps.
CROWD = 100_000

REPLAY_COLUMNS = (
    "open_backlog_at_t", "trailing_90d_slow_rate", "trailing_n", "trailing_window_complete",
    "opened_trailing_7d", "is_first_here", "n_prior_here", "n_prior_merged_here",
    "prior_merge_rate_here", "days_since_first_here", "actor_prior_slow_rate_here", "actor_prior_n",
)


def labelled_history(history: DataFrame, labels: DataFrame) -> DataFrame:
    """History with microsecond columns and, where known, the label."""
    marks = labels.select("id", micros("first_event_at").alias("fe_us"), F.col("is_slow").cast("int").alias("slow"))
    return history.select(
        "project", "id", "actor_login",
        micros("created_at").alias("c_us"), micros("closed_at").alias("x_us"), micros("merged_at").alias("m_us"),
    ).join(marks, "id", "left")


def resolvable_us(settings: Settings) -> Column:
    """First microsecond at which a labelled row's label may be used."""
    by_age = F.col("c_us") + F.lit(int(settings.threshold_h * HOUR_US))
    # least() skips nulls, which is what an absent first response needs here.
    return F.greatest(F.col("c_us") + 1, F.least(by_age, F.col("fe_us") + 1))


def _step(at: Column, names, **amounts) -> Column:
    cells = [at.alias("at_us")]
    cells += [amounts.get(n, F.lit(0)).cast("long").alias(n) for n in names]
    return F.struct(*cells)


def _steps(rows: DataFrame, keys, names, steps, combine: bool = True) -> DataFrame:
    """Explode the steps and, if wanted, add up those that share an instant (combined on the map side)."""
    flat = rows.select(*keys, F.explode(F.array(*steps)).alias("s")).select(*keys, "s.*")
    known = flat.where(F.col("at_us").isNotNull() & F.col("project").isNotNull())
    return known.groupBy(*keys, "at_us").agg(*[F.sum(n).alias(n) for n in names]) if combine else known


def project_steps(rows: DataFrame, settings: Settings) -> DataFrame:
    one, born = F.lit(1), F.col("c_us") + 1
    labelled = F.col("slow").isNotNull()
    enter = F.when(labelled, resolvable_us(settings))
    expires = F.col("c_us") + F.lit(settings.trailing_days * DAY_US + 1)
    # Guarded: greatest() would ignore a null close and end the row at birth.
    leave_backlog = F.when(F.col("x_us").isNotNull(), F.greatest(F.col("x_us"), born))
    leave_trail = F.when(labelled, F.greatest(expires, enter))
    return _steps(rows, ["project"], PROJECT_STEPS, [
        _step(born, PROJECT_STEPS, backlog=one, recent=one),
        _step(leave_backlog, PROJECT_STEPS, backlog=-one),
        _step(F.col("c_us") + F.lit(settings.recent_days * DAY_US + 1), PROJECT_STEPS, recent=-one),
        _step(enter, PROJECT_STEPS, trail_n=one, trail_slow=F.col("slow")),
        _step(leave_trail, PROJECT_STEPS, trail_n=-one, trail_slow=-F.col("slow")),
    ])


def actor_steps(rows: DataFrame, settings: Settings, combine: bool = True) -> DataFrame:
    one, born = F.lit(1), F.col("c_us") + 1
    merged = F.when(F.col("m_us").isNotNull(), F.greatest(F.col("m_us"), F.col("c_us")) + 1)
    enter = F.when(F.col("slow").isNotNull(), resolvable_us(settings))
    known = rows.where(F.col("actor_login").isNotNull()).withColumnRenamed("actor_login", "actor_key")
    return _steps(known, ["project", "actor_key"], ACTOR_STEPS, [
        _step(born, ACTOR_STEPS, prior=one),
        _step(merged, ACTOR_STEPS, prior_merged=one),
        _step(enter, ACTOR_STEPS, actor_n=one, actor_slow=F.col("slow")),
    ], combine)


def _at_probes(probes: DataFrame, steps: DataFrame, keys, names, bucket_days: int | None, minima=()) -> DataFrame:
    """Totals of ``steps`` at the probes' instants, added to the probe rows; without ``bucket_days`` a key is one window."""
    payload = [c for c in probes.columns if c not in (*keys, "at_us")]
    asked = probes.select(*probes.columns, *[F.lit(0).cast("long").alias(n) for n in names],
                          *[F.lit(None).cast("long").alias(m) for m in minima], F.lit(True).alias("_asked"))
    told = steps.select(*keys, "at_us", *names, *minima).withColumn("_asked", F.lit(False))
    both = told.unionByName(asked, allowMissingColumns=True)
    if bucket_days is None:
        upto = W.partitionBy(*keys).orderBy("at_us").rangeBetween(W.unboundedPreceding, W.currentRow)
        ran = both.select("*", *[f(c).over(upto).alias(f"cum_{c}") for f, cs in ((F.sum, names), (F.min, minima)) for c in cs])
    else:
        bucket = F.floor(F.col("at_us") / (bucket_days * DAY_US)).cast("long")
        ran = running_totals(both, keys, "at_us", names, bucket, minima=minima)
    return ran.where("_asked").select(*keys, "at_us", *payload, *[f"cum_{n}" for n in (*names, *minima)])


def _actor_totals(rows: DataFrame, probes: DataFrame, settings: Settings) -> DataFrame:
    """Actor totals at the probes (project, actor_key, at_us, probe_id).

    Nearly every actor of a project has few rows, which move once and share one window.  Only actors that are counted to
    have more than ``CROWD`` rows and probes are combined per instant and run in two levels.
    """
    keys = ["project", "actor_key"]
    first = F.when(F.col("prior") > 0, F.col("at_us") - 1)
    owners = rows.where(F.col("actor_login").isNotNull()).select("project", F.col("actor_login").alias("actor_key"))
    counted = owners.unionByName(probes.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    crowded = written(counted.where(F.col("n") > CROWD).select(*[F.col(k).alias(f"_{k}") for k in keys]), "crowded")
    totals = lambda r, p, days: _at_probes(
        p, actor_steps(r, settings, days is not None).withColumn("first_us", first), keys, ACTOR_STEPS, days, minima=["first_us"])
    if not crowded.count():
        return totals(rows, probes, None)
    side = lambda df, actor, how: df.join(
        F.broadcast(crowded), F.col("project").eqNullSafe(F.col("_project")) & F.col(actor).eqNullSafe(F.col("_actor_key")), how)
    few, many = [(side(rows, "actor_login", how), side(probes, "actor_key", how)) for how in ("left_anti", "left_semi")]
    return totals(*few, None).unionByName(totals(*many, settings.actor_bucket_days))


def features_at(
    history: DataFrame,
    labels: DataFrame,
    probes: DataFrame,
    settings: Settings,
    prior: Column | float,
    merge_prior: Column | float = 0.0,
) -> DataFrame:
    """Every replay column for every probe, in one pass over the history.

    Probes may lie at any instant.  A probe without an actor gets the values of a first subject, one
    without a project or an instant meets no history at all; history without a project is seen by nobody.
    Two independent passes, one by (project, time bucket) and one by (project, actor), meet on the
    probe id, which must be unique.  The narrow labelled history is written first: both passes read
    it, and whatever made the labels runs once.
    """
    rows = written(labelled_history(history, labels), "history")
    asked = probes.select("probe_id", "project", micros("at").alias("at_us"))
    # A missing actor becomes a key of its own: no history, and no pile-up on one null key.
    who = F.coalesce("actor_login", F.concat(F.lit("\u0000"), F.col("probe_id").cast("string")))
    asked_who = probes.select("probe_id", "project", micros("at").alias("at_us"), who.alias("actor_key"))
    by_project = _at_probes(
        asked, project_steps(rows, settings), ["project"], PROJECT_STEPS, settings.bucket_days)
    by_actor = _actor_totals(rows, asked_who, settings)
    both = by_project.join(by_actor.drop("project", "actor_key", "at_us"), "probe_id")

    a = F.lit(float(settings.alpha))
    g = prior if isinstance(prior, Column) else F.lit(float(prior))
    gm = merge_prior if isinstance(merge_prior, Column) else F.lit(float(merge_prior))
    shrunk = lambda hits, n, to: (F.col(hits) + a * to) / (F.col(n) + a)
    window_us = instant_us(settings.window_start)
    return both.select(
        "probe_id", "project", F.timestamp_micros("at_us").alias("at"),
        F.col("cum_backlog").alias("open_backlog_at_t"),
        shrunk("cum_trail_slow", "cum_trail_n", g).alias("trailing_90d_slow_rate"),
        F.col("cum_trail_n").alias("trailing_n"),
        (F.col("at_us") - settings.trailing_days * DAY_US >= window_us).alias("trailing_window_complete"),
        F.col("cum_recent").alias("opened_trailing_7d"),
        (F.col("cum_prior") == 0).alias("is_first_here"),
        F.col("cum_prior").alias("n_prior_here"),
        F.col("cum_prior_merged").alias("n_prior_merged_here"),
        shrunk("cum_prior_merged", "cum_prior", gm).alias("prior_merge_rate_here"),
        ((F.col("at_us") - F.col("cum_first_us")) / float(DAY_US)).alias("days_since_first_here"),
        shrunk("cum_actor_slow", "cum_actor_n", g).alias("actor_prior_slow_rate_here"),
        F.col("cum_actor_n").alias("actor_prior_n"),
    )


def project_features_at(
    history: DataFrame, labels: DataFrame, probes: DataFrame, settings: Settings, prior: Column | float
) -> DataFrame:
    """Only the project-level columns (no actor pass): what the trailing-rate baseline needs."""
    rows = labelled_history(history, labels)
    asked = probes.select("probe_id", "project", micros("at").alias("at_us"))
    ran = _at_probes(asked, project_steps(rows, settings), ["project"], PROJECT_STEPS, settings.bucket_days)
    a = F.lit(float(settings.alpha))
    g = prior if isinstance(prior, Column) else F.lit(float(prior))
    return ran.select(
        "probe_id", "project", F.timestamp_micros("at_us").alias("at"),
        F.col("cum_backlog").alias("open_backlog_at_t"),
        ((F.col("cum_trail_slow") + a * g) / (F.col("cum_trail_n") + a)).alias("trailing_90d_slow_rate"),
        F.col("cum_trail_n").alias("trailing_n"),
        F.col("cum_trail_slow").alias("trailing_slow"),
        F.col("cum_recent").alias("opened_trailing_7d"),
    )


def row_probes(rows: DataFrame) -> DataFrame:
    """Probe each row at its own opening."""
    return rows.select(F.col("id").alias("probe_id"), "project", F.col("created_at").alias("at"), "actor_login")


def replay_features(
    rows: DataFrame, history: DataFrame, labels: DataFrame, settings: Settings, prior, merge_prior
) -> DataFrame:
    """The replay columns of a set of rows, keyed by id."""
    out = features_at(history, labels, row_probes(rows), settings, prior, merge_prior)
    return out.withColumnRenamed("probe_id", "id").drop("project", "at")


def sample_probes(probes: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of at most ``n`` probes (top-n by hash, no full sort)."""
    return probes.orderBy(seeded(seed, "probe_id"), "probe_id").limit(n)


def replay_audit(
    history: DataFrame, labels: DataFrame, probes: DataFrame, settings: Settings, prior: float | Column, seed: int, n: int = 200,
) -> DataFrame:
    """One row: how far replayed rates and backlogs of at most ``n`` sampled probes are from their definitions.

    A probe that only one of the two knows, or with a null on one side, fails the audit.
    """
    some = sample_probes(probes, n, seed)
    fast = project_features_at(history, labels, some, settings, prior)
    slow = brute_force_features(history, labels, some, settings, prior)
    values = {"trailing_90d_slow_rate": "r", "open_backlog_at_t": "b"}
    side = lambda df, name: df.select("probe_id", *[F.col(c).alias(f"_{name}_{v}") for c, v in values.items()], F.lit(True).alias(f"_{name}"))
    both = side(fast, "f").join(side(slow, "s"), "probe_id", "full")
    same = F.col("_f").isNotNull() & F.col("_s").isNotNull()
    for v in values.values():
        same = same & (F.col(f"_f_{v}").isNull() == F.col(f"_s_{v}").isNull())
    gap = lambda v: F.coalesce(F.max(F.abs(F.col(f"_f_{v}") - F.col(f"_s_{v}"))), F.lit(0))
    out = both.agg(
        F.count(F.lit(1)).alias("n"), gap("r").alias("max_abs_diff_rate"), gap("b").cast("long").alias("max_abs_diff_backlog"),
        F.count_if(~same).alias("_odd"))
    passed = (F.col("max_abs_diff_rate") < 1e-9) & (F.col("max_abs_diff_backlog") == 0) & (F.col("_odd") == 0)
    return out.withColumn("pass", passed).drop("_odd")


def brute_force_features(
    history: DataFrame,
    labels: DataFrame,
    probes: DataFrame,
    settings: Settings,
    prior: float | Column,
    merge_prior: float | Column = 0.0,
) -> DataFrame:
    """The same columns from their definitions, for auditing; shares nothing with the step sums.

    ``probes`` is meant to be a limited sample (see ``sample_probes``): Spark then knows its size and
    broadcasts it, the history is read where it lies and combined per probe before the shuffle.
    """
    marks = labels.select("id", "first_event_at", "is_slow")
    h = history.select("project", "id", "actor_login", "created_at", "closed_at", "merged_at").join(marks, "id", "left")
    q = probes.select(
        F.col("probe_id"), F.col("project").alias("q_project"), F.col("at"), F.col("actor_login").alias("q_actor")
    )
    t, lo = F.col("at"), F.expr("timestampadd(DAY, -%d, at)" % settings.trailing_days)
    week = F.expr("timestampadd(DAY, -%d, at)" % settings.recent_days)
    old = F.expr("timestampadd(SECOND, -%d, at)" % int(settings.threshold_h * 3600))
    usable = F.col("is_slow").isNotNull() & (
        (F.col("created_at") <= old) | F.coalesce(F.col("first_event_at") < t, F.lit(False))
    )
    mine = F.coalesce(F.col("actor_login") == F.col("q_actor"), F.lit(False))
    seen = F.col("project").isNotNull()
    pairs = q.join(h, (F.col("project") == F.col("q_project")) & (F.col("created_at") < t), "left")
    count = lambda cond: F.count_if(seen & cond)
    slow = F.col("is_slow")
    n = pairs.groupBy("probe_id", "q_project", "at").agg(
        count(F.col("closed_at").isNull() | (F.col("closed_at") > t)).alias("open_backlog_at_t"),
        count(usable & (F.col("created_at") >= lo)).alias("trailing_n"),
        count(usable & (F.col("created_at") >= lo) & slow).alias("_trail_slow"),
        count(F.col("created_at") >= week).alias("opened_trailing_7d"),
        count(mine).alias("n_prior_here"),
        count(mine & (F.col("merged_at") < t)).alias("n_prior_merged_here"),
        F.min(F.when(mine, F.col("created_at"))).alias("_first"),
        count(mine & usable).alias("actor_prior_n"),
        count(mine & usable & slow).alias("_actor_slow"),
    )
    a = float(settings.alpha)
    g = prior if isinstance(prior, Column) else F.lit(float(prior))
    gm = merge_prior if isinstance(merge_prior, Column) else F.lit(float(merge_prior))
    return n.select(
        "probe_id", F.col("q_project").alias("project"), "at", "open_backlog_at_t",
        ((F.col("_trail_slow") + a * g) / (F.col("trailing_n") + a)).alias("trailing_90d_slow_rate"),
        "trailing_n",
        (lo >= F.timestamp_micros(F.lit(instant_us(settings.window_start)))).alias("trailing_window_complete"),
        "opened_trailing_7d",
        (F.col("n_prior_here") == 0).alias("is_first_here"),
        "n_prior_here", "n_prior_merged_here",
        ((F.col("n_prior_merged_here") + a * gm) / (F.col("n_prior_here") + a)).alias("prior_merge_rate_here"),
        ((micros("at") - micros("_first")) / float(DAY_US)).alias("days_since_first_here"),
        ((F.col("_actor_slow") + a * g) / (F.col("actor_prior_n") + a)).alias("actor_prior_slow_rate_here"),
        "actor_prior_n",
    )
