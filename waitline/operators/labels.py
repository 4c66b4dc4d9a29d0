"""How long a subject waited for its first qualifying response.

Columns used: subjects(project, id, created_at, actor_login), responses(id, stream, created_at,
submitted_at, published_at, login, type, association, is_minimized).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.conf import RULES, PRIMARY, Rule, Settings
from waitline.functions.columns import hours_between, instant, is_bot, truthy


def visible_at() -> Column:
    """When the opener could see the response: submission for reviews (null while pending)."""
    return F.when(F.col("stream") == "reviews", F.col("submitted_at")).otherwise(
        F.coalesce("published_at", "created_at")
    )


def qualifies(rule: Rule) -> Column:
    """The part of a rule that needs the response alone; a response without a stream never counts."""
    return F.coalesce(F.expr(rule.counts), F.lit(False))


def human_responses(responses: DataFrame) -> DataFrame:
    """Visible responses of identified people, with ``visible_at``."""
    return (
        responses.withColumn("visible_at", visible_at())
        .where(F.col("visible_at").isNotNull() & F.col("login").isNotNull())
        .where(~is_bot("login", "type"))
    )


def not_own() -> Column:
    """The responder is not the opener; an unknown opener cannot be matched, so everyone counts."""
    return ~F.col("login").eqNullSafe(F.col("actor_login"))


def eligible_events(subjects: DataFrame, responses: DataFrame, rule: Rule) -> DataFrame:
    """Every response that could end a wait under ``rule``."""
    found = human_responses(responses).where(qualifies(rule))
    openers = subjects.select("id", "actor_login")
    return found.join(openers, "id", "left").where(not_own()).select(
        "id", "stream", "visible_at", "login", "association", "is_minimized"
    )


def first_events(
    subjects: DataFrame, responses: DataFrame, rules: Iterable[Rule] = tuple(RULES.values())
) -> DataFrame:
    """First qualifying instant per subject, one column ``first_<name>`` per rule.

    Responses are reduced to one row per (subject, responder) before they meet the openers, so a
    subject with a flood of responses is combined on the map side and never travels whole.
    """
    rules = list(rules)
    names = [d.name for d in rules]
    any_of = reduce(or_, [qualifies(d) for d in rules])
    found = human_responses(responses.where(any_of)).groupBy("id", "login").agg(
        *[F.min(F.when(qualifies(d), F.col("visible_at"))).alias(f"first_{d.name}") for d in rules]
    )
    openers = subjects.select("id", "actor_login")
    return (
        found.join(openers, "id")
        .where(not_own())
        .groupBy("id")
        .agg(*[F.min(f"first_{n}").alias(f"first_{n}") for n in names])
    )


def outcome_columns(first: Column, settings: Settings) -> list[Column]:
    wait = hours_between("created_at", first)
    censor = F.lit(settings.censor_h)
    never = F.coalesce(wait > censor, F.lit(True))
    return [
        first.alias("first_event_at"),
        wait.alias("wait_h"),
        never.alias("never_answered"),
        (never | (wait > settings.threshold_h)).alias("is_slow"),
        F.least(F.coalesce(wait, censor), censor).alias("wait_h_censored"),
        (~never).alias("event_observed"),
    ]


def label(
    subjects: DataFrame,
    responses: DataFrame,
    settings: Settings,
    rule: Rule = RULES[PRIMARY],
) -> DataFrame:
    """One row per subject: wait, never / slow / observed flags and the censored wait."""
    firsts = first_events(subjects, responses, [rule])
    return subjects.select("project", "id", "created_at").join(firsts, "id", "left").select(
        "project", "id", "created_at", *outcome_columns(F.col(f"first_{rule.name}"), settings)
    )


def label_all(subjects: DataFrame, responses: DataFrame, settings: Settings) -> DataFrame:
    """All rules at once, long form with a ``definition`` column; responses are read once."""
    firsts = first_events(subjects, responses)
    pairs = ", ".join(f"'{n}', first_{n}" for n in RULES)
    wide = subjects.select("project", "id", "created_at").join(firsts, "id", "left")
    long = wide.selectExpr(
        "project", "id", "created_at", f"stack({len(RULES)}, {pairs}) as (definition, _first)"
    )
    return long.select("definition", "project", "id", "created_at", *outcome_columns(F.col("_first"), settings))


def modelling_rows(subjects: DataFrame, settings: Settings) -> DataFrame:
    """Subjects opened by people inside the window, both ends included."""
    return subjects.where(
        ~truthy("actor_is_bot")
        & (F.col("created_at") >= instant(settings.window_start))
        & (F.col("created_at") <= instant(settings.window_end))
    )


def prepare_rows(subjects: DataFrame, labels: DataFrame, kept: DataFrame, settings: Settings) -> DataFrame:
    """Labelled modelling rows of the kept projects."""
    marks = labels.select("id", "is_slow", "first_event_at", "wait_h")
    rows = modelling_rows(subjects, settings).join(kept.select("project"), "project", "left_semi")
    return rows.join(marks, "id")
