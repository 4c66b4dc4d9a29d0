"""Settings shared by every operator.  All instants are UTC timestamps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import NamedTuple

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# Logins that are automation even when typed as ordinary users.
KNOWN_BOTS = (
    "dependabot", "renovate", "github-actions", "codecov", "coveralls", "sonarcloud", "netlify",
    "vercel", "pre-commit-ci", "allcontributors", "stale", "mergify", "copilot",
)

# The three response streams.
STREAMS = ("reviews", "thread_comments", "issue_comments")

# How many entries of each nested connection a raw page carries at most.
CAPTURED = {
    "reviews": 50,
    "comments": 50,
    "reviewThreads": 30,
    "thread_comments": 10,
    "commits": 30,
    "labels": 20,
}

# The language family each cohort stratum accepts.
LANGUAGE_FAMILY = {"Python": ("Python",), "TypeScript": ("TypeScript", "JavaScript"), "Go": ("Go",)}

# Opening-hour slices, [from, to).
HOUR_BUCKETS = ((0, 6, "00-06"), (6, 12, "06-12"), (12, 18, "12-18"), (18, 24, "18-24"))


class Rule(NamedTuple):
    """Which responses end the wait: a SQL condition over a response row that must hold."""

    name: str
    counts: str


# The five competing rules; D5 is the primary one.
RULES = {
    "D1": Rule("D1", "stream = 'reviews'"),
    "D2": Rule("D2", "stream in ('reviews', 'thread_comments')"),
    "D3": Rule("D3", "stream in ('reviews', 'thread_comments', 'issue_comments')"),
    "D4": Rule("D4", "stream in ('reviews', 'thread_comments', 'issue_comments') and not coalesce(is_minimized, false)"),
    "D5": Rule("D5", "stream in ('reviews', 'thread_comments', 'issue_comments') and coalesce(association, '') <> 'NONE'"),
}
PRIMARY = "D5"


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class Settings:
    """Thresholds and windows.  The defaults are the published study's values."""

    threshold_h: float = 168.0
    censor_h: float = 720.0
    trailing_days: int = 90
    recent_days: int = 7
    window_start: datetime = field(default_factory=lambda: utc("2024-01-01T00:00:00"))
    window_end: datetime = field(default_factory=lambda: utc("2026-06-30T23:59:59"))
    cutoff: datetime = field(default_factory=lambda: utc("2026-01-01T00:00:00"))
    alpha: float = 5.0
    seed: int = 7411
    cap_fraction: float = 0.05
    folds: int = 5
    request_grace_s: int = 60
    timeline_cap: int = 60
    # Projects and actors are split over time buckets of these widths, so that no task holds one
    # whole.  Results do not depend on them.
    bucket_days: int = 7
    actor_bucket_days: int = 180

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)
