"""Column expressions: time arithmetic, seeded order, text formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waitline.conf import DAY_US, HOUR_US, KNOWN_BOTS


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(value) -> Column:
    """Microseconds since the epoch; every interval in the package is integer arithmetic on it."""
    return F.unix_micros(as_col(value))


def instant(when) -> Column:
    """A literal instant from a timezone-aware datetime."""
    return F.timestamp_micros(F.lit(instant_us(when)))


def instant_us(when) -> int:
    """The same instant as integer microseconds, free of float rounding."""
    from datetime import datetime, timedelta, timezone

    return (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(HOUR_US))


def days_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(DAY_US))


def truthy(value) -> Column:
    """True only where the flag is known to be true."""
    return F.coalesce(as_col(value), F.lit(False))


def is_bot(login, kind) -> Column:
    """Typed as a bot, suffixed ``[bot]``, or a known automation login, in any letter case."""
    low = F.lower(F.coalesce(as_col(login), F.lit("")))
    return F.coalesce(as_col(kind) == "Bot", F.lit(False)) | low.endswith("[bot]") | low.isin(*KNOWN_BOTS)


def seeded(seed, *parts) -> Column:
    """A hex string that orders rows pseudo-randomly, the same for any partitioning of the data."""
    cells = [as_col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cells))


def seeded_int(seed, *parts) -> Column:
    """A non-negative integer below 2**32 drawn from the same hash."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("long")


def rate(part, whole) -> Column:
    return part.cast("double") / whole


def nearest(value, digits: int) -> Column:
    """The decimal of so many digits that lies nearest to the double itself; of two equally near ones the even.

    2.675 as a double lies below its decimal text and becomes 2.67.  ``bround`` rounds the text.
    """
    c, scale = F.abs(as_col(value)), 10**digits
    whole = F.floor(c * scale).cast("long")
    middle = (2 * whole + 1) / F.lit(2.0 * scale)
    # Where the double is the one next to the middle, both are compared as integers, exactly.
    power = F.pow(F.lit(2.0), 52 - F.floor(F.log2(c)))
    own, other = (c * power).cast("long") * (2 * scale), (2 * whole + 1) * power.cast("long")
    up = F.when(c != middle, c > middle).when(own != other, own > other).otherwise(whole % 2 == 1)
    return F.signum(as_col(value)) * (whole + up.cast("long")) / F.lit(float(scale))


def format_value(value, kind: str, is_rate: bool = False) -> Column:
    """Text of one feature value: missing, yes/no, two decimals for rates, grouped integer."""
    c = as_col(value)
    if kind == "bool":
        text = F.when(c, "yes").otherwise("no")
    elif kind == "str":
        text = c.cast("string")
    elif is_rate:
        text = F.format_string("%.2f", nearest(c.cast("double"), 2))
    else:
        text = F.format_number(F.bround(c.cast("double"), 0), 0)
    return F.when(c.isNull(), "missing").otherwise(text)


def iso_week(at) -> Column:
    """ISO year and week, for example 2026-W01."""
    c = as_col(at)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), c), F.weekofyear(c))
