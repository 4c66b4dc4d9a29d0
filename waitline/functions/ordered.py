"""Order statistics that never gather one group in one task.

A plain ``sum() over (partition by key order by x)`` puts a whole key into a single task, and the
unpartitioned form puts the whole table there.  Every function here works in two levels instead:
rows are cut into order-preserving buckets, the buckets are summed first (map-side combined, a few
rows per key), a window over that small table gives what lies before each bucket, and the window
over the rows themselves only spans one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline.session import written

BUCKETS = 1024


def score_bucket(value, low: float = 0.0, high: float = 1.0, n: int = BUCKETS) -> Column:
    """Equal-width bucket of a numeric order column; values outside share the two outer buckets."""
    return F.width_bucket(value.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(n)).cast("int")


def quantile_buckets(df: DataFrame, keys: Sequence[str], value: str, n: int, name: str, accuracy: int = 10_000) -> DataFrame:
    """Add ``name``: which of about ``n`` buckets of equal size, per keys, the value lies in; monotone in it.

    The splitters are quantiles from a mergeable sketch, so that the buckets follow the values however they are spread:
    equal values share a bucket, and a bucket only exceeds its share by what is equal.  Null values are bucket -1.
    """
    cuts = F.array(*[F.lit(i / n) for i in range(1, n)])
    splitters = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, cuts, accuracy)).alias("_splits"))
    with_cuts = join_null_safe(df, splitters, keys) if keys else _with_total(df, splitters)
    # How many splitters lie below, by halving the sorted array.
    low, high = F.lit(0), F.size("_splits")
    state = F.struct(low.alias("lo"), high.alias("hi"))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
        F.get("_splits", mid(s)) < F.col(value), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
        F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length() + 1))), state, step, lambda s: s["lo"])
    return with_cuts.withColumn(name, F.when(F.col(value).isNull(), F.lit(-1)).otherwise(found).cast("int")).drop("_splits")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equality join that lets a null key meet a null key; the keys of the left side stay."""
    there = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(there, reduce(and_, same)).drop(*[f"_right_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Sequence[str],
    bucket: Column,
    descending: bool = False,
    prefix: str = "cum_",
    minima: Sequence[str] = (),
) -> DataFrame:
    """Add ``prefix + c``: the sum of ``c`` over rows of the same keys up to and with this order value.

    Rows with an equal order value see each other.  ``bucket`` must be monotone in ``order``.
    Null keys form a key of their own, null order values come first (last when descending).
    ``minima`` names columns whose running minimum is wanted instead.
    """
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    cut = df.withColumn("_bucket", bucket)
    folds = [(c, F.sum) for c in totals] + [(c, F.min) for c in minima]
    sums = cut.groupBy(*keys, "_bucket").agg(*[f(c).alias(f"_b_{c}") for c, f in folds])
    before = W.partitionBy(*keys).orderBy(way("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_c_{c}") for c in totals],
        *[F.min(f"_b_{c}").over(before).alias(f"_c_{c}") for c in minima],
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(way(order)).rangeBetween(W.unboundedPreceding, W.currentRow)
    local = cut.select("*", *[f(c).over(inside).alias(f"_l_{c}") for c, f in folds])
    return join_null_safe(local, carry, [*keys, "_bucket"]).select(
        *df.columns,
        *[(F.col(f"_l_{c}") + F.col(f"_c_{c}")).alias(prefix + c) for c in totals],
        *[F.least(f"_l_{c}", f"_c_{c}").alias(prefix + c) for c in minima],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """Number rows 1..n per keys in the total order ``order``; ``bucket`` is monotone in its head.

    ``total`` also adds the number of rows per keys.
    """
    cut = df.withColumn("_bucket", bucket)
    sums = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                        *([F.sum("_n").over(W.partitionBy(*keys)).alias(total)] if total else []))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        join_null_safe(cut.withColumn("_rn", F.row_number().over(inside)), carry, [*keys, "_bucket"])
        .select(*df.columns, (F.col("_rn") + F.col("_before")).alias(name), *([total] if total else []))
    )


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the gapless position from 0 in the total order ``order``, as a long ``name``.  The result is a written table.

    The order must tell any two rows apart: then no run of equal rows has to lie in one task, however the values are
    spread.  Rows are cut into ranges, sorted and written; how many rows lie before a range is a sum over one count
    for each range, so that the table of offsets has as many rows as the shuffle has partitions.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    held = written(cut.withColumn("_at", F.monotonically_increasing_id()), name.strip("_") + "-order")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + row).alias(name))


def hash_numbers(
    df: DataFrame, key: str, keys: Sequence[str] = (), name: str = "slot", total: str | None = None
) -> DataFrame:
    """Number rows 0..n-1 in md5 order of ``key``: a dense index without a global sort."""
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string")))
    out = row_numbers(hashed, list(keys), ["_h", key], F.substring("_h", 1, 2), name, total)
    return out.withColumn(name, F.col(name) - 1).drop("_h")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    bucket: Column,
) -> DataFrame:
    """Linearly interpolated quantiles per keys; null values are left out.

    Only counts per distinct value are shuffled and only the rows around each rank are kept.
    ``bucket`` is an expression over ``value``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, keys, value, ["_n"], bucket)
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = join_null_safe(ranked, sizes, keys) if keys else _with_total(ranked, sizes)
    aggs = []
    for p, name in zip(probabilities, names):
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1
        at_low = F.max(F.when((first <= low) & (last >= low), F.col(value)))
        at_high = F.max(F.when((first <= high) & (last >= high), F.col(value)))
        weight = F.max(position - low)
        aggs.append((at_low + (at_high - at_low) * weight).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def _with_total(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table as scalar subqueries."""
    for c in one_row.columns:
        df = df.withColumn(c, one_row.select(c).scalar())
    return df


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Public form of the above: constants computed by one aggregate, usable in any expression."""
    return _with_total(df, one_row)


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str, bucket: Column | None = None
) -> DataFrame:
    """Add the average rank of ``value`` within keys (ties share the mean of their ranks)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, keys, value, ["_n"], score_bucket(F.col(value), -1, 1) if bucket is None else bucket)
    ranks = ranked.select(*keys, value, (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias(name))
    return join_null_safe(df, ranks, [*keys, value])
