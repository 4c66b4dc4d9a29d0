"""Time split, leave-groups-out split and the per-project cap on training rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.conf import DAY_US, Settings
from waitline.functions.columns import instant, micros, seeded
from waitline.functions.ordered import positions, row_numbers, with_scalars
from waitline.session import written


def draw_order(rows: DataFrame, seed: int) -> DataFrame:
    """Add ``draw_no``: each project's rows numbered in a seeded order, split over hash buckets."""
    hashed = rows.withColumn("_h", seeded(seed, "id"))
    return row_numbers(hashed, ["project"], ["_h", "id"], F.substring("_h", 1, 2), "draw_no").drop("_h")


def cap_per_project(rows: DataFrame, settings: Settings) -> DataFrame:
    """At most ``cap_fraction`` of the uncapped total per project, at least one row each."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    capped = with_scalars(draw_order(rows, settings.seed), total)
    keep = F.greatest(F.lit(1), F.floor(F.col("_total") * settings.cap_fraction))
    return capped.where(F.col("draw_no") <= keep).drop("draw_no", "_total")


def scenario_a(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows with ``role``: capped training rows before the cutoff, every row after it as test."""
    cutoff = instant(settings.cutoff)
    train = cap_per_project(rows.where(F.col("created_at") < cutoff), settings)
    test = rows.where(F.col("created_at") >= cutoff)
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test"))).withColumn(
        "fold", F.lit(0).cast("long")
    )


def lightest_first(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, loads before, groups per fold) of each (size, number of groups), given in descending order of size.

    Equal groups that always go to the lightest fold take the places of a merge: fold i offers its loads L_i, L_i + n,
    L_i + 2n, ... and the smallest offers are taken first, of equal ones the lower fold.  How many each fold gets follows
    from the highest offer taken, which is found by halving; nothing is done group by group.
    """
    loads, out = [0] * k, []
    for n, groups in sizes:
        below = lambda v: sum(max(0, -(-(v - load) // n)) for load in loads)  # noqa: E731, B023  offers less than v
        low, high = min(loads), max(loads) + groups * n
        while low < high:  # the largest v with at most ``groups`` offers below it
            mid = (low + high + 1) // 2
            low, high = (mid, high) if below(mid) <= groups else (low, mid - 1)
        got = [max(0, -(-(low - load) // n)) for load in loads]
        for i in range(k):
            if sum(got) < groups and loads[i] + got[i] * n == low:
                got[i] += 1
        out.append((n, list(loads), got))
        loads = [load + g * n for load, g in zip(loads, got, strict=True)]
    return out


#: Groups that one row of the table of places unfolds into.
PLACES = 100_000


def group_folds(rows: DataFrame, k: int, group: str = "project") -> DataFrame:
    """(project, n, fold): largest group first, each to the lightest fold so far; of equal sizes the last name first.

    Only the distinct sizes and how many groups have each reach the driver, at most the square root of twice the rows.
    Groups are numbered by ranges of (size, name) and meet the places of their size by number.  Persist the result: it is
    sensitive to small size changes.
    """
    spark = rows.sparkSession
    sizes = written(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    held = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("n")).collect()
    runs, firsts = lightest_first([(r.n, r.groups) for r in held], k), [0, *accumulate(r.groups for r in held)]
    table = spark.createDataFrame(
        [(first, n, load, fold, got) for first, (n, load, each) in zip(firsts, runs) for fold, got in enumerate(each) if got],
        "first long, n long, loads array<long>, fold int, got long")
    blocks = table.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("got") - 1, F.lit(PLACES).cast("long"))))
    blocks = blocks.repartition("n", "fold", "_first")
    places = blocks.withColumn("_j", F.explode(F.sequence("_first", F.least(F.col("_first") + (PLACES - 1), F.col("got") - 1))))
    # The number of a place is how many offers come before it: lower ones, and equal ones of lower folds.
    offer = F.element_at("loads", F.col("fold") + 1) + F.col("_j") * F.col("n")
    before = F.transform("loads", lambda load, i: F.greatest(
        F.lit(0).cast("long"), F.ceil((offer - load) / F.col("n")) + F.when(
            (i < F.col("fold")) & (offer >= load) & ((offer - load) % F.col("n") == 0), 1).otherwise(0)))
    number = F.aggregate(before, F.lit(0).cast("long"), lambda a, x: a + x)
    placed = places.select((F.col("first") + number).alias("_no"), F.col("fold").cast("long").alias("fold"))
    numbered = positions(sizes, [F.desc("n"), F.desc_nulls_last(group)], "_at")
    return numbered.join(placed, F.col("_at") == F.col("_no")).select(group, "n", "fold")


def scenario_b(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows with ``fold`` and ``role``: per fold its projects as test, the others capped as training.

    The seeded order within a project is the same in every fold, so rows are numbered once.
    """
    folds = group_folds(rows, settings.folds)
    sizes = folds.groupBy("fold").agg(F.sum("n").alias("_held"))
    totals = folds.agg(F.sum("n").alias("_total"))
    caps = with_scalars(sizes, totals).select(
        "fold",
        F.greatest(F.lit(1), F.floor((F.col("_total") - F.col("_held")) * settings.cap_fraction)).alias("_cap"),
    )
    numbered = draw_order(rows, settings.seed).join(folds.select("project", F.col("fold").alias("_own")), "project")
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(settings.folds - 1)).cast("array<long>")))
    role = F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")
    return (
        each.withColumn("role", role).join(caps, "fold")
        .where((F.col("role") == "test") | (F.col("draw_no") <= F.col("_cap")))
        .drop("draw_no", "_own", "_cap")
    )


def row_share(rows: DataFrame) -> DataFrame:
    """Share of all rows per project."""
    n = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return with_scalars(n, rows.agg(F.count(F.lit(1)).alias("_total"))).select(
        "project", "n", (F.col("n") / F.col("_total")).alias("row_share")
    )


def time_folds(rows: DataFrame, k: int, settings: Settings) -> DataFrame:
    """Expanding-window folds in (created_at, id) order: rows with ``position`` and ``valid_fold``.

    Fold f trains on every row before its own block; rows of the first block have no ``valid_fold``.
    """
    width = settings.bucket_days * DAY_US
    numbered = row_numbers(
        rows, [], ["created_at", "id"], F.floor(micros("created_at") / width), "position"
    ).withColumn("position", F.col("position") - 1)
    sized = with_scalars(numbered, rows.agg(F.count(F.lit(1)).alias("_n")))
    size = F.floor(F.col("_n") / (k + 1))
    first = F.col("_n") - k * size
    fold = F.when(F.col("position") >= first, F.floor((F.col("position") - first) / size).cast("int"))
    return sized.withColumn("valid_fold", fold).drop("_n")
