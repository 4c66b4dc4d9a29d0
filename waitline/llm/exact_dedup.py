"""Exact duplicates of an incoming batch against an immutable snapshot.

The snapshot keeps its distinct digests in exact buckets and one static binary-fuse filter for each bucket.  Incoming
digests are made distinct, dealt by the same bucket and screened by its filter.  What passes is joined with the exact
buckets and the texts of both sides are compared; what does not pass is new to the snapshot.  Copies within the batch
are counted apart from all that.  Only digests move, but for the texts that the filter let through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.llm import fuse
from waitline.llm.common import checked_broadcast, hash_mod, id_and_text
from waitline.session import written

#: Digests of one bucket: its filter is built and read by one task.
BUCKET_KEYS = 100_000


class Snapshot(NamedTuple):
    exact: DataFrame  # bucket, text_sha256, n, last: one row for each distinct text
    filters: DataFrame  # bucket, filter
    buckets: int


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and text_sha256 of every row; null text counts as empty."""
    return id_and_text(docs).select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def distinct_digests(rows: DataFrame, buckets: int) -> DataFrame:
    """One row for each text: how many rows have it and their largest id.  Hot texts shrink before the shuffle."""
    held = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    return held.withColumn("bucket", hash_mod(F.col("text_sha256"), buckets))


def snapshot(rows: DataFrame, bucket_keys: int = BUCKET_KEYS, incoming: int = 0) -> Snapshot:
    """Write the exact buckets and the filters of a set of digests; neither is changed afterwards.

    ``incoming`` is the size of the largest batch to come: a bucket's share of either side fits a task.
    """
    buckets = max(1, -(-max(rows.count(), incoming) // bucket_keys))
    exact = written(distinct_digests(rows, buckets), "exact-buckets")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "filter": [fuse.build(group["key"].to_numpy())]})

    keys = exact.select("bucket", F.xxhash64("text_sha256").alias("key"))
    filters = written(keys.groupBy("bucket").applyInPandas(build, "bucket long, filter binary"), "fuse-filters")
    return Snapshot(exact, filters, buckets)


def screened(batch: DataFrame, old: Snapshot) -> DataFrame:
    """The distinct digests of the batch with ``positive``: whether the filter of their bucket has them."""

    def screen(rows: pa.Table, held: pa.Table) -> pa.Table:
        passed = np.zeros(rows.num_rows, bool)
        if rows.num_rows and held.num_rows:
            passed = fuse.contains(held["filter"][0].as_py(), rows["key"].to_numpy())
        return rows.select(["text_sha256", "n", "last"]).append_column("positive", pa.array(passed))

    new = distinct_digests(batch, old.buckets).withColumn("key", F.xxhash64("text_sha256"))
    schema = new.select("text_sha256", "n", "last", F.lit(True).alias("positive")).schema
    return new.groupBy("bucket").cogroup(old.filters.groupBy("bucket")).applyInArrow(screen, schema)


def matched(docs: DataFrame, new: DataFrame, old: Snapshot) -> DataFrame:
    """Texts of the batch that the snapshot has: text_sha256, n and last on either side, after a check of the bytes.

    One text of each side is fetched for a digest that both have.  A pair with an id missing cannot be fetched and is
    judged by its digest.
    """
    both = written(new.where("positive").drop("positive").join(
        old.exact.select("text_sha256", F.col("n").alias("old_n"), F.col("last").alias("old_last")), "text_sha256"), "digest-matches")
    wanted = both.select(F.explode(F.array("last", "old_last")).alias("_id")).where("_id is not null").distinct()
    texts = id_and_text(docs).join(checked_broadcast(wanted), F.col("doc_id") == F.col("_id"), "left_semi").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn(
        "text_sha256", F.sha2(F.col("_text").cast("binary"), 256))
    differ = both.join(texts, (texts.text_sha256 == both.text_sha256) & texts.doc_id.isin(both["last"], both.old_last)).groupBy(
        both.text_sha256.alias("_bad")).agg((F.min("_text") != F.max("_text")).alias("_differ")).where("_differ")
    return both.join(differ.select("_bad"), both.text_sha256 == F.col("_bad"), "left_anti")


def dedup(docs: DataFrame, in_snapshot) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, side, screened_out.

    ``in_snapshot`` is a condition on doc_id: its rows form the snapshot, the others the batch.  Of equal texts the
    row with the largest id stays.  Null text equals empty text; a row without id never stays before one with an id and
    stays where its group has none; rows that repeat both id and text share one decision.
    """
    side = F.when(F.coalesce(in_snapshot, F.lit(False)), F.lit("snapshot")).otherwise(F.lit("batch"))
    rows = written(digests(docs).withColumn("side", side), "digests")
    batch = rows.where("side = 'batch'")
    old = snapshot(rows.where("side = 'snapshot'"), incoming=batch.count())
    new = written(screened(batch, old), "screened")
    common = written(matched(docs, new, old), "byte-checked")
    pick = ("text_sha256", F.col("old_n"), F.col("old_last"), F.col("n").alias("new_n"), F.col("last").alias("new_last"))
    links = common.select(*pick)
    groups = new.select(F.lit("batch").alias("side"), "text_sha256", "n", "last", (~F.col("positive")).alias("screened_out")).unionByName(
        old.exact.select(F.lit("snapshot").alias("side"), "text_sha256", "n", "last", F.lit(False).alias("screened_out")))
    groups = groups.join(links, "text_sha256", "left").select(
        "side", "text_sha256", "screened_out", F.greatest("last", "old_last", "new_last").alias("keep_id"),
        F.coalesce(F.col("old_n") + F.col("new_n"), F.col("n")).alias("group_size"))
    return rows.join(groups, ["text_sha256", "side"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        "side", "screened_out")
