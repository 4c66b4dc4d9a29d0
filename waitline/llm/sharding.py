"""Shards by fixed virtual slots.

A record's slot is a hash of its id and never changes.  A small table maps slots to shards; it has a version, and
every change of the cluster is an edit of that table: a new shard takes slots from the others and no slot moves
between old shards; a rebalance moves single slots from heavy to light shards by their bytes.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline.llm.common import hash_mod, id_and_text, numbered
from waitline.session import written

#: Virtual slots; fixed for the life of a store.
SLOTS = 4096
#: Cells of one slot for the numbering of its rows.
CELLS = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row.

    Null text: size 1, the checksum of nothing.  Null id: the slot of the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return id_and_text(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hash_mod(F.col("doc_id"), slots).alias("virtual_slot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """virtual_slot, slot_bytes, slot_rows; at most one row for each slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots are dealt to the shards in turn."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def grown_map(current: DataFrame, shards: int) -> DataFrame:
    """The next version, with one shard more: it takes the same share of every old shard's slots, none else moves."""
    turn = F.row_number().over(W.partitionBy("shard").orderBy(F.md5(F.col("virtual_slot").cast("string")), "virtual_slot"))
    held = F.count(F.lit(1)).over(W.partitionBy("shard"))
    goes = turn <= F.floor(held / F.lit(shards + 1))
    return current.select(
        (F.col("version") + 1).alias("version"), "virtual_slot",
        F.when(goes, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalanced_map(spark: SparkSession, current: DataFrame, loads: DataFrame, shards: int, tolerance: float = 0.01) -> DataFrame:
    """The next version: slots move from the fullest to the emptiest shard until all are near the mean.

    Driver work on one number for each slot, ``SLOTS`` at most.  Each step takes the largest slot that still leaves the
    giver at or above the taker; it ends within the tolerance or when no slot helps.
    """
    held = current.join(loads, "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("slot_bytes", F.lit(0)).alias("b")).collect()
    total = [0] * shards
    slots: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for r in held:
        total[r.shard] += r.b
        slots[r.shard].append((r.b, r.virtual_slot))
    for _ in range(len(held)):
        high, low = max(range(shards), key=lambda s: (total[s], s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        if gap <= tolerance * sum(total) / shards:
            break
        fits = heapq.nlargest(1, (x for x in slots[high] if 0 < x[0] <= gap // 2))
        if not fits:
            break
        slots[high].remove(fits[0])
        slots[low].append(fits[0])
        total[high] -= fits[0][0]
        total[low] += fits[0][0]
    version = held[0].version + 1 if held else 1
    rows = [(version, v, s) for s in range(shards) for _, v in slots[s]]
    return spark.createDataFrame(rows, "version int, virtual_slot long, shard int")


def map_history(spark: SparkSession, rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """All versions of the map in one stored table: first, grown by a shard, and (from the first) rebalanced by bytes."""
    first = first_map(spark, shards, slots)
    balanced = rebalanced_map(spark, first, slot_loads(rows), shards).withColumn("version", F.lit(3))
    return written(first.unionByName(grown_map(first, shards)).unionByName(balanced), "shard-map")


def assign(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Place every row under the `key` law: id and shard count decide.

    Returns doc_id, size, text_crc32, law, shard, slot (position in the shard, gapless from 0), grown_shard (with one
    shard more), virtual_slot, slot_bytes, balanced_shard (the map after a rebalance by bytes).  Copies and repeated
    rows are placed by their ids; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = records(docs, slots)
    versions = map_history(spark, rows, shards, slots)
    of = lambda v, name: versions.where(F.col("version") == v).select("virtual_slot", F.col("shard").alias(name))
    # One row for each virtual slot: the broadcast is bounded by the number of slots.
    places = of(1, "shard").join(of(2, "grown_shard"), "virtual_slot").join(of(3, "balanced_shard"), "virtual_slot")
    places = places.join(slot_loads(rows), "virtual_slot", "left")
    placed = rows.join(F.broadcast(places), "virtual_slot")
    cell = F.col("virtual_slot") * CELLS + F.col("text_crc32") % CELLS
    out = numbered(placed, ["shard"], cell, ["doc_id", "text_crc32"], "slot", slots * CELLS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot",
        "slot_bytes", "balanced_shard")
