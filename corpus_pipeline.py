"""From raw documents to packed batches: toxicity, exact and near duplicates, benchmark leaks, packing.

Every stage takes the documents its predecessor kept and returns them with their own columns, less what it drops; the
last one returns their places in the batches.  Between stages the documents are a Parquet table, so that a lost executor
costs no more than a stage.

Every filter judges and drops rows one by one, by a key of their own: rows that share an id, have none, or are equal in
everything are judged like others, and exactly one row of a group of duplicates stays.  Null texts count as empty ones:
they are not toxic, are copies of each other, and take one token.  Very long texts are judged whole.  An empty table
passes every stage as an empty table; columns besides ``doc_id`` and ``text`` pass unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitline.llm import decontamination, exact_dedup, packing, simhash, toxicity
from waitline.llm.common import keep_rows, table, with_row_keys
from waitline.session import written

#: The steps are statistical or iterative: tests compare the rows with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, does not reject.

    Equal texts get equal decisions, with or without an id; without labels nothing is rejected.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = with_row_keys(docs, first=True)
    return keep_rows(rows, toxicity.score(rows, model).withColumn("kept", ~F.col("rejected")), "kept")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id, a row without an id only where none has one.

    Half of the ids stand for the snapshot.
    """
    rows = with_row_keys(docs, first=False)
    half = F.crc32(F.col("doc_id.id").cast("string").cast("binary")) % 2 == 0
    return keep_rows(rows, exact_dedup.dedup(rows, half), "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, one row with the smallest id; rows without words are one group."""
    rows = with_row_keys(docs, first=True)
    kept = F.col("doc_id") == F.col("component_id")
    return keep_rows(rows, simhash.near_duplicates(rows).withColumn("kept", kept), "kept")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark question, as it is or with other numbers, names and units; no items, none dropped."""
    rows = with_row_keys(docs, first=True)
    return keep_rows(rows, decontamination.contaminated(rows, table(spark, sf_dir, "benchmark")), "clean")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of similar length for what is left; every row takes a place, repeated ones each their own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
