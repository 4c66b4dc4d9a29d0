"""What the corpus operators share: reading, numbering in two levels, joins by a checked size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waitline.session import use_utc, written

#: Words are maximal runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Text that is taken apart at a time in a Python worker.
SLICE_BYTES = 4 << 20

#: Rows of at most 64 bytes up to which a checked table may be broadcast (about 13 MB).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns every operator reads; others may have any name, as they end here."""
    return docs.select(F.col("doc_id"), F.col("text"))


def map_texts(docs: DataFrame, work: Callable[[list], dict], schema: str) -> DataFrame:
    """doc_id and the columns ``schema`` that ``work`` makes of each block of texts, a list that may hold None.

    Row-local: no shuffle.  A batch is worked on in slices of some ``SLICE_BYTES``, which bounds the memory of a
    worker.  The id passes through as it is, null or not.
    """
    source = id_and_text(docs)
    out = T.StructType([source.schema["doc_id"], *T._parse_datatype_string(schema).fields])
    kinds = to_arrow_schema(out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                made = work(rows.column("text").to_pylist())
                cells = [rows.column("doc_id")]
                cells += [pa.array(made[f.name], type=f.type, from_pandas=True) for f in list(kinds)[1:]]
                yield pa.RecordBatch.from_arrays(cells, names=kinds.names)

    return source.mapInArrow(each, out)


def hash_mod(value: Column, n: int, start: int = 1) -> Column:
    """0 to n-1 from eight hex digits of the md5 of a value as text; null counts as empty."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("long") % F.lit(n)).cast("long")


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds it small; else unchanged, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_row_keys(docs: DataFrame, first: bool) -> DataFrame:
    """``docs`` with a key of its own for each row in place of ``doc_id``: (flag, id, file, row).

    The place of a row in the files it is read from tells rows apart that share an id, have none, or are equal in
    everything.  Keys are ordered by id; ``first`` says whether the smallest key or the largest is going to stay, and
    the flag makes rows without an id the last choice either way.
    """
    try:
        placed = docs.select("*", "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # not read from files, or no longer only that
        placed = written(docs, "rows").select("*", "_metadata.file_path", "_metadata.row_index")
    id_ = F.col("doc_id")
    key = F.struct((id_.isNull() if first else id_.isNotNull()).alias("flag"), id_.alias("id"),
                   F.xxhash64("file_path").alias("file"), F.col("row_index").alias("row"))
    return placed.select(*[key.alias("doc_id") if c == "doc_id" else F.col(c) for c in docs.columns])


def keep_rows(keyed: DataFrame, decisions: DataFrame, flag: str) -> DataFrame:
    """The rows with keys of their own whose decision has no false ``flag``, with their ids put back.

    The dropped keys are the shorter list.
    """
    gone = decisions.where(~F.col(flag)).select(F.col("doc_id").alias("_gone"))
    kept = keyed.join(checked_broadcast(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    return kept.withColumn("doc_id", F.col("doc_id.id"))


def numbered(df: DataFrame, group: list[str], cell: Column, order: list[str], name: str, cells: int) -> DataFrame:
    """Add the gapless position from 0 of each row within its group, as a long ``name``.

    The order is by cell, then by ``order``.  A window only spans one cell of a group; how many rows lie before
    it comes from counts, one row for each cell.  ``cells`` bounds these rows, as groups times cells: up to
    ``BROADCAST_ROWS`` of them are broadcast.  Null groups form a group.
    """
    cut = df.withColumn("_cell", cell)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(group)]
    names = [f"_k{i}" for i in range(len(group))]
    cut = cut.select("*", *key)
    before = W.partitionBy(*names).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*names, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*names, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*names, "_cell").orderBy(*order)
    ranked = cut.withColumn("_row", F.row_number().over(inside))
    if cells <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return ranked.join(offsets, [*names, "_cell"]).select(
        *df.columns, (F.col("_before") + F.col("_row") - 1).cast("long").alias(name))
