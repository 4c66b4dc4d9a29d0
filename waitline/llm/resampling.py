"""Importance resampling towards a target: documents drawn by how much more likely the target makes their words.

Batch concatenation: the texts of a batch are joined with a separator that no word can hold, one pass of a regular
expression finds all words, ``searchsorted`` on the offsets of the texts says whose each word is, and runs of words that
reach into the next text are masked before ``bincount`` adds them up.  Features are hashed into a fixed number of buckets;
the log ratio of the bucket's shares in target and corpus is its gain.  Documents with the highest sum of gains plus
Gumbel noise are drawn, which is a draw without replacement in proportion to the importance weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitline.functions.ordered import positions
from waitline.llm.common import SLICE_BYTES
from waitline.session import written

#: Longest run of words that is a feature, buckets, seed of the noise, words a drawn document has at least, per cent drawn.
ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEPARATOR = b"\x00"


def features(texts: list[bytes | None], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one batch: the text and the bucket of each feature, and the number of words of each text."""
    texts = [t or b"" for t in texts]
    joined = _SEPARATOR.join(texts).lower()  # bytes: A-Z only
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    found = [(m.start(), m[0]) for m in _WORD.finditer(joined)]
    words = [w for _, w in found]
    owner = np.searchsorted(offsets, np.fromiter((at for at, _ in found), np.int64, len(found)), side="right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    crc = list(map(zlib.crc32, words))
    owners, hashed = [owner], [np.array(crc, np.int64)]
    tails = [b" " + w for w in words] if order > 1 else []
    for k in range(2, order + 1):  # a run of k words is the run of k - 1, a space and one word more
        crc = list(map(zlib.crc32, tails[k - 1:], crc))
        inside = owner[:len(crc)] == owner[k - 1:]
        owners.append(owner[:len(crc)][inside])
        hashed.append(np.array(crc, np.int64)[inside])
    return np.concatenate(owners), np.concatenate(hashed) % buckets, n_words


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket.  A task adds up its own texts first; the result has ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rows in _slices(batches):
            total += np.bincount(features(rows.column(0).to_pylist(), order, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]})

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, of every bucket."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of its features' gains) of every row; row-local."""
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *T._parse_datatype_string("n_words long, n_features long, weight long").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            n = rows.num_rows
            owner, bucket, n_words = features(rows.column("text").to_pylist(), order, len(gain))
            # Sums of integers below 2^53 are exact as doubles.
            weight = np.bincount(owner, weights=gain[bucket].astype(float), minlength=n).astype(np.int64)
            made = [n_words.astype(np.int64), np.bincount(owner, minlength=n).astype(np.int64), weight]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, made)], names=schema.names)

    return source.mapInArrow(each, schema)


def resample(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; rank is null for what is not drawn.

    Null and empty texts have no features and weight 0 and are never drawn; a null target text counts as empty.  Rows
    without an id take the noise of an empty id and come last among equal scores; rows equal in id and text share a
    score and take a rank each.  Very long texts are batches of their own.  Without target texts every gain compares
    with equal shares; an empty table gives an empty result.  Further columns of ``docs`` and ``target`` are not read.
    """
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(2**32)))).cast("long")
    scored = written(weigh(docs, gain, order).withColumn("score", F.col("weight") + noise), "importance")
    # Read back, a row's number is fixed: it tells rows apart that are equal in everything else.
    numbered = scored.withColumn("_row", F.monotonically_increasing_id())
    able = numbered.where(F.col("n_words") >= least_words)
    n_drawn = able.count() * percent // 100
    places = positions(able.select("doc_id", "score", "_row"), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")], "_place")
    drawn = places.where(F.col("_place") < n_drawn).select(F.col("_row").alias("_drawn"), (F.col("_place") + 1).alias("rank"))
    return numbered.join(drawn, F.col("_row") == F.col("_drawn"), "left").select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank")
