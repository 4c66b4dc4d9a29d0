"""Batches of texts of similar length with the least padding.

The histogram of lengths over all rows is a small table; dynamic programming over it finds the bucket boundaries for
which padding every text up to its boundary costs least.  Inside a bucket, rows in hash order are cut into batches of
as many texts as the token budget holds at that boundary.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import hash_mod, map_texts, numbered
from waitline.session import written

#: Buckets, tokens of a batch, cells of a bucket for numbering.
BUCKETS, BUDGET, CELLS = 16, 65_536, 4096


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, text_crc32: words, or tokens of the tokenizer file at that path, and one for the end of the text."""

    def count(texts: list) -> dict:
        crc = [zlib.crc32((x or "").encode()) for x in texts]
        if tokenizer is None:  # bytes split at space and the control characters 9 to 13
            return {"n_tokens": [len((x or "").encode().split()) + 1 for x in texts], "text_crc32": crc}
        found = _tokenizer(tokenizer).encode_batch([x or "" for x in texts], add_special_tokens=False)
        return {"n_tokens": [len(x.ids) + 1 for x in found], "text_crc32": crc}

    return map_texts(docs, count, "n_tokens long, text_crc32 long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending upper bounds of at most ``buckets`` buckets with the least total padding; the last is the longest.

    ``best[j]`` is the cost of the first j lengths; the best cut before j does not fall as j rises, so that each layer
    is solved by halving: the middle j first, then either side within the cuts it leaves.
    """
    m = len(lengths)
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    top = np.concatenate([[0], lengths]).astype(np.float64)
    best = np.concatenate([[0.0], top[1:] * n[1:]])
    cuts = []
    for _ in range(1, min(buckets, m)):
        now, cut = np.zeros(m + 1), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            low, high, first, last = todo.pop()
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + top[j] * (n[j] - n[i])
            k = int(cost.argmin())
            now[j], cut[j] = cost[k], first + k
            if low < j:
                todo.append((low, j - 1, first, first + k))
            if j < high:
                todo.append((j + 1, high, first + k, last))
        cuts.append(cut)
        best = now
    ends, j = [], m
    for cut in reversed(cuts):
        ends.append(j)
        j = int(cut[j])
        if j == 0:
            break
    if j:
        ends.append(j)
    return [int(lengths[e - 1]) for e in reversed(ends)]


def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lengths, ascending, and how many rows have each.

    D distinct lengths take at least D (D + 1) / 2 tokens, so that they are few even where texts are very long.
    """
    held = rows.groupBy(F.col("n_tokens").alias("length")).count().orderBy("length").collect()
    return np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch_id, place, padding of every row.

    A text longer than the budget is a batch of its own, whole.  Null and empty texts have one token.  Batches are
    numbered without gaps over all buckets; repeated rows take a place each.  Rows without an id are spread by their
    texts.  An empty table gives an empty result.
    """
    rows = written(token_lengths(docs, tokenizer), "lengths")  # texts are read and taken apart once
    lengths, counts = histogram(rows)
    ends = boundaries(lengths, counts, buckets) if len(lengths) else [1]
    fits = [max(1, budget // e) for e in ends]
    held = [int(counts[(lengths <= e) & (lengths > (ends[k - 1] if k else 0))].sum()) if len(lengths) else 0 for k, e in enumerate(ends)]
    first = np.concatenate([[0], np.cumsum([-(-h // f) for h, f in zip(held, fits, strict=True)])]).astype(int).tolist()
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("n_tokens")))
    placed = rows.withColumn("bucket", bucket.cast("int"))
    cell = hash_mod(F.when(F.col("doc_id").isNull(), F.col("text_crc32").cast("string")).otherwise(F.col("doc_id").cast("string")), CELLS)
    placed = numbered(placed, ["bucket"], cell, ["doc_id", "n_tokens"], "_at", len(ends) * CELLS)
    return placed.select(
        "doc_id", "n_tokens", "bucket", of(ends).alias("bucket_len"),
        (of(first[:-1]) + F.floor(F.col("_at") / of(fits))).cast("long").alias("batch_id"),
        (F.col("_at") % of(fits)).cast("int").alias("place"), (of(ends) - F.col("n_tokens")).alias("padding"))
