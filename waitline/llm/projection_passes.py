"""Near duplicates among embeddings by sorted projection passes.

A pass hashes each vector to the signs of random projections, one after the other, and orders the vectors of a label
lexicographically by these bits: vectors at a small angle share a long beginning and come to lie near each other.  Each
vector is compared with the ``WINDOW`` that follow it, in exact double precision; several passes with other projections
find what one misses, and the verified pairs of all passes are united into components.

No pair leaves its task: a task returns for each vector a number of links and one edge to the first vector of its group
within the block, so that a dense group of m vectors gives m rows and not m squared.  A pair that an earlier pass has
compared is recognised by the places of both vectors in that pass, which travel along, and is not counted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitline.functions.ordered import positions
from waitline.llm.components import components
from waitline.session import written

#: Least cosine of a link, passes, compared neighbours on either side, vectors of a block, seed of the projections.
COSINE, PASSES, WINDOW, BLOCK, SEED = 0.98, 4, 1024, 8192, 2024
#: Bits of a hash: as many as a long holds and stays positive.
BITS = 62
#: Rows that are compared with their windows at a time.
ROWS = 256


def directions(which: int, width: int, seed: int = SEED) -> np.ndarray:
    """The random projections of a pass for vectors of that width, from the seed alone."""
    return np.random.default_rng([seed, which, width]).standard_normal((width, BITS))


def keys_of(x: np.ndarray, passes: int, seed: int = SEED) -> np.ndarray:
    """One long for each row and pass whose order is the lexicographic order of the bits."""
    place = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return np.stack([((x @ directions(p, x.shape[1], seed) > 0) * place).sum(axis=1) for p in range(passes)], axis=1)


def can_link() -> Column:
    """Whether a row can link: it has a label, all components are finite and not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def digested(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) and digest of the rows that can link; equal ones have the same digest."""
    rows = vectors.select("vec_id", "label", "embedding").where(can_link())
    # Adding zero turns a negative zero into a positive one.
    plain = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    return rows.withColumn("embedding", plain).withColumn("digest", F.sha2(F.to_json(F.struct("label", "embedding")), 256))


def distinct_vectors(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """digest, label, embedding, first (least id), copies, keys, node: one row for each vector and label, written."""
    classes = digested(vectors).groupBy("digest").agg(
        F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"),
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    schema = T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("embedding")
            width = np.diff(held.offsets.to_numpy())
            flat, keys = held.flatten().to_numpy(zero_copy_only=False), [None] * len(width)
            start = np.concatenate([[0], np.cumsum(width)])
            for d in np.unique(width):
                rows = np.flatnonzero(width == d)
                x = flat[start[rows][:, None] + np.arange(d)]
                for row, key in zip(rows, keys_of(x / np.abs(x).max(axis=1, keepdims=True), passes, seed), strict=True):
                    keys[row] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    # Numbers are given as the rows are written, so that every later reading sees the same ones.
    return written(classes.mapInArrow(each, schema).withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")


def places(classes: DataFrame, passes: int) -> DataFrame:
    """node, rank: the place of each vector in the order of each pass, gapless over all labels."""
    spread = classes.select("node", "label", F.size("embedding").alias("width"), F.posexplode("keys").alias("pass", "key"))
    order = [F.col(c) for c in ("pass", "label", "width", "key", "node")]
    at = positions(spread, order, "rank")
    rank = [F.max(F.when(F.col("pass") == p, F.col("rank"))) for p in range(passes)]
    return at.groupBy("node").agg(F.array(*rank).alias("rank"))


def block_links(x: np.ndarray, group: np.ndarray, rank: np.ndarray, copies: np.ndarray, which: int, own: int, window: int, cosine: float):
    """Links new in this pass and the first row of the component, for each row of a block in rank order.

    The first ``own`` rows are compared with the ``window`` rows after them, the others belong to the next block.
    """
    n = len(x)
    y = x / np.abs(x).max(axis=1, keepdims=True)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    links, left, right = np.zeros(n, np.int64), [], []
    for at in range(0, own, ROWS):
        last = min(own, at + ROWS)
        near = y[at:last] @ y[at:last + window].T
        i, j = np.nonzero(near >= cosine)
        keep = (j > i) & (j - i <= window)
        i, j = i[keep] + at, j[keep] + at
        keep = group[i] == group[j]
        for q in range(which):  # not where an earlier pass has compared the two
            keep &= np.abs(rank[i, q] - rank[j, q]) > window
        i, j = i[keep], j[keep]
        links += np.bincount(i, weights=copies[j], minlength=n).astype(np.int64)
        links += np.bincount(j, weights=copies[i], minlength=n).astype(np.int64)
        left.append(i.astype(np.int32))
        right.append(j.astype(np.int32))
    i, j = np.concatenate(left or [[]]).astype(np.int64), np.concatenate(right or [[]]).astype(np.int64)
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == root).all():
            return links, root
        root = now


def pass_links(classes: DataFrame, ranks: DataFrame, passes: int, window: int, block: int, cosine: float) -> DataFrame:
    """node, links, root: what each pass adds to a vector, one row for each block that links it."""
    if window > block:
        raise ValueError("a window may not be longer than a block")
    rows = classes.select("node", "label", "embedding", "copies").join(ranks, "node")
    by_pass = rows.select("*", F.posexplode("rank").alias("pass", "at"))
    home = F.floor(F.col("at") / block)
    # The first rows of a block are also the ends of the windows of the one before.
    blocks = F.when((F.col("at") % block < window) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    dealt = by_pass.select("*", F.explode(blocks).alias("block"))
    schema = "node long, links long, root long"

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        rank, node = np.vstack(rows["rank"].to_numpy()), rows["node"].to_numpy()
        width = rows["embedding"].map(len).to_numpy()
        group = rows.assign(_width=width).groupby(["label", "_width"]).ngroup().to_numpy()
        x = np.zeros((len(rows), width.max()))  # shorter vectors are filled up; they only meet their like
        for d in np.unique(width):
            x[width == d, :d] = np.vstack(rows["embedding"][width == d].to_numpy())
        own = int((rows["at"].to_numpy() // block == key[1]).sum())
        links, root = block_links(x, group, rank, rows["copies"].to_numpy(), int(key[0]), own, window, cosine)
        some = (links > 0) | (root != np.arange(len(root)))
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})

    return dealt.groupBy("pass", "block").applyInPandas(compare, schema)


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id, kept, n_copies of every row.

    Rows with equal vector and label are one class, linked with each other; n_links counts the other rows of the class
    and all rows of the classes found linked to it.  A row without a label, or whose vector is null, empty, zero or
    holds null or non-finite components, links with nothing: its n_copies is 0 and it is its own component.  Vectors of
    different length never link.  component_id is the least id in reach, null where all of them are null; kept says
    whether it is the row's own id, null for null, so that rows that repeat both id and vector are all kept.  Every
    link reported has a cosine of at least ``cosine``; a link is found if its vectors lie within ``window`` distinct
    vectors in one of the passes, so that the number found for a vector is at most 2 * window * passes classes, and
    what a denser group lacks in counted links it keeps in connection.  An empty table gives an empty result.
    """
    classes = distinct_vectors(vectors, passes, seed)
    ranks = written(places(classes, passes), "vector-ranks")
    found = written(pass_links(classes, ranks, passes, window, block, cosine), "vector-links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    placed = classes.select("digest", "node", "first", "copies").join(degree, "node", "left").join(
        roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "digest", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    told = written(placed.join(names, "root").select("digest", "copies", "links", "component_id"), "vector-classes")
    # A class that is alone needs no word: its row is its own component.  Only the others are joined.
    told = told.where((F.col("copies") > 1) | (F.col("links") > 0))
    able = digested(vectors).select("vec_id", "digest")
    joined = able.join(told, "digest", "left").select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"))
    none = F.lit(0).cast("long")
    rest = vectors.where(~can_link()).select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), none.alias("n_copies"))
    return joined.unionByName(rest).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_copies")
