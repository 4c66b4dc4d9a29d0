"""Product codes for vectors: each part is replaced by the index of its nearest codebook entry, found with pivots.

LAESA: the distances of every part to a few fixed pivots are computed once and kept beside it.  A round then only needs
the distances of its codebook entries to the same pivots: by the triangle inequality the difference of the two is a
lower bound of the distance between part and entry.  Entries are tried in ascending order of their bound and a row is
done when the next bound exceeds the best distance found; what is evaluated is evaluated in exact integers.

A round is one job over a written table; tasks return sums and counts of their rows for each entry, so that what moves
and what reaches the driver is set by the size of the codebooks and not by the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitline.functions.ordered import join_null_safe
from waitline.llm.common import checked_broadcast
from waitline.session import written

#: Steps of a unit, parts of a vector, entries of a codebook, rounds, pivots of a part.
SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Steps from zero up to which squared distances and their sums are exact in a long.
REACH = 1 << 27
#: What a stored distance may be off, as a share: it is a single-precision number.
SLACK = 2.0**-22


class Codebooks(NamedTuple):
    """entries [part, entry, position] and the pivots [part, pivot, position] they are compared with."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def fixed_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Of the first entries of each part: entry 0, then each time the one farthest from those taken (sum of distances)."""
    out = []
    for part in entries:
        away = np.sqrt(((part[:, None] - part[None]) ** 2).sum(axis=2).astype(float))
        taken = [0]
        while len(taken) < min(n, len(part)):
            total = away[taken].sum(axis=0)
            total[taken] = -1
            taken.append(int(total.argmax()))
        out.append(part[taken])
    return np.array(out)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances [row of x, row of y] from exact squares."""
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2).astype(float))


def nearest(x: np.ndarray, to_pivot: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (ties to the lower one) and squared distance of each row; how many were evaluated."""
    entry_pivot = distances(entries, pivots)
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        mine, theirs = to_pivot[:, p, None].astype(float), entry_pivot[None, :, p]
        np.maximum(bound, np.abs(mine - theirs) - SLACK * (mine + theirs), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    # Rounding of the square may not lift a bound above a distance that ties with it.
    least = np.take_along_axis(bound, order, axis=1) ** 2 * (1 - SLACK)
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    open_rows, evaluated = np.arange(len(x)), 0
    for k in range(len(entries)):
        open_rows = open_rows[least[open_rows, k] <= best[open_rows]]
        if not len(open_rows):
            break
        entry = order[open_rows, k]
        d = ((x[open_rows] - entries[entry]) ** 2).sum(axis=1)
        evaluated += len(open_rows)
        better = (d < best[open_rows]) | ((d == best[open_rows]) & (entry < at[open_rows]))
        rows = open_rows[better]
        best[rows], at[rows] = d[better], entry[better]
    return at, best, evaluated


def whole_vectors(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """vec_id, label, steps (integers) of the rows that can be coded."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < REACH))
    fits = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    rows = vectors.select("vec_id", "label", "embedding").where(F.coalesce(finite & fits, F.lit(False)))
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("steps"))


def _matrix(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def with_pivot_distances(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``away``: the distance of each part to each of its pivots, computed this once and written."""
    parts, n, width = pivots.shape
    schema = T.StructType([*rows.schema.fields, T.StructField("away", T.ArrayType(T.FloatType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("steps"), (parts, width)).astype(np.int64)
            away = np.stack([distances(x[:, m], pivots[m]) for m in range(parts)], axis=1).astype(np.float32)
            made = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (parts * n), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return written(rows.mapInArrow(each, schema), "pivot-distances")


def _assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts [row, part, position], index [row, part] and squared distance [row, part] of a batch."""
    parts, n, width = books.pivots.shape
    x = _matrix(batch.column("steps"), (parts, width)).astype(np.int64)
    away = _matrix(batch.column("away"), (parts, n))
    found = [nearest(x[:, m], away[:, m], books.entries[m], books.pivots[m]) for m in range(parts)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def next_entries(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """The entries after one round: the mean of their parts, rounded down; an entry without parts stays."""
    parts, k, width = books.entries.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * k, np.int64), np.zeros((width, parts * k), np.int64)
        for batch in batches:
            x, at, _ = _assigned(batch, books)
            cell = (at + np.arange(parts) * k).ravel()
            count += np.bincount(cell, minlength=parts * k)
            flat = x.reshape(-1, width)
            by_cell = np.argsort(cell, kind="stable")
            cells, first = np.unique(cell[by_cell], return_index=True)
            if len(cells):
                total[:, cells] += np.add.reduceat(flat[by_cell], first, axis=0).T
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell": some, "n": count[some], **{f"s{j}": total[j, some] for j in range(width)}})

    schema = "cell long, n long, " + ", ".join(f"s{j} long" for j in range(width))
    sums = rows.select("steps", "away").mapInArrow(add_up, schema).groupBy("cell").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    entries = books.entries.copy()
    for r in sums.collect():  # one row for each entry of a part
        entries[r.cell // k, r.cell % k] = [r[f"s{j}"] // r.n for j in range(width)]
    return entries


def first_entries(rows: DataFrame, entries: int, parts: int) -> np.ndarray | None:
    """The parts of the rows with the smallest ids [part, entry, position]; fewer where there are fewer rows."""
    ends = rows.orderBy(F.asc_nulls_last("vec_id"), "steps").limit(entries).collect()
    if not ends:
        return None
    width = len(ends[0].steps)
    steps = np.array([r.steps for r in ends if len(r.steps) == width], np.int64)
    return steps.reshape(len(steps), parts, width // parts).transpose(1, 0, 2)


def encode(
    vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every row that is kept.

    A row is dropped if its vector is null, empty, holds null or non-finite components or such that are too large for
    exact sums (``REACH`` steps), is no multiple of ``parts`` long, or has another length than the vector with the
    smallest id.  Rows without an id are coded and come last for the first codebook; of rows that share an id, the
    smaller vector comes first there.  Repeated rows are coded alike.  Null labels are one label.  Equal distances go
    to the lower index.  An empty table, or one without a whole vector, gives an empty result.
    """
    whole = written(whole_vectors(vectors, scale, parts), "steps")
    begin = first_entries(whole, entries, parts)
    if begin is None:
        return whole.select(
            "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = Codebooks(begin, fixed_pivots(begin, pivots))
    rows = with_pivot_distances(whole.where(F.size("steps") == begin.shape[0] * begin.shape[2]), books.pivots)
    for _ in range(rounds):
        books = books._replace(entries=next_entries(rows, books))
    hexed = np.array([f"{i:02x}" for i in range(max(256, entries))])
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], *T._parse_datatype_string("code string, error long").fields])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, off = _assigned(batch, books)
            made = [pa.array(["".join(r) for r in hexed[at].tolist()], pa.string()), pa.array(off.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *made], names=schema.names)

    coded = written(rows.mapInArrow(code, schema), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return join_null_safe(coded, checked_broadcast(sums), ["label"]).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
