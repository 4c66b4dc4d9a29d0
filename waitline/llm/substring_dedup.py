"""Passages that another document has already, by FM-indexes over shards of the corpus.

Shards are cut by content, so that no document has to visit every shard: the longest word of a window (of equal lengths
the one with the least hash) is its anchor, and neighbouring windows with one anchor form a piece.  Equal windows have
equal anchors and meet in one shard.  Windows of an anchor with more text than a shard holds are told apart by their least
hash of three words as well, then of seven, then of all their words, until no group is larger; these are functions of the
window too, so that equal windows still meet.  A shard drops pieces whose anchor only one document has, and of the others the windows whose least
hash of three words only one document has; it indexes what is left and streams it against the index; windows whose matching statistic reaches the threshold are looked up for the smallest
document that has them.  Equal pieces are merged first, within a block of documents before the shuffle and within a
shard after it: of a passage that millions of documents share, a block sends one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import id_and_text
from waitline.llm.fm_index import DEPTH, FMIndex, least
from waitline.session import written

#: Words of a window: the threshold of the matching statistics.
WINDOW = 13
#: Bytes of text to a shard and to a block of documents that is cut at a time; windows of a piece at most.
SHARD_BYTES, BLOCK_BYTES, PIECE = 4 << 20, 2 << 20, 1024
#: Counters of the bytes of groups, which share one where their keys fall together; runs of words that tell windows of a
#: large group apart.
SLOTS, FINER = 1 << 22, (3, 7)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_PIECES = np.dtype([("key", "<u4"), ("doc", "<u4"), ("start", "<u4"), ("windows", "<u2"), ("bytes", "<u4")])
_SENT = "bucket long, doc_id long, row long, start long, windows long, pieces binary"


_FOUND = pd.DataFrame({k: np.zeros(0, np.int64) for k in ("doc_id", "row", "start", "windows")})
_NONE = pd.DataFrame({"key": np.zeros(0, np.uint64), **{k: np.zeros(0, np.int64) for k in ("doc", "start", "windows", "a", "b")}})


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in bytes that begin and end with a space."""
    edge = np.flatnonzero(np.diff(_SPACE[data].astype(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n - 1, _ODD), out=sums[1:])
    back = _powers(n, pow(_ODD, -1, 1 << 64))
    return starts, ends, _mix((sums[ends] - sums[starts]) * back[starts])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    n, span, best = len(values) - width + 1, 1, values
    while 2 * span <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    return np.minimum(best[:n], best[width - span: width - span + n])


def _shared(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether other ids are in the group as well."""
    _, place = np.unique(group, return_inverse=True)
    low, high = np.full(len(group), np.iinfo(np.int64).max), np.full(len(group), np.iinfo(np.int64).min)
    np.minimum.at(low, place, ids)
    np.maximum.at(high, place, ids)
    return low[place] != high[place]


def _seeds(slices: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the pieces, in order: its piece and its seed, the least hash of three words in a row."""
    owners, seeds, at, held = [], [], 0, 0
    for i, s in enumerate(slices):
        held += len(s)
        if held >= BLOCK_BYTES or i + 1 == len(slices):
            part = slices[at:i + 1]
            _, _, h = words_of(data := np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8))
            heads = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
            piece = np.searchsorted(heads, np.flatnonzero(_SPACE[data[:-1]] & ~_SPACE[data[1:]]) + 1, "right") - 1
            three = _mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))
            whole = piece[: len(piece) - window + 1] == piece[window - 1:]
            owners.append(at + piece[: len(whole)][whole])
            seeds.append(sliding_least(three, window - 2)[whole])
            at, held = i + 1, 0
    return np.concatenate(owners), np.concatenate(seeds)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(20)).astype(np.int64) % SLOTS


def _finer(key: np.ndarray, h: np.ndarray, at: np.ndarray, width: int, window: int) -> np.ndarray:
    """The keys of the windows at ``at``, told apart by the least hash of their runs of ``width`` words."""
    n = len(h) - width + 1
    runs = _mix(sum(h[j:n + j] * np.uint64(2 * j + 3) for j in range(width)))
    return _mix(key * np.uint64(3) + sliding_least(runs, window - width + 1)[at])


def _widths(window: int) -> list[int]:
    return [*(w for w in FINER if w < window), window]


class _Block:
    """The windows of a block of texts: the words they start at, their documents and the keys of their groups."""

    def __init__(self, texts: list[bytes], window: int):
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.starts, self.ends, self.h = words_of(data)
        heads = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.doc = np.searchsorted(heads, self.starts, "right") - 1
        self.window = window
        n = max(0, len(self.starts) - window + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1:]) if n else np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if len(self.at):
            size = np.minimum(self.ends - self.starts, 15).astype(np.uint64)
            low = (np.uint64(15) - size) << np.uint64(60) | self.h >> np.uint64(4)
            self.key = _mix(sliding_least(low, window)[self.at])

    def refine(self, hot: np.ndarray) -> None:
        """Takes windows whose group is hot (a flag for each slot) apart, as long as it is."""
        rest = np.arange(len(self.at))
        for width in _widths(self.window):
            rest = rest[hot[_slot(self.key[rest])]]
            if not len(rest):
                return
            self.key[rest] = _finer(self.key[rest], self.h, self.at[rest], width, self.window)

    def pieces(self, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of neighbouring windows (all, or those listed) of one group: first window, windows, place of the bytes."""
        at = self.at if some is None else self.at[some]
        key = self.key if some is None else self.key[some]
        new = np.concatenate([[True], (np.diff(at) != 1) | (key[1:] != key[:-1])])
        run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= (np.arange(len(at)) - run) % PIECE == 0
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(at)))
        a = at[first]
        return first if some is None else some[first], windows, self.starts[a] - 1, self.ends[a + windows + self.window - 2] - 1


def cut(texts: list[bytes], window: int = WINDOW, hot: np.ndarray | None = None) -> pd.DataFrame:
    """The pieces of a block of texts: key, doc (index into the block), start (first word), windows, and place of the bytes."""
    block = _Block(texts, window)
    if not len(block.at):
        return _NONE
    if hot is not None:
        block.refine(hot)
    first, windows, a, b = block.pieces()
    at, doc = block.at[first], block.doc
    word = np.searchsorted(doc, np.arange(len(texts)))
    return pd.DataFrame({"key": block.key[first], "doc": doc[at], "start": at - word[doc[at]], "windows": windows, "a": a, "b": b})


def _weigh(table: np.ndarray, texts: list[bytes], window: int, least: float) -> None:
    """Adds to each slot the bytes of the block's pieces, equal ones once; finer groups of those with ``least`` bytes too."""
    block = _Block(texts, window)
    rest = np.arange(len(block.at))
    if not len(rest):
        return
    words = np.concatenate([np.zeros(1, np.uint64), np.cumsum(block.h, dtype=np.uint64)])
    for width in [*_widths(window), 0]:
        first, windows, a, b = block.pieces(rest)
        key, at = block.key[first], block.at[first]
        _, once = np.unique(_mix(key + (words[at + windows + window - 1] - words[at]) * np.uint64(5)), return_index=True)
        np.add.at(table, _slot(key[once]), (b - a)[once])
        rest = rest[table[_slot(block.key[rest])] >= least]
        if not width or not len(rest):
            return
        block.key[rest] = _finer(block.key[rest], block.h, block.at[rest], width, window)


def hot_groups(rows: DataFrame, window: int, size: int, most: int) -> np.ndarray:
    """A flag for each slot: all whose anchors have more than ``most`` bytes of ``size``, perhaps others with over half.

    A task reports the slots that have an eighth of their share of its own bytes, so that less than an eighth of ``most``
    goes unreported of any, and counts finer groups from where the coarser one has it.  Pieces of finer groups overlap
    more, so that one may grow to a few times ``most`` before it is found; that costs time, never a result.
    """
    share = most / size / 8

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = np.zeros(SLOTS, np.int64), 0
        for part in batches:
            for _, _, texts in _blocks(part["doc_id"].tolist(), part["row"].tolist(), part["text"].tolist()):
                seen += sum(map(len, texts))
                _weigh(table, texts, window, share * seen)
        slot = np.flatnonzero(table > share * seen)
        yield pd.DataFrame({"slot": slot, "bytes": table[slot]})

    hot = np.zeros(SLOTS, bool)
    counted = rows.mapInPandas(count, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    hot[[r.slot for r in counted.where(F.col("bytes") > most / 2).select("slot").collect()]] = True
    return hot


def _merge(slices: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal byte strings: the smallest id of each one's group, and the index of the group's first."""
    place: dict[bytes, int] = {}
    group = np.fromiter((place.setdefault(s, i) for i, s in enumerate(slices)), np.int64, len(slices))
    low = np.full(len(slices), np.iinfo(np.int64).max)
    np.minimum.at(low, group, ids)
    return low[group], group


def _blocks(ids: list, rows: list, texts: list[str]) -> Iterator[tuple]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BLOCK_BYTES or i + 1 == len(texts):
            yield np.array(ids[at:i + 1], np.int64), np.array(rows[at:i + 1], np.int64), [x.encode() for x in texts[at:i + 1]]
            at, held = i + 1, 0


def _send(block: tuple, shards: int, packer, window: int = WINDOW, hot: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of a block: packed pieces for each shard, and windows already known to repeat."""
    ids, rows, texts = block
    pieces = cut(texts, window, hot)
    data = b" ".join(texts)
    key, doc = pieces["key"].to_numpy(), pieces["doc"].to_numpy()
    a, b = pieces["a"].tolist(), pieces["b"].tolist()
    _, place, n = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(n[place] > 1)
    low, _ = _merge([data[a[i]:b[i]] for i in often], ids[doc[often]])
    known = often[ids[doc[often]] > low]
    out = [pd.DataFrame({
        "bucket": ids[doc[known]] % shards, "doc_id": ids[doc[known]], "row": rows[doc[known]],
        "start": pieces["start"].to_numpy()[known], "windows": pieces["windows"].to_numpy()[known], "pieces": None})]
    left = np.ones(len(pieces), bool)
    left[known] = False
    bucket = (key % np.uint64(shards)).astype(np.int64)
    order = np.flatnonzero(left)
    order = order[np.argsort(bucket[order], kind="stable")]
    table = np.zeros(len(pieces), _PIECES)
    table["key"], table["start"], table["windows"] = key >> np.uint64(32), pieces["start"], pieces["windows"]
    table["bytes"] = pieces["b"] - pieces["a"]
    names, blobs = [], []
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if not len(part):
            continue
        docs, local = np.unique(doc[part], return_inverse=True)
        own = table[part]
        own["doc"] = local
        body = [np.array([len(docs), len(part)], "<i8").tobytes(), ids[docs].tobytes(), rows[docs].tobytes()]
        body += [np.ascontiguousarray(own[f]).tobytes() for f in _PIECES.names] + [data[a[i]:b[i]] for i in part]
        names.append(bucket[part[0]])
        blobs.append(packer.compress(b"".join(body)))
    out.append(pd.DataFrame({"bucket": names, "doc_id": 0, "row": 0, "start": 0, "windows": 0, "pieces": blobs}))
    return pd.concat(out, ignore_index=True)


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes] | bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    docs, n = np.frombuffer(raw, "<i8", 2)
    at = 16
    ids, rows = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    table = np.zeros(n, _PIECES)
    for f in _PIECES.names:
        table[f] = np.frombuffer(raw, _PIECES[f], n, at)
        at += int(n) * _PIECES[f].itemsize
    return ids, rows, table, raw[at:]


def _shard(blobs: list[bytes], window: int) -> pd.DataFrame:
    """The runs of windows of a shard's pieces that a smaller document has: doc_id, row, start, windows."""
    ids, rows, tables, bodies, at = [], [], [], [], []
    base = 0
    for blob in blobs:
        i, r, t, body = _open(blob)
        ids.append(i[t["doc"]])
        rows.append(r[t["doc"]])
        tables.append(t)
        bodies.append(body)
        at.append(base + np.concatenate([[0], np.cumsum(t["bytes"], dtype=np.int64)[:-1]]))
        base += len(body)
    ids, rows, table, at, body = np.concatenate(ids), np.concatenate(rows), np.concatenate(tables), np.concatenate(at), b"".join(bodies)
    del bodies, tables

    keep = np.flatnonzero(_shared(table["key"], ids))
    ids, rows, table, at = ids[keep], rows[keep], table[keep], at[keep]
    if not len(keep):
        return _FOUND
    slices = [body[x:x + y] for x, y in zip(at.tolist(), table["bytes"].tolist(), strict=True)]
    del body
    # Of these pieces, only the runs of windows stay whose seed other documents have as well.
    owner, seed = _seeds(slices, window)
    order = np.arange(len(owner)) - np.searchsorted(owner, owner)
    live = np.flatnonzero(_shared(seed, ids[owner]))
    if not len(live):
        return _FOUND
    new = np.append(True, (owner[live[1:]] != owner[live[:-1]]) | (np.diff(live) != 1))
    first = np.flatnonzero(new)
    windows, own, offset = np.diff(np.append(first, len(live))), owner[live[first]], order[live[first]]
    key, start = table["key"][own], table["start"][own].astype(np.int64) + offset
    slices = [b" ".join(slices[o].split()[a:a + w + window - 1]) for o, a, w in zip(own.tolist(), offset.tolist(), windows.tolist(), strict=True)]
    ids, rows = ids[own], rows[own]
    low, group = _merge(slices, ids)
    gone = ids > low
    out = [pd.DataFrame({"doc_id": ids[gone], "row": rows[gone], "start": start[gone], "windows": windows[gone]})]
    # The first of equal runs stands for all of them, under their smallest id.
    heads = np.unique(group)
    heads = heads[_shared(key[heads], low[heads])]
    if len(heads):
        words = [slices[i].split() for i in heads]
        lengths = np.array([len(w) for w in words])
        codes, names = pd.factorize(np.array([x for w in words for x in w], object))
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        piece = np.repeat(np.arange(len(heads)), lengths + 1)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = codes + 1
        index = FMIndex(text, len(names))
        first = ends - lengths - 1
        last = np.arange(len(text))
        last = last[inside & (last - first[piece] >= window - 1)]
        _, who, lo, hi = index.repeated(text, last, window)
        owner = low[heads][piece]
        smallest = least(owner[index.order], lo, hi)
        hit = last[who][smallest < owner[last[who]]]
        inner = hit - first[piece[hit]] - (window - 1)
        # Equal runs of the smallest document itself, at other places, have the same windows.
        twins = pd.DataFrame({"head": group, "at": np.arange(len(group))})[~gone]
        found = pd.DataFrame({"head": heads[piece[hit]], "offset": inner}).merge(twins, on="head")
        found = found.sort_values(["at", "offset"], ignore_index=True)
        x, offset = found["at"].to_numpy(), found["offset"].to_numpy()
        begins = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (offset[1:] != offset[:-1] + 1))[: len(x)])
        windows = np.diff(np.append(begins, len(x)))
        x, offset = x[begins], offset[begins]
        out.append(pd.DataFrame({"doc_id": ids[x], "row": rows[x], "start": start[x] + offset, "windows": windows}))
    return pd.concat(out, ignore_index=True)


def _sent(rows: DataFrame, window: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """The packed pieces of all texts, each for one of the shards.

    The flags of large groups are ``SLOTS`` bits, whatever the input; groups over a shard's size, or eight times the mean
    of a slot where that is more, are taken apart.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    flags = None
    if shards > 1:
        flags = np.packbits(hot_groups(rows, window, size, max(shard_bytes, 8 * size // SLOTS)))
        flags = zstandard.compress(flags.tobytes())

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=5)
        hot = None if flags is None else np.unpackbits(np.frombuffer(zstandard.decompress(flags), np.uint8)).astype(bool)
        for part in batches:
            for block in _blocks(part["doc_id"].tolist(), part["row"].tolist(), part["text"].tolist()):
                yield _send(block, shards, packer, window, hot)

    return rows.mapInPandas(send, _SENT), shards


def repeats(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, row, start, windows: runs of windows, by their first word, that also start in a document with a smaller id.

    ``row`` is the hash of the text, which tells rows apart that repeat an id.  Rows without id or text have none.
    """
    if not 3 <= window <= DEPTH:
        raise ValueError(f"a window has 3 to {DEPTH} words")
    rows = id_and_text(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    sent, _ = _sent(rows, window, shard_bytes)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        packed = group["pieces"].notna()
        known = group.loc[~packed, ["doc_id", "row", "start", "windows"]]
        blobs = group.loc[packed, "pieces"].tolist()
        return pd.concat([known, _shard(blobs, window)], ignore_index=True) if blobs else known

    return sent.groupBy("bucket").applyInPandas(search, "doc_id long, row long, start long, windows long")


def drop_words(text: str | None, runs: list | None, window: int) -> tuple[int, int, str]:
    """Words, removed words and the SHA-256 of the words that stay."""
    words = (text or "").encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs or []:
        gone[r["start"]] += 1
        gone[r["start"] + r["windows"] + window - 1] -= 1
    cover = np.cumsum(gone[:-1]) > 0
    kept = [w for w, g in zip(words, cover.tolist(), strict=True) if not g] if runs else words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def dedup(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: without the words of windows that a smaller document has.

    Null text has no words.  Rows without an id neither lose words nor take any from others; rows that share an id
    take none from each other.  All windows are those of the input.
    """
    runs = written(repeats(docs, window, shard_bytes), "repeats").groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.collect_list(F.struct("start", "windows")).alias("runs"))
    rows = id_and_text(docs).withColumn("_t", F.xxhash64("text"))
    both = rows.join(runs, (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_row")), "left").select("doc_id", "text", "runs")
    kind = both.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = [drop_words(t, r, window) for t, r in zip(part["text"].to_pylist(), part["runs"].to_pylist(), strict=True)]
            made = [pa.array([g[k] for g in got], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *made], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return both.mapInArrow(each, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
