"""Near duplicates by SimHash with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two bits have, of two halves, one that differs in at most one.  Each
distinct fingerprint is therefore indexed under 64 keys: either half with one of its 32 bits wiped.  An equality join
on these keys finds every such pair; a count of differing bits verifies it.  A key that more than ``CROWD`` distinct
fingerprints share is not paired up: its members are linked through keys of the whole fingerprint with two bits wiped,
of which at most four distinct fingerprints can share one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import checked_broadcast, map_texts
from waitline.llm.components import components
from waitline.session import written

#: Words of a shingle, bits that may differ, seed of the hash.
WORDS, BITS, SEED = 3, 2, 42
#: Distinct fingerprints under one key up to which they are paired up.
CROWD = 64
#: Shingles that are hashed at a time, which bounds the memory that a very long text takes.
BLOCK = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at space and 9 to 13, nothing else
    if not words:
        return 0
    n, votes = max(1, len(words) - WORDS + 1), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:at + BLOCK + WORDS - 1]
        grams = zip(*(part[i:] for i in range(WORDS))) if len(words) >= WORDS else [part]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), "<u8")
        for row in range(0, len(hashes), 1 << 13):
            bits = np.unpackbits(hashes[row:row + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint as a signed long) of every row."""
    return map_texts(
        docs, lambda texts: {"print": np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)}, "print long")


def variants(prints: DataFrame) -> DataFrame:
    """key, print: 64 keys for each distinct fingerprint, half and wiped bit in the key."""
    key = F.expr("""transform(sequence(0, 63), w -> shiftleft(cast(w as bigint), 32) |
        ((case when w < 32 then print & 4294967295 else shiftrightunsigned(print, 32) end) & ~shiftleft(1L, w % 32)))""")
    return prints.select(F.explode(key).alias("key"), "print")


def close_pairs(groups: DataFrame) -> DataFrame:
    """a, b: the pairs within each row's short list ``near`` that differ in at most two bits."""
    pairs = F.expr(f"""filter(flatten(transform(near, (x, i) -> transform(slice(near, i + 2, size(near)), y -> struct(x as a, y as b)))),
        p -> bit_count(p.a ^ p.b) <= {BITS})""")
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def links(prints: DataFrame) -> DataFrame:
    """a, b: pairs of distinct fingerprints within two bits; complete up to connection."""
    # A fingerprint becomes 64 rows, so that they are spread first; a set number of partitions is not merged again.
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = variants(prints.repartition(spread, "print"))
    crowded = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD), "crowded-keys")
    hot = checked_broadcast(crowded.select("key"))
    cool = index.join(hot, "key", "left_anti").groupBy("key").agg(F.collect_list("print").alias("near")).where("size(near) > 1")
    whole = F.expr("""flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(
        i * 64 + j as wiped, print & ~(shiftleft(1L, i) | shiftleft(1L, j)) as rest))))""")
    members = index.join(hot, "key", "left_semi").select("print").distinct()
    exact = members.select("print", F.explode(whole).alias("key")).groupBy("key").agg(
        F.collect_list("print").alias("near")).where("size(near) > 1")
    return close_pairs(cool).union(close_pairs(exact)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id within reach), n_links of every row.

    Rows with equal fingerprints are one node; texts without words share fingerprint 0 and link like others.  n_links
    counts the other fingerprints within two bits.  Rows without an id get the component of their fingerprint; a
    component whose rows all lack an id has a null component_id.  Repeated rows get equal results.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    pairs = written(links(nodes.select("print")), "fingerprint-links")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("print")).groupBy("print").agg(F.count(F.lit(1)).alias("n_links"))
    placed = nodes.join(components(pairs), F.col("print") == F.col("node"), "left").join(degree, "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(names, "root").select("print", "component_id", "n_links")
    return rows.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
