"""Importance resampling, embedding near-dedup and vector codes: against brute force and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from waitline.llm import pivot_codes, projection_passes, resampling

SF = "/root/testdata/sf0.001"
EXTRA = "rank long, score long, weight long, label_error long, node long, links long, digest string, _row long, steps string, pass int"
TAIL = (0, 0, 0, 0, 0, 0, "x", 0, "y", 0)


# --- resampling -----------------------------------------------------------------------------------

ODD = [(1, "alpha beta gamma delta " * 6), (2, None), (3, ""), (4, "\x00 .,;"), (5, "Lorem Ipsum Größe № 7 " * 20_000), (6, "one two " * 12),
       (6, "one two " * 12), (None, "one two " * 12), (None, None), (7, "ABC abc ÀÉ àé")]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, order):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, order, buckets, percent=10):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in features_of(text, order)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        found = features_of(text, order)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(f)) for f in found)
        out.append((i, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter()
    ranks = defaultdict(list)
    for n, r in enumerate(able[:len(able) * percent // 100], 1):
        ranks[r].append(n)
        drawn[r] += 1
    full = []
    for r in out:
        full.append((*r, ranks[r].pop(0) if ranks[r] else None))
    return full


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("order,percent", [(1, 10), (2, 60), (3, 100)])
def test_resample_equals_brute_force_on_odd_rows(spark, order, percent):
    docs = spark.createDataFrame([(*r, *TAIL) for r in ODD], f"doc_id long, text string, {EXTRA}").repartition(3)
    target = ["alpha beta", None, "àé Größe gamma"]
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), order, 50, percent=percent).collect()
    assert plain(got) == plain(brute_resample(ODD, target, order, 50, percent))


def test_resample_equals_brute_force_on_the_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_resample(rows, [r.text for r in items.collect()], 1, 10_000)
    assert plain(resampling.resample(docs, items).collect()) == plain(want)
    assert sum(r[5] is not None for r in want) > 10


def test_runs_do_not_cross_texts():
    owner, bucket, n_words = resampling.features([b"a b", None, b"c", b"", b"d e f"], 3, 1 << 32)
    want = [(i, zlib.crc32(f.encode())) for i, t in ((0, "a b"), (2, "c"), (4, "d e f")) for f in features_of(t, 3)]
    assert sorted(zip(owner.tolist(), bucket.tolist(), strict=True)) == sorted(want)
    assert n_words.tolist() == [2, 0, 1, 0, 3]


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert resampling.resample(some, none, percent=100).first()["rank"] == 1


def test_ties_and_repeats_each_take_a_rank(spark):
    rows = [(3, "a " * 20)] * 40 + [(None, "a " * 20)] * 20
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), percent=100)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 61))


# --- near duplicates ------------------------------------------------------------------------------


def planted(seed=5, width=32):
    """Random vectors of three labels with pairs, chains, a dense group, copies and scaled copies."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [(unit(rng.standard_normal(width)), int(rng.integers(3))) for _ in range(300)]
    for i in range(0, 60):
        v, label = rows[i]
        rows.append((unit(v + rng.standard_normal(width) * 0.02), label))
        rows.append((unit(v + rng.standard_normal(width) * 0.035), label))
    centre = unit(rng.standard_normal(width))
    rows += [(unit(centre + rng.standard_normal(width) * 0.015), 1) for _ in range(200)]
    rows += [rows[7]] * 5 + [(rows[8][0] * 3.5, rows[8][1])]
    rows = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * width, 1), (n + 3, [None] + [1.0] * (width - 1), 1), (n + 4, [float("nan")] * width, 1),
           (n + 5, [float("inf")] * width, 1), (n + 6, rows[0][1], None), (n + 7, rows[0][1], None), (n + 8, rows[0][1][:5], rows[0][2]),
           (None, rows[9][1], rows[9][2]), (10, rows[10][1], rows[10][2]), (n + 9, [-0.0, 1.0], 2), (n + 10, [0.0, 1.0], 2)]
    return rows + odd


def brute_links(rows, cosine=0.98):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    near = defaultdict(set)
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                if a == b or x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            least = min(ids) if ids else None
            out[k] = (rows[k][0], len(near[k]), least, rows[k][0] == least)
    return out


def vector_frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(*r, *TAIL) for r in rows], f"vec_id long, embedding {kind}, label int, {EXTRA}").repartition(3)


def test_near_duplicates_equal_brute_force_with_wide_windows(spark):
    rows = planted()
    got = projection_passes.near_duplicates(vector_frame(spark, rows), window=700, block=700)
    assert plain(got.drop("n_copies").collect()) == plain(brute_links(rows))


def test_near_duplicates_recall_with_narrow_windows_and_blocks(spark):
    rows = planted()
    got = {r.vec_id: r for r in projection_passes.near_duplicates(vector_frame(spark, rows), window=48, block=64, passes=6).collect()}
    want = {r[0]: r for r in brute_links(rows)}
    found, there = sum(r.n_links for r in got.values()), sum(r[1] for r in want.values())
    assert 0.9 * there <= found <= there
    assert all(got[i].n_links <= want[i][1] for i in want)
    assert sum(got[i].component_id == want[i][2] for i in want) >= 0.98 * len(want)


def test_a_pair_is_counted_in_one_pass_only(spark):
    rows = planted()[:200]
    few, many = (projection_passes.near_duplicates(vector_frame(spark, rows), passes=p, window=500, block=512).collect() for p in (1, 5))
    assert plain(few) == plain(many)


def test_blocks_link_across_their_border():
    x = np.tile([[1.0, 0.0]], (7, 1))
    links, root = projection_passes.block_links(x, np.zeros(7, int), np.arange(7)[:, None], np.ones(7, int), 0, 4, 3, 0.98)
    assert links.tolist() == [3, 4, 5, 6, 3, 2, 1] and root.tolist() == [0] * 7


def test_near_duplicates_of_an_empty_table(spark):
    assert projection_passes.near_duplicates(vector_frame(spark, [])).collect() == []
    only = projection_passes.near_duplicates(vector_frame(spark, [(1, None, 2), (None, None, None)])).collect()
    assert plain(only) == plain([(1, 0, 1, True, 0), (None, 0, None, True, 0)])


# --- vector codes ---------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    held = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(held[0][1])
    held = [r for r in held if len(r[1]) == width]
    w = width // parts
    cut = [[r[1][m * w:(m + 1) * w] for m in range(parts)] for r in held]
    books = [[cut[k][m] for k in range(min(entries, len(cut)))] for m in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for m in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[m], books[m])[1]].append(c[m])
            books[m] = [[sum(col) // len(mine[k]) for col in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[m])]
    last = [[near(c[m], books[m]) for m in range(parts)] for c in cut]
    by_label = Counter()
    for r, found in zip(held, last, strict=True):
        by_label[r[2]] += sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], r[2], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[r[2]], sha) for r, f in zip(held, last, strict=True)]


def test_codes_equal_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 16) / 4], None if i % 3 == 0 else i % 2) for i in range(120)]  # coarse: many ties
    rows += [(5, rows[5][1], 0), (None, rows[6][1], 1), (200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 1), (203, [], 1),
             (204, [0.5] * 24, 1), (205, [0.5] * 15, 1)]
    got = pivot_codes.encode(vector_frame(spark, rows)).collect()
    want = brute_codes([r for r in rows if r[0] not in (204, 205)])
    assert plain(got) == plain(want)


def test_codes_of_few_and_no_rows(spark):
    rows = [(i, [float(i)] * 8, 1) for i in range(3)]
    assert plain(pivot_codes.encode(vector_frame(spark, rows)).collect()) == plain(brute_codes(rows))
    assert pivot_codes.encode(vector_frame(spark, [])).collect() == []
    assert pivot_codes.encode(vector_frame(spark, [(1, None, 1)])).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_nearest_is_exact_and_prunes(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4096, 4096, (500, 8)) if seed < 3 else rng.integers(-3, 4, (500, 8))
    entries, pivots = x[:16], x[[0, 3, 5, 9]]
    at, best, evaluated = pivot_codes.nearest(x, pivot_codes.distances(x, pivots).astype(np.float32), entries, pivots)
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (at == d.argmin(axis=1)).all()
    assert evaluated < d.size
