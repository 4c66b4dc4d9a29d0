"""Severity grades by a cumulative-link ordinal regression over sparse word features.

One weight vector serves all ordered thresholds: P(grade >= k) = s(w.x - t_k).  The labels only say toxic or not, so
that grades 1 to 3 of toxic documents are weak labels: thirds by how often they use what is tied to toxicity.
Features are words and the beginnings of longer words, which catch compounds; a chi-square test on documents chooses them.  The model is fitted on at most ``SAMPLE`` labelled rows, taken
in hash order; every row is scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log1p
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import id_and_text, map_texts
from waitline.session import written

#: Letters of a word's beginnings that are features beside the word.
PREFIXES = (4, 5, 6, 7)
#: Labelled rows for the fit, words and beginnings kept as features, least documents of a word, least chi-square.
SAMPLE, FEATURES, LEAST_DOCS, LEAST_CHI2 = 20_000, 4096, 5, 25.0
#: Grades above 0; a document goes when P(grade >= 1) reaches this.
GRADES, REJECT = 3, 0.5

_WORD = re.compile(r"[^\W_]+")


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: list[float]  # ascending


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def traits(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings marked by a dash."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


class Counts:
    """Counts of the chosen features in a text; what a word holds of them is remembered, for some words at a time."""

    def __init__(self, place: dict[str, int]):
        self.place, self.seen = place, {}

    def __call__(self, found: list[str]) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in Counter(found).items():
            held = self.seen.get(word)
            if held is None:
                if len(self.seen) >= 200_000:
                    self.seen.clear()
                held = self.seen[word] = tuple(self.place[t] for t in traits(word) if t in self.place)
            for k in held:
                out[k] = out.get(k, 0) + n
        return out


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, text of labelled documents; a document counts as toxic if any of its labels says so."""
    said = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = said.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    return id_and_text(docs).where("text is not null").join(F.broadcast(taken), "doc_id")  # at most `rows` rows


def choose(marked: DataFrame, n: list[int]) -> tuple[list[str], list[str]]:
    """Words whose presence depends on the label, and those of them that speak for toxicity."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n, t = Counter(), Counter()
            for toxic, text in zip(rows["toxic"], rows["text"], strict=True):
                found = {t for w in set(words(text)) for t in traits(w)}
                n.update(found)
                if toxic > 0:
                    t.update(found)
            yield pd.DataFrame({"word": list(n), "n": list(n.values()), "t": [t[w] for w in n]}).astype({"n": "int64", "t": "int64"})

    held = marked.select("toxic", "text").mapInPandas(distinct, "word string, n long, t long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= LEAST_DOCS)
    total, bad = float(sum(n)), float(n[1])
    a, b = F.col("t").cast("double"), (F.col("n") - F.col("t")).cast("double")
    c, d = F.lit(bad) - a, F.lit(total - bad) - b
    chi2 = F.lit(total) * F.pow(a * d - b * c, F.lit(2.0)) / ((a + b) * (c + d) * F.lit(bad) * F.lit(total - bad))
    best = held.where((c + d) > 0).select("word", chi2.alias("chi2"), (a * d > b * c).alias("bad")).where(
        F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "word").limit(FEATURES).collect()
    return [r.word for r in best], [r.word for r in best if r.bad]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model | None:
    """The model, or None if the labels don't hold both kinds or no word depends on them."""
    marked = written(sample(docs, labels, rows), "labelled-texts")
    held = {r[0]: r[1] for r in marked.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    n = [held.get(0, 0), held.get(1, 0)]
    if not all(n):
        return None
    features, markers = choose(marked, n)
    if not features:
        return None
    place = {w: i for i, w in enumerate(features)}
    bad = {place[w] for w in markers}

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counts(place)
        for part in batches:
            hits = [dict(sorted(count(words(x)).items())) for x in part["text"]]
            yield pd.DataFrame({
                "doc_id": part["doc_id"], "toxic": (part["toxic"] > 0).astype("int32"),
                "use": [sum(np.log1p(v) for k, v in h.items() if k in bad) for h in hits],
                "at": [list(h) for h in hits], "value": [np.log1p(list(h.values())).tolist() for h in hits]})

    got = marked.mapInPandas(sparse, "doc_id long, toxic int, use double, at array<int>, value array<double>").toPandas()
    got = got.sort_values(["doc_id", "use"], ignore_index=True)
    toxic, use = got["toxic"].to_numpy(), got["use"].to_numpy()
    cuts = np.quantile(use[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + (use[:, None] > cuts).sum(axis=1), 0)
    row = np.repeat(np.arange(len(got)), [len(x) for x in got["at"]])
    at = np.concatenate([np.asarray(x, np.int64) for x in got["at"]])
    value = np.concatenate([np.asarray(x, np.float64) for x in got["value"]])
    w, t = ordinal(row, at, value, grade, len(features))
    return Model(dict(zip(features, w.round(9).tolist(), strict=True)), t.round(9).tolist())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def ordinal(row, at, value, grade, features: int, steps: int = 400, rate: float = 0.05, shrink: float = 2.0):
    """Weights and ascending thresholds by Adam on the penalised likelihood of the cumulative-link model.

    Gaps between thresholds are exponentials, which keeps them in order.
    """
    n = len(grade)
    share = np.clip([(grade >= k).mean() for k in range(1, GRADES + 1)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(1 / share - 1) + np.arange(GRADES) * 1e-3)
    p = np.concatenate([np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    one = np.eye(GRADES + 1)[grade]
    for step in range(1, steps + 1):
        w, gaps = p[:features], np.exp(p[features + 1:])
        t = p[features] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, w[at] * value, minlength=n)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(s[:, None] - t), np.zeros((n, 1))], axis=1)
        slope = above * (1 - above)
        here = np.maximum(((above[:, :-1] - above[:, 1:]) * one).sum(axis=1), 1e-12)
        by_s = -((slope[:, :-1] - slope[:, 1:]) * one).sum(axis=1) / here
        by_t = np.array([((one[:, k] - one[:, k - 1]) * slope[:, k] / here).sum() for k in range(1, GRADES + 1)])
        g = np.concatenate([
            np.bincount(at, by_s[row] * value, minlength=features) + shrink * w, [by_t.sum()],
            [by_t[k:].sum() * gaps[k - 1] for k in range(1, GRADES)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:features], p[features] + np.concatenate([[0], np.cumsum(np.exp(p[features + 1:]))])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (most thresholds passed), rejected of every row.

    Null and empty texts and texts without a feature get what the thresholds alone give.  Without a model all is 0 and
    nothing is rejected.  Repeated rows get equal results.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"), F.lit(False).alias("rejected"))
    place, w, t = {k: i for i, k in enumerate(model.weights)}, list(model.weights.values()), np.array(model.thresholds)

    counter: list[Counts] = []  # one for each task

    def each(texts: list) -> dict:
        if not counter:
            counter.append(Counts(place))
        count = counter[0]
        s = np.array([sum(w[k] * log1p(n) for k, n in sorted(count(words(x)).items())) for x in texts], np.float64)
        above = _sigmoid(s[:, None] - t)
        return {"severity": above.sum(axis=1).round(6), "p_toxic": above[:, 0].round(6),
                "grade": (above >= 0.5).sum(axis=1), "rejected": above[:, 0] >= REJECT}

    return map_texts(docs, each, "severity double, p_toxic double, grade int, rejected boolean")
