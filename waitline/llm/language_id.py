"""Language of texts, words labelled by a linear-chain conditional random field.

Features of a word are its byte n-grams between two boundary marks, so that those with a mark are its affixes, and its
entry in a lexicon of frequent words; they are hashed into one table of weights.  Transitions between languages are
learned from code-switched sequences, dealt from segments of the labelled documents.  Forward-backward gives every word
of a text its distribution; their mean decides on the text.

Fitted on at most ``SAMPLE`` documents of each language, whole, in hash order; every row is predicted, whole.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline.llm.common import id_and_text, map_texts

#: Documents of a language for the fit, sizes of n-grams, bits of the weight table, words of the lexicon.
SAMPLE, GRAMS, BITS, LEXICON = 200, (2, 3, 4, 5), 17, 2000
#: Words of a training sequence and of a block in prediction.
SEQUENCE, BLOCK = 64, 64

_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # 2**BITS x languages
    move: np.ndarray  # languages x languages, row to column, log
    lexicon: np.ndarray  # sorted hashes


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if no character is a letter."""
    found = _LETTERS.findall((text or "").lower())
    return found if any(w.isalpha() or any(map(str.isalpha, w)) for w in found) else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)


def features(names: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct words: pairs of the word's index and the place of a feature in the weight table."""
    coded = [b"^" + w.encode() + b"$" for w in names]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    word = np.repeat(np.arange(len(coded)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    who, what, h = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(data) - n + 1] * np.uint64(257) + data[n - 1:] + np.uint64(1)
        if n in GRAMS:
            fits = np.flatnonzero(left[: len(h)] >= n)
            who.append(word[fits])
            what.append(_mix(h[fits] * np.uint64(8) + np.uint64(n)))
    whole = word_hashes(names)
    known = np.flatnonzero(np.isin(whole, lexicon))
    return np.concatenate([*who, known]), np.concatenate([*what, _mix(whole[known])]).astype(np.int64)


def word_hashes(names: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(names, object), categorize=False) if names else np.zeros(0, np.uint64)


def emissions(names: list[str], model: Model) -> np.ndarray:
    """Log weight of each language for each word."""
    who, what = features(names, model.lexicon)
    held = model.weights[what]
    return np.stack([np.bincount(who, held[:, k], len(names)) for k in range(held.shape[1])], axis=1)


def _positive(score: np.ndarray) -> np.ndarray:
    return np.exp(score - score.max(axis=1, keepdims=True))


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = 40, rate: float = 0.1, shrink: float = 1e-4) -> Model | None:
    """The model of the labelled documents ``docs`` (doc_id, text, lang), or None without any."""
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", F.xxhash64("text")))
    ids = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text")
    rows = ids.withColumn("_n", turn).where(F.col("_n") <= sample).orderBy("lang", "_n").collect()  # at most `sample` a language
    parts = [(r.lang, words(r.text)) for r in rows]
    languages = sorted({lang for lang, w in parts if w})
    if not languages:
        return None
    random, segments = np.random.default_rng(20), []
    for lang, w in parts:
        at = 0
        while at < len(w):
            n = int(random.integers(3, 41))
            segments.append((languages.index(lang), w[at:at + n]))
            at += n
    random.shuffle(segments)
    flat = [w for _, part in segments for w in part]
    label = np.repeat([k for k, _ in segments], [len(part) for _, part in segments])
    n = max(1, len(flat) // SEQUENCE)
    size = SEQUENCE if len(flat) >= SEQUENCE else len(flat)
    code, names = pd.factorize(np.array(flat[: n * size], object))
    label = label[: n * size].reshape(n, size)
    names, code = list(names), code.reshape(n, size)
    often = np.argsort(-np.bincount(code.ravel(), minlength=len(names)), kind="stable")[:LEXICON]
    lexicon = np.sort(word_hashes([names[i] for i in often]))
    who, what = features(names, lexicon)
    k, table = len(languages), 1 << BITS
    p = np.zeros(table * k + k * k)
    m, v = np.zeros_like(p), np.zeros_like(p)
    told = np.zeros((len(names), k))
    np.add.at(told, (code.ravel(), label.ravel()), 1)
    moved = np.zeros((k, k))
    np.add.at(moved, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        weights, move = p[: table * k].reshape(table, k), p[table * k:].reshape(k, k)
        held = weights[what]
        score = np.stack([np.bincount(who, held[:, c], len(names)) for c in range(k)], axis=1)
        post, pairs = forward_backward(_positive(score)[code], np.exp(move - move.max()))
        expected = np.stack([np.bincount(code.ravel(), post[..., c].ravel(), len(names)) for c in range(k)], axis=1)
        diff = (expected - told) / code.size
        g = np.concatenate([
            np.stack([np.bincount(what, diff[who, c], table) for c in range(k)], axis=1).ravel(), ((pairs - moved) / code.size).ravel()])
        g += shrink * p / code.size
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(languages, p[: table * k].reshape(table, k).astype(np.float32), p[table * k:].reshape(k, k), lexicon)


def forward_backward(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequence, word, language) and expected transitions of sequences of one length."""
    n, size, k = e.shape
    ahead, back = np.empty_like(e), np.ones_like(e)
    now = np.full((n, k), 1.0 / k)
    for t in range(size):
        now = (now @ move) * e[:, t]
        now /= now.sum(axis=1, keepdims=True)
        ahead[:, t] = now
    pairs, now = np.zeros((k, k)), np.ones((n, k))
    for t in range(size - 1, 0, -1):
        seen = e[:, t] * now
        joint = ahead[:, t - 1].T @ (seen / ((ahead[:, t - 1] @ move) * seen).sum(axis=1, keepdims=True))
        pairs += joint * move
        now = seen @ move.T
        now /= now.sum(axis=1, keepdims=True)
        back[:, t - 1] = now
    post = ahead * back
    return post / post.sum(axis=2, keepdims=True), pairs


def text_shares(code: np.ndarray, lengths: np.ndarray, e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Mean posterior of each language over the words of each text."""
    return text_posteriors(code, lengths, e, move)[0]


def text_posteriors(code: np.ndarray, lengths: np.ndarray, e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean posterior of each language over the words of each text, and the likeliest language of every word.

    Of languages that are equal to nine decimals the first one labels the word.

    Texts are cut into blocks.  The product of a block's steps is a small matrix; along these matrices the state at
    every block's edge is exact, so that all blocks then go forward and backward together.
    """
    k, docs = e.shape[1], len(lengths)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    owner = np.repeat(np.arange(docs), blocks)
    begin = np.concatenate([[0], np.cumsum(lengths)])[owner] + (np.arange(total) - first[owner]) * BLOCK
    size = np.minimum(BLOCK, np.concatenate([[0], np.cumsum(lengths)])[owner + 1] - begin)
    at = begin[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < size[:, None]
    seen = np.where(real[..., None], e[code[np.minimum(at, max(len(code) - 1, 0))]], 1.0)
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(BLOCK):
        live = real[:, t]
        step = (product[live].reshape(-1, k) @ move).reshape(-1, k, k) * seen[live, t][:, None]
        product[live] = step / step.max(axis=(1, 2), keepdims=True)
    start, end = np.full((total, k), 1.0 / k), np.ones((total, k))
    for j in range(1, int(blocks.max(initial=0))):
        b = first[:-1][blocks > j] + j
        now = np.einsum("nk,nkl->nl", start[b - 1], product[b - 1])
        start[b] = now / now.sum(axis=1, keepdims=True)
        b = first[1:][blocks > j] - 1 - j
        now = np.einsum("nkl,nl->nk", product[b + 1], end[b + 1])
        end[b] = now / now.sum(axis=1, keepdims=True)
    ahead = np.empty((BLOCK, total, k))
    now = start
    for t in range(BLOCK):
        new = (now @ move) * seen[:, t]
        new /= new.sum(axis=1, keepdims=True)
        now = np.where(real[:, t, None], new, now)
        ahead[t] = now
    sums, now, label = np.zeros((total, k)), end, np.zeros(len(code), np.int64)
    for t in range(BLOCK - 1, -1, -1):
        post = ahead[t] * now
        post = post / post.sum(axis=1, keepdims=True)
        sums += np.where(real[:, t, None], post, 0.0)
        live = real[:, t]
        label[at[live, t]] = post[live].round(9).argmax(axis=1)
        new = (seen[:, t] * now) @ move.T
        now = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), now)
    shares = np.zeros((docs, k))
    np.add.at(shares, owner, sums)
    return shares / np.maximum(lengths, 1)[:, None], label


def language_runs(label: np.ndarray, lengths: np.ndarray, languages: list[str]) -> list[list[dict]]:
    """Of each text, its maximal runs of words of one language: lang, start and end (exclusive) as places of words."""
    edge = np.concatenate([[0], np.cumsum(lengths)])
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[edge[:-1][lengths > 0]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(label))
    owner = np.searchsorted(edge, begin, side="right") - 1
    out: list[list[dict]] = [[] for _ in lengths]
    for i, a, b in zip(owner.tolist(), begin.tolist(), end.tolist(), strict=True):
        out[i].append({"lang": languages[label[a]], "start": a - int(edge[i]), "end": b - int(edge[i])})
    return out


def _parts(found: list[list[str]], size: int = 300_000):
    """Runs of texts of about ``size`` words, which bounds the memory of a block."""
    at, held = 0, 0
    for i, w in enumerate(found):
        held += len(w)
        if held >= size or i + 1 == len(found):
            yield at, i + 1
            at, held = i + 1, 0


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words, runs of every row.

    ``runs`` labels the words: maximal runs of one language (lang, start, end), which cover the text's words in order.

    ``und`` with score 0 if the text is null or has no letter, or without a model; of equal shares the first language
    in alphabetical order wins, of a text as of a word.  Texts without words have no runs.  Very long texts are labelled
    whole, in blocks whose edges are exact.  Repeated rows get equal results; an empty table gives an empty result.
    """

    def each(texts: list) -> dict:
        found = list(map(words, texts))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        named, score, runs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        if model is not None and lengths.any():
            move = np.exp(model.move - model.move.max())
            for a, b in _parts(found):
                if not lengths[a:b].any():
                    continue
                code, names = pd.factorize(np.array([w for x in found[a:b] for w in x], object))
                shares, label = text_posteriors(code, lengths[a:b], _positive(emissions(list(names), model)), move)
                runs[a:b] = language_runs(label, lengths[a:b], model.languages)
                best = shares.round(9).argmax(axis=1)
                for i in np.flatnonzero(lengths[a:b]):
                    named[a + i], score[a + i] = model.languages[best[i]], min(1.0, round(float(shares[i, best[i]]), 6))
        return {"lang_pred": named, "score": score, "n_words": lengths, "runs": runs}

    return map_texts(docs, each, "lang_pred string, score double, n_words long, runs array<struct<lang: string, start: int, end: int>>")


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out: the checksum of the id as text leaves 0 by 5; rows without an id are held out."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return docs.withColumn("held_out", F.coalesce(rest == 0, F.lit(True)))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, runs of every row; learned from the rows that are not held out."""
    model = fit(held_out(docs.select("doc_id", "text", "lang")).where("not held_out"), sample)
    return held_out(predict(id_and_text(docs), model)).select("doc_id", "held_out", "lang_pred", "score", "n_words", "runs")
