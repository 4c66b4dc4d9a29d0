"""A compressed full-text index over words: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Suffixes are sorted by their first ``DEPTH`` words only.  That is enough for patterns of up to as many words: the
interval of a pattern depends on nothing behind its end.  All searches of a call advance together, in numpy.
"""

from __future__ import annotations

import numpy as np

#: Words by which suffixes are sorted; patterns are at most as long.
DEPTH = 16


def suffixes(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions in the order of the ``depth`` words that start there, by doubling; behind the end lies nothing."""
    n = len(text)
    rank, order, h = text.astype(np.int64), np.argsort(text, kind="stable"), 1
    while h < depth:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        there = key[order]
        step = np.concatenate([[0], np.cumsum(there[1:] != there[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if n and step[-1] == n - 1:
            break
        h *= 2
    return order


class FMIndex:
    """``text`` holds small integers: 0 separates pieces, words are 1 to ``words``."""

    def __init__(self, text: np.ndarray, words: int):
        self.order = suffixes(text)
        last = text[self.order - 1]
        last[self.order == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words + 1))])
        self.levels = []
        row = last
        for shift in reversed(range(max(1, int(words).bit_length()))):
            bit = (row >> shift) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1]
            self.levels.append((shift, packed, before, int(len(bit) - bit.sum())))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.shift = self.first[:-1] - self._walk(np.arange(words + 1), np.zeros(words + 1, np.int64))

    def _walk(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Down the wavelet matrix: where the occurrences of ``word`` before ``at`` end on the lowest level."""
        for shift, packed, before, zeros in self.levels:
            cell, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = before[cell] + np.bitwise_count(packed[cell] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where((word >> shift) & 1, zeros + ones, at - ones)
        return at

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more word in front."""
        both = self._walk(np.concatenate([word, word]), np.concatenate([low, high])) + np.concatenate([self.shift[word]] * 2)
        return both[: len(word)], both[len(word):]

    def repeated(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the windows of ``text`` that end at ``ends``, up to ``length`` words.

        A window is followed while something else than itself matches; how far that was is its statistic.  Returns the
        statistics of all, and index, low and high of the windows that repeat in full.
        """
        word = text[ends]
        low, high = self.first[word], self.first[word + 1]
        matched, who = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for k in range(length):
            if k:
                low, high = self.extend(text[ends[who] - k], low, high)
            more = high - low > 1
            who, low, high = who[more], low[more], high[more]
            matched[who] = k + 1
        return matched, who, low, high


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of ``values`` over each interval; intervals are disjoint or equal."""
    if not len(low):
        return np.zeros(0, values.dtype)
    starts, place = np.unique(low, return_inverse=True)
    ends = np.zeros_like(starts)
    ends[place] = high
    cuts = np.stack([starts, ends], axis=1).ravel()
    return np.minimum.reduceat(np.append(values, values[-1:]), cuts)[::2][place]
