"""Secrets in texts: three plain patterns, and high entropy in a sliding window over candidate strings.

A candidate is a maximal run of the characters keys are written in.  Within it, the window slides over the whole and over
the runs of each narrower character class, also inside a wider one or behind a prefix; the class sets the window, and how
many bits a character must carry there.  Counts of the window's characters are kept up to date as it slides.  Windows that
pass are merged, whatever their class.  Known harmless forms are suppressed, as candidates and as runs.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

from pyspark.sql import DataFrame

from waitline.llm.common import map_texts

#: Kinds in their order within a position.
KINDS = ("assign", "access", "hex", "entropy")
#: Class of characters: window, least bits for each character in it.
CLASSES = {"hex": (24, 3.0), "base36": (24, 3.7), "base64": (24, 4.0)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Runs by class, each of one case; _ARM is a part between the joints of a candidate, 0x in front of hex left out.
_RUNS = (("hex", re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}")), ("base36", re.compile(r"[0-9a-z]{24,}|[0-9A-Z]{24,}")))
_ARM, _PREFIX = re.compile(r"[A-Za-z0-9+]{24,}"), re.compile(r"0[xX](?=[0-9a-fA-F]{24})")
_HEX_ONLY, _BASE36 = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[0-9a-z]+|[0-9A-Z]+")
#: Harmless forms: letters only, digits only, an id in 8-4-4-4-12 form, words joined by -, _ or /, a file path.
ALLOWED = tuple(re.compile(p) for p in (
    r"[A-Za-z]+", r"[0-9]+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"([A-Za-z]+[-_/=]+)+[A-Za-z]*[0-9]{0,4}",
    r"(/?[A-Za-z0-9_-]{1,15}/)+[A-Za-z0-9_-]{0,15}"))
#: Digests of nothing, and sequences, that documentation shows.
HARMLESS = frozenset([
    hashlib.md5(b"").hexdigest(), hashlib.sha1(b"").hexdigest(), hashlib.sha256(b"").hexdigest(),
    "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])

_GAIN = [0.0] + [c * log2(c) for c in range(1, 65)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns: leftmost matches of each kind, short ones dropped after matching."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def allowed(candidate: str) -> bool:
    return candidate in HARMLESS or any(p.fullmatch(candidate) for p in ALLOWED)


def character_class(candidate: str) -> str:
    return "hex" if _HEX_ONLY.fullmatch(candidate) else "base36" if _BASE36.fullmatch(candidate) else "base64"


def dense_windows(candidate: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged windows whose Shannon entropy reaches ``bits``; a step changes two counts."""
    counts: dict[str, int] = {}
    gain, least, out = 0.0, log2(window) * window - bits * window, []
    for i, c in enumerate(candidate):
        k = counts.get(c, 0)
        gain += _GAIN[k + 1] - _GAIN[k]
        counts[c] = k + 1
        if i >= window:
            gone = candidate[i - window]
            k = counts[gone]
            gain += _GAIN[k - 1] - _GAIN[k]
            counts[gone] = k - 1
        if i >= window - 1 and gain <= least + 1e-9:  # H = log2 W - gain / W
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def runs(candidate: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the candidate, of its arms between = _ - /, and of the hex and base36 runs in it."""
    found = {(0, len(candidate), character_class(candidate))}
    for m in _ARM.finditer(candidate):
        start = m.start() + (2 if _PREFIX.match(m[0]) else 0)
        if m.end() - start >= 24:
            found.add((start, m.end(), character_class(candidate[start:m.end()])))
    for kind, pattern in _RUNS:
        for m in pattern.finditer(candidate):
            start = m.start() + (2 if m[0][:2] in ("0x", "0X") else 0)
            found.add((start, m.end(), kind if kind == "base36" else character_class(m[0])))
    return sorted(found)


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _CANDIDATE.finditer(text):
        if allowed(m[0]):
            continue
        dense = []
        for start, end, kind in runs(m[0]):
            part = m[0][start:end]
            if not allowed(part):
                dense += [(m.start() + start + a, m.start() + start + b) for a, b in dense_windows(part, *CLASSES[kind])]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(dense):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out += [(a, b, "entropy") for a, b in merged]
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_text(text: str | None) -> tuple:
    base = base_spans(text or "")
    every = sorted(base + entropy_spans(text or ""), key=lambda s: (s[0], KINDS.index(s[2])))
    kinds = [s[2] for s in every]
    return (*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans of every row.

    Offsets count code points, ends are exclusive.  Null text counts as empty: no spans.  Repeated rows get equal results.
    """

    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans"]

    def each(texts: list) -> dict:
        return dict(zip(names, zip(*map(scan_text, texts), strict=True), strict=True)) if texts else dict.fromkeys(names, [])

    return map_texts(
        docs, each, "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
