"""Licence texts in documents by the Dice coefficient over word bigrams.

Compared are windows of words anywhere in a text, over line ends and blank lines.  A window of a distinct bigrams can
only reach the threshold t against a template of b if t / (2 - t) <= a / b <= (2 - t) / t: the lower bound leaves out
templates of which a text has too few bigrams, mostly all of them, and the upper one ends a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from waitline.llm.common import map_texts

THRESHOLD = 0.9

#: Public notices, as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)

_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> list[str]:
    """Words in lower case, punctuation and white space left out."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    """The templates' bigrams and the sizes that can reach the threshold."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [(k, name, bigrams(normal(text))) for k, (name, text) in enumerate(templates)]
        self.owners: dict[tuple[str, str], list[int]] = {}
        for k, _, grams in self.templates:
            for pair in grams:
                self.owners.setdefault(pair, []).append(k)
        ratio = threshold / (2 - threshold)
        self.bounds = [(len(g) * ratio - 1e-9, len(g) / ratio + 1e-9) for _, _, g in self.templates]

    def best(self, grams: set) -> tuple[float, int, str] | None:
        """The highest coefficient at or above the threshold; the first template of equal ones.  Sizes out of bounds are not compared."""
        near = [(dice(grams, g), -k, name) for (k, name, g), (low, high) in zip(self.templates, self.bounds, strict=True) if low <= len(grams) <= high]
        top = max(near, default=None)
        return (top[0], -top[1], top[2]) if top and top[0] >= self.threshold else None

    def windows(self, pairs: list[tuple[str, str]], at: list[int], k: int) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first bigram, last bigram) of separate windows near template k, each the best around its place.

        ``at`` lists where the bigrams of the template lie.  The best window begins and ends with one of them and holds
        no more bigrams than the size bound lets it, so that only such windows are tried, from each beginning on.
        """
        grams, size, high = self.templates[k][2], len(self.templates[k][2]), self.bounds[k][1]
        least, best, free = self.threshold / (2 - self.threshold) * size, None, 0
        for i, first in enumerate(at):
            if first < free:
                continue
            if best and first > best[2]:
                yield best
                best = None
            seen, shared = set(), 0
            j, last = i, first - 1
            while j < len(at):
                for p in range(last + 1, at[j] + 1):
                    if pairs[p] not in seen:
                        seen.add(pairs[p])
                        shared += pairs[p] in grams
                last = at[j]
                if len(seen) > high:
                    break
                if shared >= least - 1e-9:
                    found = (2 * shared / (len(seen) + size), first, last)
                    if found[0] >= self.threshold and (best is None or found[0] > best[0]):
                        best = found
                    if shared == size:
                        break
                j += 1
                # A gap that alone is too long ends every window that would span it.
                if j < len(at) and at[j] - last > high and len(set(pairs[last:at[j]])) > high:
                    break
            if best and best[0] == 1.0:
                free = best[2] + 1
        if best:
            yield best

    def scan(self, text: str | None) -> list[tuple[int, int, float, int, str]]:
        """(first line, line after the last, coefficient, template, licence) of every place near a template.

        Words run on over line ends and blank lines, so that a notice is found however it is wrapped, inside a longer
        line, or next to another.  Templates without enough of their bigrams in the text are not looked at any more.
        """
        words, line = [], []
        for n, one in enumerate((text or "").split("\n")):
            new = normal(one)
            words += new
            line += [n] * len(new)
        pairs = list(zip(words, words[1:], strict=False))
        at, held = {}, {}
        for p, pair in enumerate(pairs):
            for k in self.owners.get(pair, ()):
                at.setdefault(k, []).append(p)
                held.setdefault(k, set()).add(pair)
        ratio, found = self.threshold / (2 - self.threshold), set()
        for k, own in held.items():
            if len(own) >= ratio * len(self.templates[k][2]) - 1e-9:
                for value, first, last in self.windows(pairs, at[k], k):
                    found.add((line[first], line[last + 1] + 1, value, k, self.templates[k][1]))
        return sorted(found)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, n_units, licences, units of every row.

    A unit is a window of words near a template, the best around its place.  ``licence`` and ``dice`` are those of the
    nearest unit (of equal ones that of the longer template, which may contain the other, then the first), null and 0 if none reaches the threshold; ``units`` lists
    licence:first line:line after the last.  A notice that repeats is a unit on each of its lines, and one unit within a
    line.  Null and empty texts have none; very long texts and lines are looked at whole; repeated rows get equal results; an empty table
    gives an empty result.
    """

    def each(texts: list) -> dict:
        matcher = Matcher(templates, threshold)
        every = list(map(matcher.scan, texts))
        tops = [max(found, key=lambda f: (f[2], len(matcher.templates[f[3]][2]), -f[3]), default=None) for found in every]
        return {
            "licence": [t[4] if t else None for t in tops], "dice": [round(t[2], 6) if t else 0.0 for t in tops],
            "n_units": list(map(len, every)), "licences": [sorted({f[4] for f in found}) for found in every],
            "units": [",".join(f"{f[4]}:{f[0]}:{f[1]}" for f in found) for found in every]}

    return map_texts(docs, each, "licence string, dice double, n_units long, licences array<string>, units string")
