"""Find licence notices in texts: MinHash bands retrieve templates, containment verifies them.

A template is the set of its word shingles, and m long with those it repeats. Texts are cut into windows that overlap
so that any m shingles in a row lie in one whole: a window starts every max(1, m // 2) shingles
and is at most m + max(1, m // 2) long. A template of which a share of 0.8 stands in a text in
its place then has a Jaccard similarity of at least 0.8 / 1.7 = 0.47 with some window. Each of
``BANDS`` bands is one min-hash, so it is retrieved with a probability of 1 - 0.53 ** 32, all
but 2e-9. Every retrieved pair is verified: the share of the template's shingles in the window.

A window may hold the end of one notice and the start of the next. Where a shingle comes once more
than the template has it, a notice has begun anew, at the last place before which the template's
order runs backwards; the window is cut there, and its cuts are verified each. So is a part between two such
places that has enough by itself.

The templates are a parameter and few; Spark spreads the texts, and each is read alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.words import mix, shingles, word_hashes

CONTAINED = 80  # per cent
BANDS = 32
_SEEDS = mix(np.arange(201, 201 + BANDS, dtype=np.uint64))
_STEP = 1 << 14

_NO_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_GNU = (
    "you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)

#: Notices as their licences word them, short forms of them, and whole short licences.
TEMPLATES = {
    "AGPL-3.0/header": "This program is free software: " + _GNU.format("GNU Affero General Public License", "3"),
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at",
    "BSD/header": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    # Stands in the licences of two and of three conditions, which differ by too little to be told apart at 0.8.
    "BSD/text": f"{_TWO_CONDITIONS} {_NO_WARRANTY}",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0/header": "This program is free software; " + _GNU.format("GNU General Public License", "2"),
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": "This program is free software: " + _GNU.format("GNU General Public License", "3"),
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
    "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1/header": "This library is free software; " + _GNU.format("GNU Lesser General Public License", "2.1"),
    "MIT/line": "Released under the MIT License.",
    "MIT/header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/header": "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
    "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
    "binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the "
    "authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
    "use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
    "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
    "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
    "altered from any source distribution.",
}


class Template:
    """A template's distinct shingles in order of their hash, and the places of each in the template."""

    def __init__(self, name: str, words: np.ndarray):
        self.name = name
        tokens = shingles(words)
        self.held, which = np.unique(tokens, return_inverse=True)
        self.long = len(tokens)
        self.places: list[list[int]] = [[] for _ in self.held]
        for place, w in enumerate(which.tolist()):
            self.places[w].append(place)

    def cuts(self, which: np.ndarray, enough: float) -> list[tuple[int, int, float]]:
        """The notices in a row of this template's shingles that have enough: begin, end and share.

        Within each the order does not run backwards.
        """
        backwards, out = [], []
        for a, b in self._begun_anew(which, backwards):
            ends = [a, *(i for i in backwards if a < i < b), b]
            parts = [(x, y, self._share(which[x:y])) for x, y in zip(ends, ends[1:])]
            out += [part for part in parts if part[2] >= enough]
        return out

    def _share(self, which: np.ndarray) -> float:
        return len(np.unique(which)) / len(self.held)

    def _begun_anew(self, which: np.ndarray, backwards: list[int]) -> Iterator[tuple[int, int]]:
        rows = which.tolist()
        begun, back, last = 0, 0, -1
        seen: dict[int, int] = {}
        for i, w in enumerate(rows):
            # A shingle that the template has more than once stands at the next of its places.
            on = next((p for p in self.places[w] if p > last), None)
            if on is None:
                on, back = self.places[w][0], i
                backwards.append(i)
            last = on
            seen[w] = seen.get(w, 0) + 1
            if seen[w] > len(self.places[w]) and back > begun:
                yield begun, back
                begun, seen = back, {}
                for v in rows[back : i + 1]:
                    seen[v] = seen.get(v, 0) + 1
        yield begun, len(rows)


class Scanner:
    """Templates by their number of shingles, with the min-hashes of each."""

    def __init__(self, templates: Mapping[str, str]):
        self.classes: dict[int, list[Template]] = {}
        for name, words in zip(templates, word_hashes(templates.values(), punctuated=True), strict=True):
            template = Template(name, words)
            if template.long:
                self.classes.setdefault(template.long, []).append(template)
        self.least = {
            m: np.stack([mix(t.held[None, :] ^ _SEEDS[:, None]).min(axis=1) for t in some])
            for m, some in self.classes.items()
        }
        self.overlap = 2 * max(self.classes, default=0)

    def retrieved(self, tokens: np.ndarray) -> Iterator[tuple[Template, int, int]]:
        """Templates that share a band with a window, with the window's start and end."""
        for base in range(0, len(tokens), _STEP):
            hashed = mix(tokens[None, base : base + _STEP + self.overlap] ^ _SEEDS[:, None])
            n = hashed.shape[1]
            for m, some in self.classes.items():
                step = max(1, m // 2)
                blocks = -(-(m + step - 1) // step)
                least = np.minimum.reduceat(hashed, np.arange(0, n, step), axis=1)
                window = least
                for k in range(1, min(blocks, least.shape[1])):
                    window = np.minimum(window[:, : least.shape[1] - k], least[:, k:])
                for template, own in zip(some, self.least[m], strict=True):
                    for i in np.flatnonzero((window == own[:, None]).any(axis=0)):
                        low = base + int(i) * step
                        yield template, low, min(low + blocks * step, len(tokens))

    def scan(self, words: np.ndarray, contained: int = CONTAINED) -> list[tuple[str, int, int, float]]:
        """Verified notices in a text: template, first and end word, share of its shingles."""
        tokens = shingles(words)
        whole: dict[tuple[str, int], tuple[float, int]] = {}
        joint: dict[tuple[str, int], tuple[float, int]] = {}
        for template, low, high in self.retrieved(tokens):
            held = template.held
            which = np.minimum(np.searchsorted(held, tokens[low:high]), len(held) - 1)
            there = np.flatnonzero(held[which] == tokens[low:high])
            which = which[there]
            if 100 * len(np.unique(which)) < (contained - 1e-7) * len(held):
                continue
            enough = contained / 100 - 1e-9
            full = template.cuts(which, enough)
            # Where no notice has enough for itself, the window's parts of them together do.
            best = whole if full else joint
            for a, b, share in full or [(0, len(which), len(np.unique(which)) / len(held))]:
                first, end = int(there[a]) + low, min(int(there[b - 1]) + low + 5, len(words))
                key = template.name, first
                best[key] = max(best.get(key, (0.0, 0)), (share, end))
        found = _fullest(whole)
        return sorted(found + _beside(_fullest(joint), found))


def _fullest(best: Mapping[tuple[str, int], tuple[float, int]]) -> list[tuple[str, int, int, float]]:
    """Of notices of a template that overlap, which show one and the same, the fullest."""
    out: list[tuple[str, int, int, float]] = []
    for name, first in sorted(best):
        share, end = best[name, first]
        if out and out[-1][0] == name and first < out[-1][2]:
            if share > out[-1][3]:
                out[-1] = name, first, end, share
        else:
            out.append((name, first, end, share))
    return out


def _beside(
    some: list[tuple[str, int, int, float]], others: list[tuple[str, int, int, float]]
) -> list[tuple[str, int, int, float]]:
    """Those that overlap none of the others of their template; both are in order and overlap none of their own."""
    out, k = [], 0
    for row in some:
        while k < len(others) and (others[k][0], others[k][2]) <= (row[0], row[1]):
            k += 1
        if k == len(others) or others[k][0] != row[0] or others[k][1] >= row[2]:
            out.append(row)
    return out


def license_notices(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, contained: int = CONTAINED
) -> DataFrame:
    """One row per notice: doc_id, template, license, start, end, containment.

    ``start`` and ``end`` (exclusive) count words, which here end at any ASCII character that
    is no letter or digit; A-Z match a-z. A notice holds ``contained`` per cent of a template's
    shingles within one window; of notices of one template that overlap the fullest is given
    (ties: the first); notices that follow directly on each other are given each. ``license`` is the template's name up to a slash. Texts that are null,
    empty or without notices give no rows; repeated rows give theirs each. Templates without
    words are never found. Other columns are ignored.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(dict(templates))
    names = ["doc_id", "template", "start", "end", "containment"]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Scanner(scanner.value)
        for frame in frames:
            rows = []
            ids = frame["doc_id"].astype(object)
            for doc_id, words in zip(ids, word_hashes(frame["text"], punctuated=True), strict=True):
                rows += [(doc_id, name, first, end, share) for name, first, end, share in held.scan(words, contained)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        scan, "doc_id long, template string, start long, end long, containment double"
    )
    return found.select(
        "doc_id", "template", F.substring_index("template", "/", 1).alias("license"), "start", "end", "containment"
    )
