"""License scans: MinHash bands of text windows retrieve templates, exact shingle containment verifies.

A template is cut into pieces of at most PIECE words, half overlapping; a window of a text is as long
as the piece and may run over the ends of the text, for a notice may be cut there. Both have BANDS bands of
ROWS MinHash values of their word shingles. A window of similarity 0.67 to a piece, as left by a match of
containment 0.8, is retrieved with a probability of at least 1 - (1 - 0.67**ROWS)**BANDS > 0.9999, and a
long template has several pieces. Around each retrieved place, the stretch of text that holds most of the
template's shingles is looked for; it may be longer than the template by a quarter, for words may have been
inserted. It is a match if it holds CONTAINED of them and the phrases that tell the license from its relatives. Of
matches that overlap the one with most shingles stays. Windows that share hardly any shingle with the
templates, by a table lookup for each shingle, are passed over before any MinHash is computed; none that
could match is among them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import mix, slices, small_batches

PIECE = 16
BANDS, ROWS = 16, 2
CONTAINED = 0.8
#: Words, as a share of the template's and at least so many, by which a match may be longer than the template.
STRETCH, LEAST_STRETCH = 0.25, 2

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
_GNU = ("This program is free software{}: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the "
        "Free Software Foundation, either version {} of the License, or (at your option) any later version.")

#: Notices and texts of common licenses.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("", "", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format("", "", "2")],
    "LGPL-3.0": [_GNU.format("", "Lesser ", "3")],
    "LGPL-2.1": [_GNU.format("", "Lesser ", "2.1").replace("This program", "This library")],
    "AGPL-3.0": [_GNU.format("", "Affero ", "3")],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."],
}

#: Phrases of family and version that a match of the license must have, as far as its template has them.
PHRASES = {
    "MIT": ["mit license"],
    "Apache-2.0": ["apache license", "version 2 0"],
    "GPL-3.0": ["gnu general public license", "version 3"],
    "GPL-2.0": ["gnu general public license", "version 2 of", "version 2"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3"],
    "LGPL-2.1": ["gnu lesser general public license", "version 2 1"],
    "AGPL-3.0": ["gnu affero general public license", "version 3"],
    "CC-BY-NC-4.0": ["by nc 4 0", "attribution noncommercial 4 0"],
    "CC-BY-SA-4.0": ["attribution sharealike 4 0"],
    "CC-BY-ND-4.0": ["attribution noderivatives 4 0"],
    "CC-BY-NC-SA-4.0": ["noncommercial sharealike 4 0"],
    "CC-BY-NC-ND-4.0": ["noncommercial noderivatives 4 0"],
    "CC-BY-4.0": ["attribution 4 0"],
    "BSD-3-Clause": ["neither the name"],
    "MPL-2.0": ["mozilla public license", "2 0"],
    "EPL-2.0": ["eclipse public license 2 0"],
}


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (ASCII letters and digits, other characters beyond ASCII; case folded) and row offsets."""
    import xxhash

    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\x00-/:-`{-\x7F]+", " ")
    words = pc.ascii_split_whitespace(plain)
    ends = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    keep = codes != empty if empty >= 0 else np.ones(len(codes), bool)
    seen = np.concatenate([[0], np.cumsum(keep)])
    return table[codes[keep]], seen[ends - ends[0]]


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    out = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)])
    return out


def _bands(windows: np.ndarray) -> np.ndarray:
    """Band keys of each row of shingle hashes."""
    low = np.empty((len(windows), BANDS * ROWS), np.uint64)
    for i in range(BANDS * ROWS):
        low[:, i] = mix(windows ^ np.uint64((i + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)).min(axis=1)
    keys = np.zeros((len(windows), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + low[:, r::ROWS])
    return keys ^ np.arange(BANDS, dtype=np.uint64)


def best_stretch(kinds: list[int], at: list[int], limit: int) -> tuple[int, int, int]:
    """(distinct shingles, first, last place) of the stretch of up to `limit` places with most kinds; of those the shortest, then first."""
    best, left, seen = (0, 0, 0, 0), 0, {}
    for right, (kind, place) in enumerate(zip(kinds, at)):
        seen[kind] = seen.get(kind, 0) + 1
        while place - at[left] >= limit or seen[kinds[left]] > 1:
            seen[kinds[left]] -= 1
            if not seen[kinds[left]]:
                del seen[kinds[left]]
            left += 1
        best = max(best, (len(seen), at[left] - place, -at[left], -place))
    return best[0], -best[2], -best[3]


class Scanner:
    """Templates made ready: shingles, phrases, pieces and their bands."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, list[str]] = PHRASES):
        self.names, self.size, self.width, self.own, self.must = [], [], [], [], []
        self.pieces: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = {}
        for name, texts in templates.items():
            keys = [_hashes(pa.array([p]))[0].tolist() for p in phrases.get(name, [])]
            for text in texts:
                words, _ = _hashes(pa.array([text]))
                n, k = len(words), 2 if len(words) <= 8 else 3
                if n < k:
                    raise ValueError(f"a template of {name} is too short")
                t = len(self.names)
                grams = _shingles(words, k)
                self.names.append(name)
                self.size.append(n)
                self.width.append(k)
                self.own.append(np.unique(grams))
                self.must.append([p for p in keys if self._has(words.tolist(), p)])
                m = min(n, PIECE)
                for at in sorted({*range(0, n - m, PIECE // 2), n - m}):
                    self.pieces.setdefault((m, k), []).append((t, at, _bands(grams[None, at : at + m - k + 1])[0]))
        self.table = {k: np.zeros(1 << 16, bool) for k in (2, 3)}
        for k, own in zip(self.width, self.own):
            self.table[k][(own & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _has(words: list[int], phrase: list[int]) -> bool:
        return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))

    def _limit(self, t: int) -> int:
        return self.size[t] + max(LEAST_STRETCH, int(self.size[t] * STRETCH))

    def _matches(self, words: np.ndarray, grams: np.ndarray, t: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """(distinct shingles, first word, end) of the matches of a template among the words low .. high - 1."""
        own, k = self.own[t], self.width[t]
        part = grams[low : max(low, high - k + 1)]
        kind = np.minimum(np.searchsorted(own, part), len(own) - 1)
        at = np.flatnonzero(own[kind] == part)
        kinds, places = kind[at].tolist(), (low + at).tolist()
        todo = [(0, len(kinds))]
        while todo:
            i, j = todo.pop()
            n, first, last = best_stretch(kinds[i:j], places[i:j], self._limit(t) - k + 1)
            if n < CONTAINED * len(own):
                continue
            if all(self._has(words[max(low, first - 1) : last + k + 1].tolist(), p) for p in self.must[t]):
                yield n, first, last + k
            # what lies before and after may be matches as well
            todo += [(i, bisect_left(places, first - k + 1, i, j)), (bisect_left(places, last + 1, i, j), j)]

    def scan(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first word in the row, words, containment) of the matches that no better one overlaps."""
        # words that occur nowhere, between the rows and around them: windows may run over the ends of a text
        size = np.diff(ends)
        starts = ends[:-1] + PIECE * np.arange(1, len(ends))
        padded = mix(np.arange(int(ends[-1]) + PIECE * len(ends), dtype=np.uint64) + np.uint64(0xFACADE))
        padded[np.repeat(starts - ends[:-1], size) + np.arange(int(ends[-1]))] = words
        grams = {k: _shingles(padded, k) for k in (2, 3)}
        found: dict[tuple[int, int], set[int]] = {}
        for (m, k), pieces in self.pieces.items():
            q = m - k + 1
            hit = self.table[k][(grams[k] & np.uint64(0xFFFF)).astype(np.int64)]
            total = np.concatenate([[0], np.cumsum(hit)])
            if len(hit) < q:
                continue
            at = np.flatnonzero(total[q:] - total[:-q] >= (q + 1) // 2)
            for i in range(0, len(at), 50_000):
                part = at[i : i + 50_000]
                keys = _bands(grams[k][part[:, None] + np.arange(q)])
                for t, offset, own in pieces:
                    for s in part[(keys == own).any(axis=1)].tolist():
                        row = max(0, int(np.searchsorted(starts, s + m, side="right")) - 1)
                        found.setdefault((row, t), set()).add(s - offset)
        matches: dict[int, set[tuple[int, int, int, int]]] = {}
        for (row, t), places in found.items():
            low, high, slack = int(starts[row]), int(starts[row] + size[row]), self._limit(t)
            run: list[int] = []
            for s in [*sorted(places), 1 << 60]:
                if run and s > run[-1] + slack:
                    for n, first, end in self._matches(padded, grams[self.width[t]], t, max(low, run[0] - slack), min(high, run[-1] + 2 * slack)):
                        matches.setdefault(row, set()).add((-n, t, first, end))
                    run = []
                run.append(s)
        out = []
        for row, own in matches.items():
            taken: list[tuple[int, int]] = []
            for n, t, first, end in sorted(own):
                if all(end <= a or first >= b for a, b in taken):
                    taken.append((first, end))
                    out.append((row, t, first - int(starts[row]), end - first, -n / len(self.own[t])))
        return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, matches) of every row: an array of (license, start, words, containment) by place in the text.

    Words count from 0. Null and wordless texts have no matches; repeated rows come back each. Of matches that
    overlap, the one with most shingles is given, of equal ones that of the earlier template, then the first. Texts are
    scanned whole, whatever their length. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in slices(batches, "text"):
            words, ends = _hashes(b.column("text"))
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for row, t, start, size, share in scanner.scan(words, ends):
                out[row].append({"license": scanner.names[t], "start": start, "words": size, "containment": share})
            for found in out:
                found.sort(key=lambda m: (m["start"], m["license"]))
            kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], names=["id", "matches"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, matches array<struct<license: string, start: bigint, words: bigint, containment: double>>")
