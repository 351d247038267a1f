"""License notices by conditional compression.

Templates are in classes of like length.  Around each cue word lies a candidate block for each class: as many words to either side as
its longest template has (joined where they meet, cut into pieces of four times that, which overlap by as much as
the longest notice), so that a short notice is not lost in a long block.  Lines and comment marks at their ends do not matter.
A block is compressed alone and with each template of its class as a raw zstandard dictionary; templates are ranked by how much smaller
they make it, and all that make it smaller are held against its wording, none is left out by rank.  Confirmed is every
notice whose wording, in lower case and without stops, brackets and quotes at the ends of words, differs from the template (words of the template that are missing, words within the matched stretch that are extra) in a
tenth of the template's words at most, or in none if it has under ten, and in no name or version of a license.
Within a block that search is exact: of a template cut into one piece more than the differences allowed, a notice
holds one piece whole, and around each such piece words are aligned.

Lines with cue words outside these notices are reported too, unconfirmed, under the template that makes them smallest; if
that is by less than ``LEAST_REDUCTION``, under none.  Of an expression of several SPDX identifiers the first is confirmed.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.arrays import texts_of
from wayfare.llm.storage import bound_batches

# Names and wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: Identifiers of the SPDX license list.
SPDX = "Apache-2.0 MIT GPL-3.0-only GPL-3.0-or-later GPL-2.0-only GPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause Unlicense MPL-2.0 CC-BY-NC-4.0 CC-BY-4.0 CC-BY-SA-4.0 ISC"
TEMPLATES |= {f"SPDX {name}": f"SPDX-License-Identifier: {name}" for name in SPDX.split()}
#: A block that no template makes smaller by this share of its size is named after none.
LEAST_REDUCTION = 0.1
CUES = re.compile(rb"licen[sc]e|copyright|permission is|redistribut|warrant|spdx|creative commons|cc by|public domain", re.I)
#: Single words of cues: a text without any has none.
_HINT = re.compile(rb"licen[sc]e|copyright|permission|redistribut|warrant|spdx|commons|\bcc\b|domain", re.I)
#: Words that tell one license from another; so do numbers behind them or behind "version".
NAMES = {b"gnu", b"general", b"lesser", b"library", b"affero", b"mozilla", b"apache", b"mit", b"bsd", b"isc", b"mpl", b"gpl", b"lgpl", b"agpl", b"cc", b"by", b"by-nc", b"by-sa", b"by-nd", b"by-nc-sa", b"by-nc-nd", b"attribution", b"attribution-sharealike", b"attribution-noncommercial", b"attribution-noderivatives", b"attribution-noncommercial-sharealike", b"attribution-noncommercial-noderivatives", b"unlicense"}
#: Longest notices, in words, of the classes but the last.
CLASSES = (16, 48)
_NUMBERED = NAMES | {b"version", b"v", b"license"}
_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
_LINE = re.compile(rb"[^\n\r]+")
_MARK = re.compile(rb"(?:<!--|[#*/;%!>|'-]+|(?:dnl|REM)(?![^\x20\x09-\x0D]))")
_CLOSING = re.compile(rb"(?:-->|[#*/;%|-]+)")


def _fold(word: bytes) -> bytes:
    """A word as it is compared; of nothing but stops, the stops."""
    return word.lower().strip(b".,;:()\"'") or word


def _naming(words: list[bytes], i: int) -> bool:
    """Whether the word is part of a license's name or version."""
    word = words[i].lower().strip(b".,;:()\"'")
    if word == b"by":
        return i > 0 and words[i - 1].lower().strip(b".,;:()\"'") == b"cc"
    if word in (b"general", b"library"):
        return i > 0 and words[i - 1].lower() in (b"gnu", b"lesser", b"affero") or i + 1 < len(words) and words[i + 1].lower() == b"public"
    return word in NAMES or bool(i and re.search(rb"\d", word) and words[i - 1].lower().strip(b".,;:()\"'") in _NUMBERED)


class LicenseScanner:
    """``scan`` a text against named templates."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, tolerance: float = 0.1, level: int = 6):
        self.plain = zstandard.ZstdCompressor(level=level)
        self.names = list(templates)
        self.wanted = [[_fold(w) for w in _BYTES.findall(t.encode())] for t in templates.values()]
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(b" ".join(w), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for w in self.wanted]
        self.allowed = [int(tolerance * len(w)) for w in self.wanted]
        lengths = [len(w) + k + 1 for w, k in zip(self.wanted, self.allowed, strict=True)]
        inside = [[t for t, n in enumerate(lengths) if low < n <= high] for low, high in zip((0, *CLASSES), (*CLASSES, max(lengths)), strict=True)]
        self.classes = [(max(lengths[t] for t in some), some) for some in inside if some]
        self.pieces: dict[bytes, list[tuple[list[bytes], int, int]]] = defaultdict(list)
        for t, (want, k) in enumerate(zip(self.wanted, self.allowed, strict=True)):
            cuts = [len(want) * i // (k + 1) for i in range(k + 2)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                self.pieces[want[x]].append((want[x:y], t, x))

    @staticmethod
    def blocks(text: bytes, taken: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """Runs of lines with a cue outside the sorted byte ranges ``taken``, as byte ranges outside of them."""
        starts = [x[0] for x in taken]
        out: list[tuple[int, int]] = []
        for m in CUES.finditer(text):
            start = text.rfind(b"\n", 0, m.start()) + 1
            end = text.find(b"\n", m.end())
            end = len(text) if end < 0 else end
            at = bisect_right(starts, m.start())
            if at and taken[at - 1][1] > m.start():
                continue
            start = max(start, taken[at - 1][1]) if at else start
            end = max(min(end, starts[at]), m.end()) if at < len(starts) else end
            if out and start <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return out

    @staticmethod
    def tokens(text: bytes) -> list[tuple[bytes, int, int]]:
        """Words with their byte ranges, without the comment marks at the ends of lines."""
        out = []
        for line in _LINE.finditer(text):
            held = [(m.group(), line.start() + m.start(), line.start() + m.end()) for m in _BYTES.finditer(line.group())]
            first = 0
            while first < len(held) and (mark := _MARK.match(held[first][0])):
                word, start, end = held[first]
                if mark.end() < len(word):
                    held[first] = (word[mark.end() :], start + mark.end(), end)
                else:
                    first += 1
            last = len(held)
            while last > first and _CLOSING.fullmatch(held[last - 1][0]):
                last -= 1
            out += held[first:last]
        return out

    @staticmethod
    def candidates(words: list[bytes], reach: int) -> list[tuple[int, int]]:
        """Ranges of words within ``reach`` of cues, in pieces."""
        ends = np.cumsum([len(w) + 1 for w in words])
        out: list[tuple[int, int]] = []
        for m in CUES.finditer(b" ".join(words)):
            lo, hi = np.searchsorted(ends, [m.start(), m.end() - 1], side="right").tolist()
            lo, hi = max(lo - reach, 0), min(hi + 1 + reach, len(words))
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        step = 3 * reach
        return [(at, min(at + step + reach, hi)) for lo, hi in out for at in range(lo, max(hi - reach, lo + 1), step)]

    def rank(self, block: bytes, templates: list[int] | None = None) -> list[tuple[float, int]]:
        """(size reduction, template) from the greatest on."""
        alone = len(self.plain.compress(block))
        return sorted(((1 - len(self.given[t].compress(block)) / alone, t) for t in (range(len(self.given)) if templates is None else templates)), key=lambda x: (-x[0], x[1]))

    def differences(self, have: list[bytes], template: int) -> tuple[list[bytes], list[bytes]]:
        """Template words missing from the words of a block, and extra words within the matched stretch."""
        want = self.wanted[template]
        first = difflib.SequenceMatcher(None, have, want, autojunk=False)
        steps = [m for m in first.get_matching_blocks() if m.size]
        if not steps:
            return want, []
        missing, extra, at, inside = [], [], 0, steps[0].a
        for m in steps:
            missing += want[at : m.b]
            extra += have[inside : m.a]
            at, inside = m.b + m.size, m.a + m.size
        return missing + want[at:], extra

    def matches(self, words: list[bytes], templates: set[int] | None = None) -> list[tuple[int, int, int, list[bytes], list[bytes]]]:
        """first word, end, template, missing, extra of every notice of these templates (all if not given) in ``words``."""
        words = [_fold(w) for w in words]
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, word in enumerate(words):
            for piece, t, offset in self.pieces.get(word, ()):
                if (templates is None or t in templates) and words[p : p + len(piece)] == piece:
                    k, first = self.allowed[t], p - offset
                    lo, hi = max(0, first - k), min(len(words), first + len(self.wanted[t]) + k)
                    if near[t] and lo <= near[t][-1][1]:
                        lo, hi = min(lo, near[t][-1][0]), max(hi, near[t][-1][1])
                        near[t].pop()
                    near[t].append((lo, hi))
        return [m for t, ranges in near.items() for lo, hi in ranges for m in self._align(words, lo, hi, t)]

    def confirmed(self, words: list[bytes]) -> list[tuple[int, int, int, list[bytes], list[bytes]]]:
        """The notices in the candidate blocks of templates that make their block smaller; of overlapping ones, that of the longer template."""
        found, words = {}, [_fold(w) for w in words]
        for reach, templates in self.classes:
            for lo, hi in self.candidates(words, reach):
                winners = {t for reduction, t in self.rank(b" ".join(words[lo:hi]), templates) if reduction > 0}
                for first, end, t, missing, extra in self.matches(words[lo:hi], winners):
                    found[lo + first, lo + end, t] = (lo + first, lo + end, t, missing, extra)
        out: list[tuple[int, int, int, list[bytes], list[bytes]]] = []
        for m in sorted(found.values(), key=lambda m: (-len(self.wanted[m[2]]), len(m[3]) + len(m[4]), m[0], m[1])):
            if all(m[1] <= o[0] or o[1] <= m[0] for o in out):
                out.append(m)
        return sorted(out, key=lambda m: m[0])

    def _align(self, words: list[bytes], lo: int, hi: int, t: int) -> Iterator[tuple[int, int, int, list[bytes], list[bytes]]]:
        """Stretches of words[lo:hi] within the allowed differences of a template, from left to right."""
        want, k = self.wanted[t], self.allowed[t]
        number = {w: i for i, w in enumerate(dict.fromkeys(want))}
        wanted, steps = np.array([number[w] for w in want]), np.arange(len(want) + 1)
        while lo < hi:
            # table[j][i]: least differences of want[:i] to a stretch that ends after j words
            table, best = [steps], None
            for j in range(lo, hi):
                row = np.minimum(table[-1] + 1, steps)
                match = wanted == number.get(words[j], -1)
                row[1:] = np.where(match, np.minimum(row[1:], table[-1][:-1]), row[1:])
                row[0] = 0
                row = np.minimum.accumulate(row - steps) + steps
                table.append(row)
                if row[-1] <= k and (best is None or row[-1] < best[0]):
                    best = (row[-1], j + 1, best[2] if best else j)
                if best and j - best[2] > 2 * k:
                    break
            if best is None:
                return
            i, j, missing, extra, named = len(want), best[1] - lo, [], [], False
            while i:
                if j and want[i - 1] == words[lo + j - 1] and table[j][i] == table[j - 1][i - 1]:
                    i, j = i - 1, j - 1
                elif j and table[j][i] == table[j - 1][i] + 1:
                    j -= 1
                    extra.append(words[lo + j])
                    named |= _naming(words, lo + j)
                else:
                    i -= 1
                    missing.append(want[i])
                    named |= _naming(want, i)
            if not named:
                yield lo + j, best[1], t, missing[::-1], extra[::-1]
            lo = best[1]

    def scan(self, text: bytes) -> Iterator[tuple[int, int, str | None, float, list[str], list[str], bool]]:
        """start, end, license, reduction, missing, extra, confirmed of each notice, and of each block of other cues with the best ranked template."""
        if not _HINT.search(text):
            return
        held = self.tokens(text)
        words = [_fold(w) for w, _, _ in held]
        rows, taken = [], []
        for first, last, t, missing, extra in self.confirmed(words) if held else ():
            start, end = held[first][1], held[last - 1][2]
            taken.append((start, end))
            rows.append((start, end, self.names[t], self.rank(b" ".join(words[first:last]), [t])[0][0], missing, extra, True))
        for start, end in self.blocks(text, taken):
            own = [_fold(w) for w in _BYTES.findall(text[start:end])]
            reduction, t = self.rank(b" ".join(own))[0]
            missing, extra = self.differences(own, t) if reduction >= LEAST_REDUCTION else ([], [])
            rows.append((start, end, self.names[t] if reduction >= LEAST_REDUCTION else None, reduction, missing, extra, False))
        for start, end, name, reduction, missing, extra, sure in sorted(rows, key=lambda r: r[:2]):
            yield start, end, name, reduction, *([w.decode(errors="replace") for w in x] for x in (missing, extra)), sure


def license_blocks(docs: DataFrame, scanner: dict | None = None) -> DataFrame:
    """One row for each notice and each other candidate block: doc_id, start and end byte, license, reduction, missing, extra, confirmed.

    Null and empty texts, and texts without a cue word, give no row; repeated rows give theirs again, rows with a null doc_id theirs
    under null; an empty table gives none.  Of two templates that make a block equally small the first is named, of
    overlapping notices the longer; the license of a block that none makes smaller is null.  ``missing`` and ``extra`` are words as compared.  Texts are read whole: the candidate blocks of a very long one are ranked piece by piece.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    options = scanner or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LicenseScanner(**options)
        names = ["doc_id", "start", "end", "license", "reduction", "missing", "extra", "confirmed"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            rows = [(doc, *found) for doc, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True) for found in own.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, start long, end long, license string, reduction double, missing array<string>, extra array<string>, confirmed boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
