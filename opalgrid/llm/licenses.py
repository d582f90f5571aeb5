"""License scans by conditional compression.

Candidate blocks are the words around each mention of licensing, as many to either side as the longest template may take, wherever lines and
paragraphs end. Each is cut into overlapping windows, of which one holds any place that a template can take. A window is compressed by zstandard alone, and with each template as its raw dictionary;
templates are ranked by the bytes that this saves, as a share of what the template itself takes, so that text around a
notice does not count. Those that save enough are aligned with the window word by word, and a license is
reported where the differences in wording are few and none is in a name or a version. The longest wording that is
confirmed is taken out, and the rest ranked again until nothing is confirmed.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import column, read_table, small_batches

#: Licenses by identifier, the names that notices give them, and wordings of notices and texts.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "Apache License 2.0"],
    "MIT": ["the MIT License"],
    "ISC": ["the ISC License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-clause BSD license"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-clause BSD license"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GPL v2", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GPL v3", "GPLv3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0"],
    "Unlicense": ["the Unlicense"],
    "CC0-1.0": ["CC0 1.0", "the Creative Commons Zero v1.0 Universal license"],
    "CC-BY-3.0": ["CC BY 3.0", "the Creative Commons Attribution 3.0 License"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike 3.0 License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
NOTICES = ["Licensed under {}.", "This work is licensed under {}.", "Released under {}.", "Available under {}.", "Distributed under the terms of {}.", "Available under the terms of {}.", "Licensed under the terms of {}."]
#: Notices that give an identifier, with its dashes or with spaces in their place.
TAGS = ["License: {}", "Licensed under {}", "{} licensed"]
#: What may follow the identifier of a license of these families.
GNU = ("GPL", "LGPL", "AGPL")
SUFFIXES = ["", "-only", "-or-later"]
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
    "License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0": _GNU.format("General Public License", "2"),
    "GPL-3.0": _GNU.format("General Public License", "3"),
    "LGPL-2.1": _GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0": _GNU.format("Lesser General Public License", "3"),
    "AGPL-3.0": _GNU.format("Affero General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: The texts of licenses that files often give with their disclaimers.
WHOLE_TEXTS = {
    "ISC": TEXTS["ISC"] + _ISC_DISCLAIMER,
    "BSD-2-Clause": TEXTS["BSD-2-Clause"] + _BSD_DISCLAIMER,
    "BSD-3-Clause": TEXTS["BSD-3-Clause"] + _BSD_DISCLAIMER,
}

#: What every template has some of.
KEYWORD = re.compile(r"licen[cs]|(?:released|distributed|available)\s+under|copyright|permission|redistribut|warrant|spdx|public domain|copyleft|creative commons|\bCC[ -]?(?:BY|0)|\b[AL]?GPL", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Words that tell licenses apart: any difference in them rules a template out.
_TELLING = re.compile(r"[0-9]|^(?:apache|mit|isc|bsd|gnu|gpl|lgpl|agpl|mpl|epl|mozilla|eclipse|affero|lesser|cc0?|by|by-.*|clause|zero|noncommercial|attribution.*|noderivatives|sharealike|unlicense)", re.IGNORECASE)

#: Share of a template's own compressed size that it must save; the wording alone decides on what is above.
LEAST_REDUCTION = 0.02
MOST_DIFFERENCES = 0.1
LEVEL = 3
#: What may stand between the names of licenses that a notice gives together.
_JOINING = frozenset(("or", "and", "either"))


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    #: The name in the text, which other names may follow ("the MIT License or Apache 2.0").
    name: str = ""

    @cached_property
    def lead(self) -> int:
        """The number of words before the name."""
        return len(self.words) - len(words(self.name)) if self.name else 0

    @cached_property
    def words(self) -> list[str]:
        return words(self.text)

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def telling(self) -> frozenset[str]:
        return frozenset(w for w in self.words if _TELLING.search(w))

    @cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(self.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False)


def templates() -> list[Template]:
    """All templates, each wording once."""
    out = [Template(k, n.format(name), name) for k, names in NAMES.items() for name in names for n in NOTICES]
    for k in NAMES:
        ids = [k + x for x in (SUFFIXES if k.startswith(GNU) else [""])]
        out += [Template(k, f"SPDX-License-Identifier: {i}", i) for i in ids]
        out += [Template(k, n.format(i), i if n.endswith("{}") else "") for i in dict.fromkeys([*ids, k.replace("-", " ")]) for n in TAGS]
    out += [Template(k, t) for k, t in [*TEXTS.items(), *WHOLE_TEXTS.items()]]
    return list({tuple(t.words): t for t in reversed(out)}.values())[::-1]


@dataclass(frozen=True)
class Found:
    """A license: the lines that its wording touches, and the wording itself."""

    license: str
    start: int
    end: int
    reduction: float
    differences: str
    first: int
    last: int

    @property
    def n_differences(self) -> int:
        return len(self.differences.split()) if self.differences else 0


def _words_before(text: str, at: int, n: int) -> int:
    """Where the n-th word before a place begins, or the first that there is."""
    size = 16 * n
    while True:
        lo = max(0, at - size)
        # the first of a cut text may be a piece of a word
        starts = [m.start() for m in _WORD.finditer(text, lo, at)][lo > 0 :]
        if len(starts) >= n:
            return starts[-n]
        if not lo:
            return starts[0] if starts else at
        size *= 4


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Candidates: ``reach`` words to either side of each keyword, joined where they meet."""
    out: list[tuple[int, int]] = []
    words_ = ahead = None
    for hit in KEYWORD.finditer(text):
        if not out or hit.start() > out[-1][1]:
            start = _words_before(text, hit.start(), reach)
            start = out.pop()[0] if out and start <= out[-1][1] else start
            words_, ahead = _WORD.finditer(text, hit.start()), deque()
        else:
            start = out.pop()[0]
        while ahead and ahead[0] <= hit.start():
            ahead.popleft()
        while len(ahead) <= reach and (m := next(words_, None)):
            ahead.append(m.end())
        out.append((start, max(hit.end(), ahead[-1]) if ahead else hit.end()))
    return out


def windows(n: int, most: int) -> list[tuple[int, int]]:
    """Ranges of ``n`` words that overlap by half: any run of up to ``2 * most`` words lies within one."""
    step = 2 * most
    return [(at, min(n, at + 2 * step)) for at in range(0, max(1, n - step), step)]


def aligned(template: list[str], block: list[str]) -> tuple[list[str], int, int] | None:
    """Words missing from (-) and added to (+) the template's wording in the block, and where that begins and ends; None where a
    telling word differs or too many do.

    What stands before and after the aligned part of the block is not part of the wording, nor are empty words, which were taken out.
    """
    between = lambda m, n: sum(map(bool, block[m.b + m.size : n.b]))
    matched = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    # words far off at either end that are also the template's: to leave them out costs less than what stands between
    while len(matched) > 1 and between(*matched[:2]) > matched[0].size:
        del matched[0]
    while len(matched) > 1 and between(*matched[-2:]) > matched[-1].size:
        del matched[-1]
    if not matched:
        return None
    out, a, b = [], 0, matched[0].b
    for m in matched:
        out += [f"-{w}" for w in template[a : m.a]]
        out += [f"+{w}" for w in block[b : m.b] if w]
        a, b = m.a + m.size, m.b + m.size
    out += [f"-{w}" for w in template[a:]]
    if any(_TELLING.search(d[1:]) for d in out) or len(out) > MOST_DIFFERENCES * len(template):
        return None
    return out, matched[0].b, b


class Scanner:
    """Templates with their compressors; one for each Python worker."""

    def __init__(self) -> None:
        self.templates = templates()
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        self.sizes = {t: len(self.plain.compress(t.text.encode())) for t in self.templates}
        # windows for long templates would hold much that is not of a short one
        notices = [t for t in self.templates if len(t.words) <= 20]
        texts = [t for t in self.templates if len(t.words) > 20]
        self.scales = [(max(len(t.words) for t in ts), ts) for ts in (texts, notices)]
        # a template with its differences lies within so many words of any of its keywords
        self.reach = int(self.scales[0][0] * (1 + MOST_DIFFERENCES)) + 1

    def rank(self, block: bytes, among: list[Template] | None = None) -> list[tuple[float, Template]]:
        """Templates by the bytes that each saves, as a share of the template's own compressed size."""
        among = self.templates if among is None else among
        alone = len(self.plain.compress(block)) if among else 0
        saved = [((alone - len(t.compressor.compress(block))) / self.sizes[t], i) for i, t in enumerate(among)]
        return [(s, among[i]) for s, i in sorted(saved, key=lambda x: (-x[0], x[1]))]

    @staticmethod
    def possible(among: list[Template], own: list[str]) -> list[Template]:
        """Without the templates that cannot be confirmed in these words, as too many of theirs or a telling one are not there."""
        known = set(own)
        near = [t for t in among if t.telling <= known]
        if not near:
            return []
        counts = Counter(own)
        return [t for t in near if sum(max(0, n - counts[w]) for w, n in t.counts.items()) <= MOST_DIFFERENCES * len(t.words)]

    def best(self, among: list[Template], block: str, found: list[re.Match], own: list[str], lo: int, hi: int, before: int) -> tuple | None:
        """Of the templates confirmed in words ``lo`` to ``hi``, and that begin before ``before``, the one with the longest wording."""
        near = self.possible(among, own[lo:hi])
        if not near:
            return None
        # the text without what was taken out
        pieces, at = [], lo
        while at < hi:
            if own[at]:
                end = at
                while end < hi and own[end]:
                    end += 1
                pieces.append(block[found[at].start() : found[end].start() if end < hi else found[end - 1].end()])
                at = end
            at += 1
        tried = []
        for saved, t in self.rank(" ".join(pieces).encode("utf-8", "surrogatepass"), near):
            got = aligned(t.words, own[lo:hi]) if saved >= LEAST_REDUCTION else None
            if got and lo + got[1] < before:
                diff, i, j = got
                tried.append((len(diff) - len(t.words), len(diff), -saved, t.license, lo + i, lo + j, diff, t))
        return min(tried, key=lambda x: x[:4]) if tried else None

    def another(self, t: Template, block: str, found: list[re.Match], own: list[str], j: int) -> int | None:
        """Where the next name begins if one follows at ``j``, joined to the last by a comma, a stroke or a conjunction."""
        k = j
        while k < len(own) and own[k] in _JOINING:
            k += 1
        if k == len(own) or (k == j and not re.fullmatch(r"[\s,/&|+]*[,/&|+][\s,/&|+]*", block[found[j - 1].end() : found[k].start()])):
            return None
        names = (words(o.name) for o in self.templates if o.name and o.words[: o.lead] == t.words[: t.lead])
        return k if any(own[k : k + len(n)] == n for n in names) else None

    def confirmed(self, block: str) -> list[tuple[str, int, int, float, str]]:
        """(license, start, end, saving, differences) of all wordings in a block; what is confirmed is taken out and the rest tried again."""
        found = list(_WORD.finditer(block))
        own = [m[0].lower() for m in found]
        out, n = [], -1
        while n < len(out):
            n = len(out)
            for most, among in self.scales:
                for lo, hi in windows(len(own), most):
                    if hi > lo and not KEYWORD.search(block, found[lo].start(), found[hi - 1].end()):
                        continue
                    # what begins later is whole in the next window
                    before = hi if hi == len(own) else lo + 2 * most
                    while got := self.best(among, block, found, own, lo, hi, before):
                        _, _, less, license, i, j, diff, t = got
                        out.append((license, found[i].start(), found[j - 1].end(), -less, " ".join(diff)))
                        name = self.another(t, block, found, own, j) if t.name and j < len(own) else None
                        if name is not None:
                            # the words before the name stay, for the next name
                            i += t.lead
                            j = name
                        own[i:j] = [""] * (j - i)
        return out

    def scan(self, text: str) -> tuple[int, list[Found]]:
        """The number of candidates, and all licenses found in them, each wording once."""
        found: list[Found] = []
        spans = blocks(text, self.reach)
        for start, end in spans:
            for license, i, j, saved, diff in self.confirmed(text[start:end]):
                first, last = start + i, start + j
                stop = text.find("\n", last)
                found.append(Found(license, text.rfind("\n", 0, first) + 1, stop if stop >= 0 else len(text), saved, diff, first, last))
        return len(spans), sorted(found, key=lambda f: (f.start, f.end, f.first, f.last, f.license))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_candidates, found) for each row; ``found`` is an array of (license, start, end, reduction, differences, first, last).

    Places are code points: of the lines, and ``first`` and ``last`` of the wording itself. Null and empty texts have no candidates; texts of any length are scanned
    whole, and a notice counts whatever stands around it; null ids pass through, repeated rows are scanned one by one; of wordings that are confirmed at one place the longest
    counts, then that with fewest differences, then that which saves most; extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("differences", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            counts, rows = [], []
            for text in batch.column(1).to_pylist():
                n, found = scanner.scan(text or "")
                counts.append(n)
                rows.append([{"license": f.license, "start": f.start, "end": f.end, "reduction": f.reduction, "differences": f.differences, "first": f.first, "last": f.last} for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_candidates", "found"])

    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_candidates long, found array<struct<license:string,start:long,end:long,reduction:double,differences:string,first:long,last:long>>")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_found, and the licenses as license:start:end:differing words, in order, with the places of the wordings."""
    out = scan(read_table(spark, sf_dir, "documents"))
    shown = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["first"].cast("string"), f["last"].cast("string"), F.when(f["differences"] == "", 0).otherwise(F.size(F.split(f["differences"], " "))).cast("string")))
    return out.select("doc_id", "n_candidates", F.size("found").cast("long").alias("n_found"), F.concat_ws(",", shown).alias("licenses"), F.array_max(F.transform("found", lambda f: f["reduction"])).alias("best_reduction"))
