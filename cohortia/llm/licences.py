"""Licence scans: passages against licence templates by the Dice coefficient of their word bigrams.

A passage is a line, a paragraph (lines up to one without words), the whole text, or a run of words
wherever it lies: in the middle of a line, over several paragraphs, behind comment marks. Text is
normalised to lower-case words of letters and digits. Two sets of a and b bigrams can reach a Dice
coefficient t only if b lies between a * t / (2 - t) and a * (2 - t) / t, so templates of other sizes
are never looked at, and most passages meet no template at all. The same bounds place the runs: one
shares at least b * t / (2 - t) bigrams with its template, within (2 - t) / t times its words. The
templates are a list read on the driver (``templates``: the files of ``licence_texts``, notices and
statements, or the caller's own) and given to every task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Members, Words, alphabet, chunks, distinct, hash_words, mix, text_buffers
from .tables import small_batches

THRESHOLD = 0.8
#: Bigrams held by more licences than this, and by more than half of all, tell none of them.
LEAD_LEAST = 8
_U = np.uint64
_ABC = alphabet(lower=True, letters=True, digits=True)

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""


_AGPL_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License,
if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network
(if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the
Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This
Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is
incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine
any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the
resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined
will remain governed by version 3 of the GNU General Public License. """
LEADS = ("Licensed under", "Licensed under the", "Licensed under the terms of the", "Released under", "Released under the", "Distributed under the")
LEADS += ("Distributed under the terms of the", "Available under the", "This work is licensed under the", "This work is licensed under a")
LEADS += ("This project is licensed under the", "This software is licensed under the", "This software is released under the")


CC_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CC_ENDS = {"3.0": "Unported", "4.0": "International"}


def full_texts() -> list[tuple[str, str]]:
    """Licence id and whole text of every file of ``licence_texts``; AGPL-3.0 is made from GPL-3.0."""
    files = sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name)
    out = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files if f.name.endswith(".txt")]
    gpl = dict(out)["GPL-3.0"]
    # Title, name and section 13 differ; without a text of its own an AGPL would be called a GPL.
    agpl = gpl[: gpl.index("  13. Use with")] + _AGPL_13 + gpl[gpl.index("  14. Revised Versions") :]
    agpl = agpl.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace(_AGPL_13, "\0").replace("GNU General Public", "GNU Affero General Public")
    return [*out, ("AGPL-3.0", agpl.replace("\0", _AGPL_13))]


def _templates() -> list[tuple[str, str]]:
    """Licence id and template text: full texts, notices, one-line statements made from names and SPDX lines."""
    out = [
        ("MIT", _MIT_BODY),
        ("MIT", "MIT License " + _MIT_BODY),
        ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
        ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
        ("Apache-2.0", _APACHE),
        ("ISC", _ISC),
        ("MPL-2.0", _MPL),
        ("Unlicense", _UNLICENSE),
    ]
    gnu = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
    names = {
        "MIT": ["MIT License"],
        "BSD-2-Clause": ["BSD 2-Clause License"],
        "BSD-3-Clause": ["BSD 3-Clause License", "BSD License"],
        "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
        "ISC": ["ISC License"],
        "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    }
    for short, name in gnu.items():
        for version in ("2", "2.1", "3"):
            if (short, version) in (("GPL", "2.1"), ("LGPL", "2"), ("AGPL", "2"), ("AGPL", "2.1")):
                continue
            key = f"{short}-{version}" + (".0" if "." not in version else "")
            out.append((key, _GNU.format(name=name, version=version)))
            names[key] = [f"{name}, version {version}", f"{name} v{version}", f"{name} version {version}.0"]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("3.0", "4.0"):
            whole = f"Creative Commons {'-'.join(CC_WORDS[k] for k in kind.split('-'))} {version}"
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"Creative Commons {kind} {version}", whole, f"{whole} {CC_ENDS[version]} License"]
    names["CC0-1.0"] = ["CC0 1.0", "CC0 1.0 Universal"]
    for key, known in names.items():
        for name in known:
            out += [(key, f"{lead} {name}") for lead in LEADS]
    out += full_texts()
    for key in dict.fromkeys(k for k, _ in out):
        gnu_like = key.startswith(("GPL", "LGPL", "AGPL", "GFDL"))
        out += [(key, f"SPDX-License-Identifier: {key}{form}") for form in (("", "-only", "-or-later") if gnu_like else ("",))]
    return out


def bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _U(0xD1342543DE82EF95) + words[1:])


class Templates:
    """Bigram sets of all templates, by bigram."""

    def __init__(self, texts: list[tuple[str, str]]):
        data, offsets = text_buffers(pa.array([t for _, t in texts]))
        words = hash_words(data, offsets, _ABC)
        sets = [distinct(bigrams(words.hashes[a:b]))[0] for a, b in zip(words.first, words.first[1:])]
        self.names = [n for n, _ in texts]
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.members = Members(flat)
        self.owner = owner[order]
        self.first = np.searchsorted(flat[order], self.members.values)
        self.last = np.searchsorted(flat[order], self.members.values, side="right")
        self.words = np.diff(words.first)
        # Bigrams that most licences have come from the leads of statements and name no licence.
        ids = np.unique(self.names, return_inverse=True)[1]
        pairs = distinct(np.searchsorted(self.members.values, flat) * (ids.max() + 1) + ids[owner])[0]
        held = np.bincount(pairs // (ids.max() + 1), minlength=len(self.members.values))
        self.telling = held <= max(LEAD_LEAST, (ids.max() + 1) // 2)


def _best(words: Words, templates: Templates, threshold: float) -> list[tuple[int, int, float]]:
    """Per passage with a template at the threshold: passage, template and Dice coefficient."""
    counts = np.diff(words.first)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    # A passage of w words has at most w - 1 distinct bigrams; with fewer than the least template needs it is passed over.
    enough = counts - 1 >= low * templates.size.min()
    per = np.where(enough, counts - 1, 0)
    if not per.sum():
        return []
    passage = np.repeat(np.arange(len(counts)), per)
    at = np.arange(len(passage)) + np.repeat(words.first[:-1] - (np.cumsum(per) - per), per)
    found = mix(words.hashes[at] * _U(0xD1342543DE82EF95) + words.hashes[at + 1])
    known = templates.members.find(found)
    # Passages that share nothing with any template need no set.
    touched = np.zeros(len(counts), bool)
    touched[passage[known >= 0]] = True
    keep = touched[passage]
    passage, found = passage[keep], found[keep]
    order = np.lexsort((found, passage))
    passage, found = passage[order], found[order]
    new = np.ones(len(passage), bool)
    new[1:] = (passage[1:] != passage[:-1]) | (found[1:] != found[:-1])
    passage, found = passage[new], found[new]
    size = np.bincount(passage, minlength=len(counts))
    place = templates.members.find(found)
    passage, place = passage[place >= 0], place[place >= 0]
    n = templates.last[place] - templates.first[place]
    owner = templates.owner[np.repeat(templates.first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    passage = np.repeat(passage, n)
    fits = (templates.size[owner] >= low * size[passage]) & (templates.size[owner] <= high * size[passage])
    keys, both = distinct(passage[fits].astype(np.int64) * len(templates.names) + owner[fits])
    p, t = keys // len(templates.names), keys % len(templates.names)
    dice = 2.0 * both / (size[p] + templates.size[t])
    best: dict[int, tuple[float, int]] = {}
    for i in np.flatnonzero(dice >= threshold):
        was = best.get(int(p[i]))
        if was is None or dice[i] > was[0]:
            best[int(p[i])] = (float(dice[i]), int(t[i]))
    return [(k, t, d) for k, (d, t) in sorted(best.items())]


def _repeats(x: np.ndarray) -> np.ndarray:
    """Place of the previous equal value, -1 for a first one."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), -1, np.int64)
    same = x[order[1:]] == x[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _cluster_runs(found: np.ndarray, place: np.ndarray, at: np.ndarray, size: int, most: int, telling: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """Shared bigrams, first and last bigram and Dice coefficient of the best run from every start in one stretch of a text.

    ``at`` lists the bigrams shared with the template. One more shared bigram never lowers the
    coefficient, so a best run starts where a stretch of them starts and ends where one ends.
    """
    least = int(np.ceil(threshold / (2 - threshold) * size - 1e-9))
    lo = int(at[0])
    before = _repeats(found[lo : int(at[-1]) + 1]) + lo
    before[before < lo] = -1
    fresh, tells = before[at - lo], telling[place[at]]
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    streak = np.repeat(starts, np.diff(starts, append=len(at)))
    starts = np.flatnonzero((at - at[streak]) % most == 0)
    stops = np.searchsorted(at, at[starts] + most, side="left")
    for i, j in zip(starts[stops - starts >= least], stops[stops - starts >= least]):
        both = np.cumsum(fresh[i:j] < at[i])
        if both[-1] < least:
            continue
        words = np.cumsum(before[at[i] - lo : at[j - 1] - lo + 1] < at[i])[at[i:j] - at[i]]
        dice = np.where(np.cumsum(tells[i:j]) > 0, 2.0 * both / (words + size), 0.0)
        k = len(dice) - 1 - int(dice[::-1].argmax())  # of equal runs the longest
        if dice[k] >= threshold:
            yield int(both[k]), int(at[i]), int(at[i + k]), float(dice[k])


def _runs(words: Words, templates: Templates, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """Text, first and last word, template and Dice coefficient of licences wherever they lie; of overlapping runs the one that shares most with its template."""
    if len(words.hashes) < 2:
        return []
    found = bigrams(words.hashes)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    place = templates.members.find(found)
    place[text[1:] != text[:-1]] = -1
    at = np.flatnonzero(place >= 0)
    n = templates.last[place[at]] - templates.first[place[at]]
    owner = templates.owner[np.repeat(templates.first[place[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    at = np.repeat(at, n)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = np.ceil(low * templates.size - 1e-9).astype(np.int64)
    most = np.ceil(high * np.maximum(templates.words - 1, 1)).astype(np.int64)
    group = text[at] * len(templates.names) + owner
    # Texts without enough of a template go first, by counts alone.
    values, inverse, total = np.unique(group, return_inverse=True, return_counts=True)
    keep = (total >= least[values % len(templates.names)])[inverse]
    at, owner, group = at[keep], owner[keep], group[keep]
    order = np.lexsort((at, group))
    at, owner, group = at[order], owner[order], group[order]
    # Then whatever lies in no window with enough of it; the rest falls into stretches.
    first = np.flatnonzero(np.arange(len(at)) + least[owner] <= len(at))
    last = first + least[owner[first]] - 1
    near = (group[last] == group[first]) & (at[last] - at[first] < most[owner[first]])
    inside = np.bincount(first[near], minlength=len(at) + 1) - np.bincount(last[near] + 1, minlength=len(at) + 1)
    keep = np.cumsum(inside[:-1]) > 0
    at, owner, group = at[keep], owner[keep], group[keep]
    if not len(at):
        return []
    cuts = np.flatnonzero((group[1:] != group[:-1]) | (np.diff(at) >= most[owner[1:]])) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(at)]):
        t = int(owner[a])
        for both, i, j, dice in _cluster_runs(found, place, at[a:b], int(templates.size[t]), int(most[t]), templates.telling, threshold):
            out.append((-both, -dice, t, i, j + 1, int(text[i])))
    taken: dict[int, list[tuple[int, int]]] = {}
    best = []
    for _, dice, t, i, j, k in sorted(out):
        if all(j < x or i > y for x, y in taken.setdefault(k, [])):
            taken[k].append((i, j))
            best.append((k, i, j, t, -dice))
    return sorted(best)


def _passages(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Kind, byte offsets and text number of lines, paragraphs and whole texts."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    ends = np.flatnonzero(data[lo:hi] == 10) + lo
    lines = distinct(np.concatenate([offsets, ends + 1]))[0]
    # A line without words is blank: white space, comment marks or a carriage return end a paragraph too.
    blank = lines[1:][np.diff(hash_words(data, lines, _ABC).first) == 0]
    for kind, cuts in (("line", ends + 1), ("paragraph", blank)):
        edges = distinct(np.concatenate([offsets, cuts]))[0]
        yield kind, edges, np.searchsorted(offsets, edges[:-1], side="right") - 1
    yield "text", offsets, np.arange(len(offsets) - 1)


def scan_licences(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, passage (line, paragraph, text or run), first_byte, licence and dice of every licensed passage.

    Each passage gets its best template, of equals the first listed; a document of one line is
    reported as line only, and a paragraph or text only where it does better than the same bytes as
    a smaller passage. A run is any stretch of words that reaches the threshold, so a licence is
    found wherever it lies; runs of one text do not overlap, and one that is exactly the words of
    another passage is not repeated. ``templates`` are pairs of licence id and text (the built-in
    table if none are given); one licence may have several. Null and empty texts give no rows. Repeated rows are all
    reported; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    listed = _templates() if templates is None else list(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Templates(listed)
        for batch in batches:
            ids = batch.column("doc_id")
            data, offsets = text_buffers(batch.column("text"))
            rows, out = [], []
            for a, b in chunks(offsets):
                seen: set[tuple[int, int, int]] = set()
                for kind, edges, owner in _passages(data, offsets[a : b + 1]):
                    words = hash_words(data, edges, _ABC)
                    for k, t, dice in _best(words, table, threshold):
                        # Without the line end, so that a line and a paragraph of one line are the same passage.
                        span = (int(owner[k]), int(words.start[words.first[k]]), int(words.start[words.first[k + 1] - 1]))
                        if span not in seen:
                            seen.add(span)
                            rows.append(a + int(owner[k]))
                            out.append((kind, int(edges[k] - offsets[a + owner[k]]), table.names[t], dice))
                # The last passages are the whole texts, whose words the runs are made of.
                for k, i, j, t, dice in _runs(words, table, threshold):
                    if (k, int(words.start[i]), int(words.start[j])) not in seen:
                        rows.append(a + k)
                        out.append(("run", int(words.start[i] - offsets[a + k]), table.names[t], dice))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", "passage", "first_byte", "licence", "dice"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, passage string, first_byte long, licence string, dice double")
