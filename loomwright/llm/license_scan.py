"""License scans: normalised text against licence templates, by the Dice coefficient over word bigrams.

Compared are runs of whole lines, so that a licence is found inside a longer text: a licence of one line, a notice of
several, or a document that is nothing else. A line of more than LONG_LINE words is read as pieces of PIECE words, so that a licence in
a minified file is found as well; spans are in lines all the same. Dice of two bigram sets of sizes a and b is 2 |common| / (a + b), so a
run can reach the threshold t only if a lies between b t / (2 - t) and b (2 - t) / t. These bounds choose, for each run,
the templates that it is compared with at all; a run whose bigrams that any template has are too few for
the threshold is compared with none. Both are necessary conditions: no match is lost. A run in which words repeat has the Dice of its
distinct bigrams, so of the runs from one line only those are compared whose last line brings a bigram that was not there yet, or an ending
of some template.

Templates are a parameter, are few, and travel with the task. Each document is read by itself; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public licence texts, fixed: what the two BSD licences share.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met:"""
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, title: str, version: str, which: str, work: str) -> tuple[str, tuple[str, ...]]:
    """The notices of a GNU licence: one line, the grant, and the grant with its disclaimer and address."""
    separator = ":" if version == "3" else ";"
    grant = f"This {work} is free software{separator} you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation{',' if version == '3' else ';'} {which}."
    warranty = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details."
    if version == "3":
        address = f"You should have received a copy of the {title} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
    else:
        address = f"You should have received a copy of the {title} along with this {work}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    return name, (f"This work is licensed under the {title}, version {version}.", grant, f"{grant} {warranty}", f"{grant} {warranty} {address}")


#: Notices and short licences by SPDX name, as public text; a template may have several forms.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
        to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
        OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
        OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "BSD-2-Clause": (f"""{_BSD_HEAD}
        {_BSD_SOURCE} {_BSD_BINARY}
        {_BSD_END}""",),
    "BSD-3-Clause": (f"""{_BSD_HEAD}
        {_BSD_SOURCE} {_BSD_BINARY}
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. {_BSD_END}""",),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    "BSL-1.0": (
        """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    ),
    **{name: forms for (name, forms) in (_gnu(*kind) for kind in (
        ("GPL-2.0", "GNU General Public License", "2", "either version 2 of the License, or (at your option) any later version", "program"),
        ("GPL-3.0", "GNU General Public License", "3", "either version 3 of the License, or (at your option) any later version", "program"),
        ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "either version 2.1 of the License, or (at your option) any later version", "library"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3", "either version 3 of the License, or (at your option) any later version", "library"),
        ("AGPL-3.0", "GNU Affero General Public License", "3", "either version 3 of the License, or (at your option) any later version", "program"),
    ))},
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
}
WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
PIECE = 12  # words
EDGE = "\x02"  # stands before the first and after the last word, so that a text of one word has bigrams


def normalise(text: str) -> list[str]:
    """Words in lower case; marks, white space and line ends don't count, dots inside version numbers do."""
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(pairwise([EDGE, *words, EDGE])) if words else set()


class Scanner:
    """Templates ready for comparison; made once in a task."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold is not between 0 and 1")
        self.t = threshold
        forms = [(name, bigrams(normalise(x))) for name, many in templates.items() for x in many]
        self.forms = sorted([(len(b), name, b) for name, b in forms if b], key=lambda f: f[:2])
        self.inner = {g for _, _, b in self.forms for g in b if EDGE not in g}
        self.ends = {g[0] for _, _, b in self.forms for g in b if g[1] == EDGE}
        self.begins = {g[1] for _, _, b in self.forms for g in b if g[0] == EDGE}
        words = [w for many in templates.values() for x in many if (w := normalise(x))]
        self.firsts, self.lasts = {tuple(w[:2]) for w in words}, {tuple(w[-2:]) for w in words}
        most = max((f[0] for f in self.forms), default=0)
        self.longest = int(most * (2 - threshold) / threshold + 1e-9)

    def pieces(self, words: list[str]) -> list[list[str]]:
        """A line cut before the first two words of any template, after the last two, and every PIECE words: where runs may begin and end in it."""
        cuts = {0, len(words), *range(PIECE, len(words), PIECE)}
        for i, pair in enumerate(pairwise(words)):
            if pair in self.firsts:
                cuts.add(i)
            if pair in self.lasts:
                cuts.add(i + 2)
        return [words[a:b] for a, b in pairwise(sorted(cuts))]

    def best(self, grams: set[tuple[str, str]]) -> tuple[float, str] | None:
        """The best Dice at or over the threshold of one run's bigrams; of equals, the alphabetically first name."""
        n, found = len(grams), None
        for size, name, template in self.forms:
            low, high = size * self.t / (2 - self.t), size * (2 - self.t) / self.t
            if not low - 1e-9 <= n <= high + 1e-9:
                continue
            dice = 2 * len(grams & template) / (n + size)
            if dice >= self.t - 1e-12 and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Matches as (first line, line after the last, licence, Dice), best first chosen, none overlapping another.

        Lines of any length are cut into pieces, so that a licence within a line is found wherever it stands; two within one line are two matches.
        What is said of lines below holds of pieces. A run begins and ends in a line that shares an inner bigram, or an edge word, with some template: a run without such
        ends has a shorter one with at least its Dice. Starts are taken from the last line to the first, with the line at
        which each bigram first occurs from there on; runs stop where they hold more distinct bigrams than the longest
        template allows.
        """
        lines, number = [], []  # words, and the text's line that they stand in
        for i, x in enumerate((text or "").split("\n")):
            if words := normalise(x):
                pieces = self.pieces(words)
                lines += pieces
                number += [i] * len(pieces)
        useful = self._useful(lines)
        order = list(useful)
        if not order:
            return []
        at: dict[tuple[str, str], int] = {}  # where each bigram first occurs
        new: dict[int, set[tuple[str, str]]] = {}  # by line, the bigrams that first occur there
        steps: list[int] = []  # lines with any, the nearest last
        endings: dict[str, list[int]] = {}  # by last word of some template, the useful lines that end in it, the nearest last

        def put(gram: tuple[str, str], line: int) -> None:
            if (old := at.get(gram)) is not None:
                new[old].discard(gram)
            at[gram] = line
            new.setdefault(line, set()).add(gram)

        found = []
        for k in range(order[-1], order[0] - 1, -1):
            if k + 1 < len(lines):
                # The line behind is no start any more: what crosses the border to it is first of all there.
                gram = (lines[k][-1], lines[k + 1][0])
                if gram not in at or at[gram] > k + 1:
                    put(gram, k + 1)
                    if not steps or steps[-1] != k + 1:
                        steps.append(k + 1)
            for gram in pairwise(lines[k]):
                put(gram, k)
            steps.append(k)
            new.setdefault(k, set())
            if k in useful and lines[k][-1] in self.ends:
                endings.setdefault(lines[k][-1], []).append(k)
            if k in useful:
                found += self._runs(k, lines, useful, new, steps, endings)
        chosen: list[tuple[int, int, str, float]] = []
        for dice, first, end, name in sorted((-d, a, b + 1, name) for d, a, b, name in found):
            if all(end <= a or b <= first for a, b, _, _ in chosen):
                chosen.append((first, end, name, -dice))
        return [(number[a], number[b - 1] + 1, name, dice) for a, b, name, dice in sorted(chosen)]

    def _runs(self, k: int, lines: list[list[str]], useful: dict[int, None], new: dict[int, set], steps: list[int], endings: dict[str, list[int]]) -> list[tuple[float, int, int, str]]:
        """(Dice, first line, last line, licence) of the runs from line k on that are to be compared."""
        found, grams, common, i = [], set(), 0, len(steps) - 1
        start = (EDGE, lines[k][0])
        while i >= 0:
            line = steps[i]
            if not new[line] and line != k:  # what it had first is by now found nearer to the start
                del steps[i]
                i -= 1
                continue
            i -= 1
            grams |= new[line]
            common += len(new[line] & self.inner)
            if len(grams) > self.longest:
                break
            # Two edges may be common as well. The smallest template within the bounds asks for least.
            if 2 * (common + 2) / (len(grams) + 2 + max(1, len(grams) * self.t / (2 - self.t))) < self.t:
                continue
            following = steps[i] if i >= 0 else len(lines)
            last = {line} if line in useful else set()
            for places in endings.values():  # the first line from here on with each ending, before another bigram comes
                at = bisect_left(places, -line, key=lambda x: -x)
                nearest = places[at] if at < len(places) and places[at] == line else places[at - 1] if at else None
                if nearest is not None and line <= nearest < following:
                    last.add(nearest)
            for end in last:
                if match := self.best(grams | {start, (lines[end][-1], EDGE)}):
                    found.append((match[0], k, end, match[1]))
        return found

    def _useful(self, lines: list[list[str]]) -> dict[int, None]:
        """Lines with a bigram of some template, be it across the border to the next line, or with an edge word. In order."""
        found = set()
        for i, words in enumerate(lines):
            if i and (lines[i - 1][-1], words[0]) in self.inner:
                found |= {i - 1, i}
            if words[0] in self.begins or words[-1] in self.ends or any(g in self.inner for g in pairwise(words)):
                found.add(i)
        return dict.fromkeys(sorted(found))


def scan_documents(docs: DataFrame, *, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, license (of the best match, null if none), dice, n_matches, matches (array of line spans, names and Dice).

    A null or empty text matches nothing and has dice 0. Of equal Dice the earliest match is the best. Repeated
    rows give equal rows, other columns are ignored, texts are read whole and an empty table gives an empty result.
    """
    scanner = (dict(templates), threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(*scanner)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                matches = s.scan(text)
                top = max(matches, key=lambda m: m[3], default=None)
                rows.append((top and top[2], top[3] if top else 0.0, len(matches), [dict(zip(("first_line", "end_line", "license", "dice"), m)) for m in matches]))
            yield pd.concat([batch[["id"]], pd.DataFrame(rows, columns=["license", "dice", "n_matches", "matches"], index=batch.index)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, f"id {kind}, license string, dice double, n_matches bigint, matches array<struct<first_line: bigint, end_line: bigint, license: string, dice: double>>").withColumnRenamed("id", id_col)
