"""License scan: base phrases, and templates compiled into token automata (operator 8).

Words are runs of digits, a-z and everything outside ASCII, A-Z in lower case. A template is
text with ``<<beginOptional>>...<<endOptional>>`` (may be left out), ``<<var;max=n>>`` (any
0 to n words) and ``<<var;min=1;max=n>>``. It becomes an automaton over words with empty moves
for what may be left out; a place is accepted only if all mandatory words stand there exactly,
so a licence cut anywhere in its mandatory wording, or with a word changed there, gets no label.
The longest accepted end counts. Only places where a template's opening mandatory words stand
are tried, found by byte search, so whole texts cost little more than cutting them into words.

The templates are whole licences (``mit``, ``isc``, ``bsd-2-clause``, ``bsd-3-clause``, ``zlib``),
whole notices that put a work under one (``apache-2.0``, ``gpl-notice``), one-sentence notices
(``-reference``) and SPDX lines with an identifier of ``SPDX_IDS``.

Null texts count as empty: no words, no labels, score 0. An empty table gives an empty result.
Very long texts are scanned whole, one at a time in a task. Places may overlap; repeated rows get
equal values; extra columns are kept under their names, input columns named like an output column
are replaced. Score: the share of words inside an accepted place or a phrase.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from forgeframe.llm._common import fresh, map_rows

#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# The wording of public licences and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files<<beginOptional>>
(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;min=1;max=12>>
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var;min=1;max=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY
<<var;min=1;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = """<<beginOptional>>3. <<endOptional>>Neither the name of <<var;min=1;max=12>> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: <<beginOptional>>1. <<endOptional>>The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. <<beginOptional>>2. <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. <<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
copy of the License at <<beginOptional>>http://www.apache.org/licenses/LICENSE-2.0<<beginOptional>>.txt<<endOptional>> <<endOptional>>Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
<<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License as published by the Free Software Foundation, either
version <<var;min=1;max=2>> of the License, or (at your option) any later version. <<var;min=1;max=4>> is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
<<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License for more details."""
SPDX_IDS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]

#: Label and template text.
TEMPLATES = [
    ("mit", MIT),
    ("isc", ISC),
    ("bsd-2-clause", BSD.format(third="")),
    ("bsd-3-clause", BSD.format(third=THIRD)),
    ("zlib", ZLIB),
    ("apache-2.0", APACHE),
    ("gpl-notice", GPL),
    ("apache-2.0-reference", "Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0"),
    ("mit-reference", "Released under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit-reference", "Licensed under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("gpl-reference", "licensed under the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General Public License<<beginOptional>>, version <<var;min=1;max=1>><<endOptional>>"),
    ("cc-by-nc-reference", "Licensed under <<beginOptional>>a <<endOptional>>CC BY-NC<<beginOptional>> <<var;min=1;max=1>>.0<<endOptional>>"),
    ("cc-by-sa-reference", "Licensed under <<beginOptional>>a <<endOptional>>CC BY-SA<<beginOptional>> <<var;min=1;max=1>>.0<<endOptional>>"),
    ("copyright-notice", "Copyright <<beginOptional>>(c) <<endOptional>><<var;min=1;max=8>> All rights reserved"),
    *[("spdx", f"SPDX-License-Identifier: {x}") for x in SPDX_IDS],
]

#: Bytes of words stay, A-Z go to a-z, other ASCII becomes a space.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
MARKS = re.compile(r"<<(beginOptional|endOptional|var)(?:;min=(\d+))?(?:;max=(\d+))?>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Automaton:
    """States are numbers; ``on[s]`` maps a word to the next state, ``any_to[s]`` takes any word, ``free[s]`` moves without one."""

    def __init__(self, template: str):
        self.on: list[dict[bytes, int]] = [{}]
        self.any_to: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        at, opened, self.opening, plain = 0, [], [], True
        parts = MARKS.split(template)
        for i in range(0, len(parts), 4):
            for w in words_of(parts[i]):
                new = self._state()
                self.on[at][w] = new
                at = new
                if plain:
                    self.opening.append(w)
            if i + 1 >= len(parts):
                break
            plain = False
            if parts[i + 1] == "beginOptional":
                opened.append(at)
            elif parts[i + 1] == "endOptional":
                new = self._state()
                self.free[at].append(new)
                self.free[opened.pop()].append(new)
                at = new
            else:
                least, most, end = int(parts[i + 2] or 0), int(parts[i + 3] or 1), self._state()
                for n in range(most):
                    if n >= least:
                        self.free[at].append(end)
                    new = self._state()
                    self.any_to[at] = new
                    at = new
                self.free[at].append(end)
                at = end
        if opened or not self.opening:
            raise ValueError(f"a template needs opening words and closed regions: {template!r}")
        self.final = at

    def _state(self) -> int:
        self.on.append({})
        self.any_to.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """The longest accepted end from word ``at``; None if the mandatory wording isn't there."""
        states, end = self._closed({0}), None
        while True:
            if self.final in states:
                end = at
            if at >= len(words):
                return end
            w = words[at]
            states = self._closed({t for s in states for t in (self.on[s].get(w), self.any_to[s]) if t is not None})
            if not states:
                return end
            at += 1


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", len(words_of(p)), label) for p, label in phrases]
        self.templates = [(a, b" " + b" ".join(a.opening) + b" ", label) for label, t in templates for a in [Automaton(t)]]

    def __call__(self, text: str | None) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Words, base places and template places as (label, first word, end)."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base, own = [], []
        for needle, n, label in self.phrases:
            at, word, seen = joined.find(needle), 0, 0
            while at >= 0:
                word += joined.count(b" ", seen, at)
                seen = at
                base.append((label, word, word + n))
                at = joined.find(needle, at + 1)
        for automaton, needle, label in self.templates:
            at, word, seen = joined.find(needle), 0, 0
            while at >= 0:
                word += joined.count(b" ", seen, at)
                seen = at
                if (end := automaton.match(words, word)) is not None:
                    own.append((label, word, end))
                at = joined.find(needle, at + 1)
        return len(words), base, own


def covered(places: list[tuple[str, int, int]]) -> int:
    total, reach = 0, 0
    for _, a, z in sorted(places, key=lambda p: p[1:]):
        total += max(0, z - max(a, reach))
        reach = max(reach, z)
    return total


SPAN = ArrayType(StructType([StructField("label", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs`` with n_words, base and matches (arrays of label, start, end in words) and score."""
    own = ["n_words", "base", "matches", "score"]
    docs = docs.select(*[c for c in docs.columns if c not in own])

    def make():
        scanner = Scanner(phrases, templates)
        span = lambda places: [{"label": a, "start": b, "end": c} for a, b, c in places]

        def block(columns):
            found = [scanner(t) for t in columns[0]]
            return [[n for n, _, _ in found], [span(b) for _, b, _ in found], [span(o) for _, _, o in found], [covered(b + o) / n if n else 0.0 for n, b, o in found]]

        return block

    schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("base", SPAN), StructField("matches", SPAN), StructField("score", DoubleType())])
    return map_rows(docs.select("*", F.col(text).alias(fresh("text"))), schema, make, through=len(docs.columns))
