"""Operator 2: license scans by template-markup matching.

A template is license wording with marked regions: `<<beginOptional>> ... <<endOptional>>` may be left out, and
`<<var;name=x;words=lo-hi>>` stands for lo to hi words of any kind.  Each template becomes a token automaton;
a passage is accepted where all mandatory words stand in order and nothing else stands between them.  The
automata share one state space and run together, only from words that can begin a template.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters.

Defined results: a null or empty text has no words, no places, empty labels and score 0; very long texts are read
whole; of accepted passages of one label that begin at one word the longest counts, and passages that overlap count
each, but words inside several once in the score; every input row, repeated ones and null ids too, gives one output
row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, texts_of

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Whole texts and short notices of public licenses, marked up (fixed values); the label is the key.
TEMPLATES = {
    "mit-text": """<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=years and holder;words=1-40>><<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;name=holder;words=1-40>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "isc-text": """Permission to use, copy, modify, <<var;name=and;match=and/or|and>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;words=1-40>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=holder;words=1-40>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=holder;words=1-40>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1-40>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=holder;words=1-40>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
    "apache-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name=scheme;match=http|https>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License""",
    "gpl-text": """This <<var;name=work;match=program|library>> is free software: you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation, either version <<var;name=version;words=1-2>> of the License, or (at your option) any later version. This <<var;name=work;match=program|library>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License for more details<<beginOptional>>. You should have received a copy of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License along with this <<var;name=work;match=program|library>><<var;name=where;match=. If not, see https://www.gnu.org/licenses/|. If not, see http://www.gnu.org/licenses/|; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA|; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA>><<endOptional>>""",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>',
    "mit": "<<beginOptional>>Released under<<endOptional>> <<beginOptional>>the<<endOptional>> MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License <<beginOptional>><<beginOptional>>either<<endOptional>> version <<var;name=version;words=1-2>> <<beginOptional>>or any later version<<endOptional>><<endOptional>>",
    "cc-by-notice": "licensed under <<beginOptional>>a<<endOptional>> CC BY <<beginOptional>>NC<<endOptional>> <<beginOptional>>SA<<endOptional>> <<beginOptional>>ND<<endOptional>> <<var;name=version;words=2-2>>",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "copyright-notice": "Copyright <<beginOptional>>(c)<<endOptional>> <<var;name=years and holder;words=0-8>> All rights reserved",
    "public-domain": "<<beginOptional>>This work is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>dedicated<<endOptional>> <<beginOptional>>in<<endOptional>> <<beginOptional>>to<<endOptional>> the public domain",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,start:long,end:long>>"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Automata:
    """Word automata of all templates.  State k has edges by word, an edge for any word, and steps without a word."""

    words: list[dict[bytes, list[int]]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    steps: list[list[int]] = field(default_factory=list)
    accepts: dict[int, str] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)

    def state(self) -> int:
        self.words.append({})
        self.any_word.append([])
        self.steps.append([])
        return len(self.steps) - 1

    def path(self, at: int, wording: str) -> int:
        """The state after the words of `wording`, from state `at` on."""
        for word in words_of(wording):
            new = self.state()
            self.words[at].setdefault(word, []).append(new)
            at = new
        return at

    def add(self, label: str, template: str) -> None:
        at = self.state()
        self.starts.append(at)
        open_regions: list[int] = []
        for k, part in enumerate(_MARK.split(template)):
            if k % 2 == 0:
                at = self.path(at, part)
            elif part == "beginOptional":
                open_regions.append(at)
            elif part == "endOptional":
                new = self.state()
                self.steps[at].append(new)
                self.steps[open_regions.pop()].append(new)
                at = new
            elif "match=" in part:
                end = self.state()
                for wording in part.split("match=")[1].split("|"):
                    self.steps[self.path(at, wording)].append(end)
                at = end
            else:
                low, high = map(int, re.search(r"words=(\d+)-(\d+)", part).groups())
                end = self.state()
                for n in range(high + 1):
                    if n >= low:
                        self.steps[at].append(end)
                    if n < high:
                        new = self.state()
                        self.any_word[at].append(new)
                        at = new
                at = end
        if open_regions:
            raise ValueError(f"{label}: a region is not closed")
        self.accepts[at] = label

    def closed(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for k in self.steps[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return frozenset(seen)

    def ready(self) -> "Automata":
        self.begin = self.closed(self.starts)
        self.begin_words = frozenset(w for s in self.begin for w in self.words[s])
        self.memo: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.known = frozenset(w for edges in self.words for w in edges)
        return self

    def move(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.known else None)  # unknown words are alike, so the memory is bounded
        if key not in self.memo:
            self.memo[key] = self.closed({k for s in states for k in (*self.words[s].get(word, ()), *self.any_word[s])})
        return self.memo[key]

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, word after the last): from each start the longest accepted passage of each label."""
        if self.begin_words.isdisjoint(words):
            return []
        found = []
        for start in [k for k, w in enumerate(words) if w in self.begin_words]:
            states, ends, at = self.begin, {}, start
            while states and at < len(words):
                states = self.move(states, words[at])
                at += 1
                for s in states & self.accepts.keys():
                    ends[self.accepts[s]] = at
            found += [(label, start, end) for label, end in ends.items()]
        return found


def automata(templates: dict[str, str]) -> Automata:
    out = Automata()
    for label, template in templates.items():
        out.add(label, template)
    if any(label in (out.accepts.get(s) for s in out.closed([start])) for label, start in zip(templates, out.starts)):
        raise ValueError("a template without a mandatory word accepts everything")
    return out.ready()


def places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[str, int, int]]:
    found = []
    for phrase, label in phrases.items():
        if phrase[0] in words:
            n = len(phrase)
            found += [(label, k, k + n) for k, w in enumerate(words) if w == phrase[0] and tuple(words[k : k + n]) == phrase]
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places, labels and accepted spans of each document.  score: the share of the words inside any span."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    automata(templates)  # a template that cannot be compiled fails here, not in a task

    def run(batches):
        machine = automata(templates)
        base = {tuple(words_of(p)): label for p, label in phrases.items()}
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                words = words_of(text)
                own, more = places(words, base), machine.spans(words)
                labels = sorted({x[0] for x in own})
                inside = {k for _, a, b in own + more for k in range(a, b)}
                rows.append({
                    "n_words": len(words), "n_base": len(own), "first_word": min((x[1] for x in own), default=None), "last_word": max((x[1] for x in own), default=None),
                    "base_labels": ",".join(labels), "labels": ",".join(sorted({*labels, *(x[0] for x in more)})),
                    "score": len(inside) / len(words) if words else 0.0, "spans": [{"label": x, "start": a, "end": b} for x, a, b in sorted(more, key=lambda s: (s[1], s[2], s[0]))],
                })
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], ["doc_id", *kinds])

    return narrow(docs, id_col, text_col).mapInArrow(run, COLUMNS)
