"""Licence scans with a generalised suffix automaton.

The tokens of all licence templates form one suffix automaton. A file's tokens are
streamed through it; after each token the automaton gives the longest stretch that
ends there and stands in some template, and where (matching statistics). Templates that
hold only a later part of that stretch are met by the automaton's suffix links, so every
template gets all its own longest stretches, whichever others hold longer ones.
Stretches are chained, per template, in the order of file and template, and a chain
that covers enough of a template is a span of that licence. Phrases of a fixed list
are found by their words.

Defined cases: a null or empty text has no words, a score of 0 and no labels;
repeated rows and ties give the same result each; a null id passes through; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import in_batches, whole

#: Words after A-Z are lower-cased: no ASCII other than letters and digits. UTF-8 bytes above 127 all belong to words.
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_AS_IS = (
    "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_END = f"THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS {_AS_IS}"

#: Openings and notices of well-known licences, and the short licences whole. Longer texts are handed in.
TEMPLATES = (
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    (
        "apache-notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("rights-reserved", "All rights reserved"),
    (
        "cc-notice",
        "This work is licensed under a Creative Commons Attribution International License",
    ),
    (
        "mit-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-full",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("bsd-2-full", f"{_BSD} {_BSD_END}"),
    ("bsd-3-full", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    (
        "apache-notice-full",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "lgpl-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version",
    ),
    (
        "agpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    (
        "mpl-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)

#: Stretches below this number of words don't count, unless they are a whole template.
LEAST_STRETCH = 3
#: Part of a template that a chain must cover.
LEAST_COVER = 0.7
#: Words of the file that may lie between two stretches of a chain.
MOST_GAP = 5


def words(text: str) -> list[bytes]:
    return WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """Generalised suffix automaton of token lists.

    Every state keeps the places (template, end) of its longest string, so that a
    stretch tells where it stands in each template.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((which, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state] if self.link[state] else set()
        #: by state and template, where the state's strings end
        self.places: list[dict[int, list[int]]] = [{} for _ in self.ends]
        for state, ends in enumerate(self.ends):
            for which, place in sorted(ends):
                self.places[state].setdefault(which, []).append(place)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, origin: int, state: int, token: int) -> int:
        copy = self._state(self.length[origin] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = copy
        while origin >= 0 and self.next[origin].get(token) == state:
            self.next[origin][token] = copy
            origin = self.link[origin]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # another template has gone this way
            state = self.next[last][token]
            return state if self.length[state] == self.length[last] + 1 else self._clone(last, state, token)
        new = self._state(self.length[last] + 1, {}, 0)
        origin = last
        while origin >= 0 and token not in self.next[origin]:
            self.next[origin][token] = new
            origin = self.link[origin]
        if origin >= 0:
            state = self.next[origin][token]
            self.link[new] = state if self.length[state] == self.length[origin] + 1 else self._clone(origin, state, token)
        return new

    def statistics(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        """After each token: the state and length of the longest stretch that ends there."""
        state, length = 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length


class Scanner:
    """Templates as token lists with their automaton."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.labels = [label for label, _ in templates]
        self.vocabulary: dict[bytes, int] = {}
        lists = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)] for _, text in templates]
        self.sizes = [len(x) for x in lists]
        self.least = min(LEAST_STRETCH, min(self.sizes, default=LEAST_STRETCH))
        self.least_of = [min(LEAST_STRETCH, size) for size in self.sizes]
        self.automaton = SuffixAutomaton(lists)
        self.met = self._met()
        self.phrases = [(words(phrase), label) for phrase, label in phrases]
        self.by_last: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in self.phrases:
            self.by_last.setdefault(phrase[-1], []).append((phrase, label))

    def base(self, tokens: list[bytes]) -> list[tuple[int, str]]:
        """Start and label of every place of a phrase."""
        found = []
        for last, phrases in self.by_last.items():
            at = -1
            while True:
                try:
                    at = tokens.index(last, at + 1)
                except ValueError:
                    break
                for phrase, label in phrases:
                    start = at - len(phrase) + 1
                    if start >= 0 and tokens[start : at + 1] == phrase:
                        found.append((start, label))
        return found

    def _met(self) -> list[dict[int, int]]:
        """By state: the templates met in its strings, each with the first state on the way of suffix links that has it.

        A template stays out where its part is below its least stretch.
        """
        auto = self.automaton
        out: list[dict[int, int]] = [{} for _ in auto.next]
        for state in sorted(range(1, len(auto.next)), key=lambda s: auto.length[s]):
            above = out[auto.link[state]] if auto.link[state] > 0 else {}
            own = {w: state for w in auto.places[state] if auto.length[state] >= self.least_of[w]}
            out[state] = above | own if own else above
        return out

    def stretches(self, tokens: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """``(end, length, state, template)`` of each template's stretches that can't be lengthened; ends are exclusive."""
        known = self.vocabulary.get
        ids = [known(w, -1) for w in tokens]
        run: list[int] = []
        for end, token in enumerate([*ids, -1]):
            if token >= 0:
                run.append(token)
                continue
            if run:
                if len(run) >= self.least:
                    yield from self._of_run(end - len(run), run)
                run = []

    def _of_run(self, first: int, run: list[int]) -> Iterator[tuple[int, int, int, int]]:
        before: dict[int, tuple[int, int]] = {}
        lengths = self.automaton.length
        for k, (state, length) in enumerate(self.automaton.statistics(run)):
            now: dict[int, tuple[int, int]] = {}
            if length >= self.least:
                for which, holder in self.met[state].items():
                    # the whole match where the state itself has the template, else the longest string of the holder
                    found = length if holder == state else lengths[holder]
                    if found >= self.least_of[which]:
                        now[which] = (holder, found)
            for which, (holder, found) in before.items():
                if now.get(which, (0, 0))[1] != found + 1:
                    yield first + k, found, holder, which
            before = now
        for which, (holder, found) in before.items():
            yield first + len(run), found, holder, which

    def spans(self, tokens: list[bytes]) -> list[tuple[int, int, str, float]]:
        """Covered template spans: ``(start, end, label, covered part)``."""
        going: dict[int, list[list[int]]] = {}
        ended: list[tuple[int, list[int]]] = []
        for end, length, state, which in self.stretches(tokens):
            first = end - length
            own = going.get(which, [])
            # a chain ends where the file has gone on too far
            ended += ((which, c) for c in own if first - c[1] > MOST_GAP)
            own = going[which] = [c for c in own if first - c[1] <= MOST_GAP]
            new: list[list[int]] = []
            for place in self.automaton.places[state][which]:
                # it goes on where both file and template go on; of those that can, the fullest does
                ready = [c for c in own if c[1] <= first and c[3] <= place - length]
                best = max(ready, key=lambda c: c[2], default=None)
                if best is None:
                    new.append([first, end, length, place])
                else:
                    best[1], best[2], best[3] = end, best[2] + length, place
            own += new
        ended += ((which, c) for which, own in going.items() for c in own)
        return sorted(
            (c[0], c[1], self.labels[which], c[2] / self.sizes[which])
            for which, c in ended
            if c[2] >= LEAST_COVER * self.sizes[which]
        )


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<start:long,end:long,label:string,cover:double>>"
)


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Phrase places, template spans and labels of every row. ``score`` is the best covered part, 1 with a phrase."""
    in_batches(docs.sparkSession)

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                tokens = words(text)
                base = scanner.base(tokens)
                spans = scanner.spans(tokens)
                starts = [start for start, _ in base]
                base_labels = {label for _, label in base}
                rows.append(
                    (
                        doc,
                        len(tokens),
                        len(base),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base_labels)),
                        ",".join(sorted(base_labels | {s[2] for s in spans})),
                        1.0 if base else min(1.0, max((s[3] for s in spans), default=0.0)),
                        [{"start": a, "end": b, "label": label, "cover": cover} for a, b, label, cover in spans],
                    )
                )
            out = pd.DataFrame(
                rows,
                columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )
            for name in ("doc_id", "first_word", "last_word"):
                out[name] = out[name].astype("Int64")
            yield out

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return source.mapInPandas(scanned, RESULT)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.drop("spans")
