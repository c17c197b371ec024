"""Operator 6: licence scans. Matching statistics from a generalised suffix automaton, chained into covered spans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lower, pieces, small_batches, utf8, word_hashes, word_table

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with {what}. If not, see http://www.gnu.org/licenses/"
#: Licence texts and the notices that their publishers give for use in files, by label.
TEXTS = (
    ("gpl", _GNU.format(what="This program", name="General Public License", version="3")),
    ("gpl", _GNU.format(what="This program", name="General Public License", version="2")),
    ("lgpl", _GNU.format(what="This library", name="Lesser General Public License", version="2.1")),
    ("lgpl", _GNU.format(what="This program", name="Lesser General Public License", version="3")),
    ("agpl", _GNU.format(what="This program", name="Affero General Public License", version="3")),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS),
    ("bsd", f"{_BSD} {_BSD_END}"),
    ("bsd", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
)
#: The licences' names in short notices, and their identifiers in file headers, by label.
NAMES = {
    "gpl": ("GNU General Public License",), "lgpl": ("GNU Lesser General Public License",), "agpl": ("GNU Affero General Public License",), "apache": ("Apache License, Version 2.0",), "mit": ("MIT License",), "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License"),
    "isc": ("ISC License",), "mpl": ("Mozilla Public License",), "boost": ("Boost Software License",), "zlib": ("zlib License",),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), "cc-by-nd": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
IDENTIFIERS = {
    "gpl": ("GPL-2.0", "GPL-3.0"), "lgpl": ("LGPL-2.1", "LGPL-3.0"), "agpl": ("AGPL-3.0",), "apache": ("Apache-2.0",), "mit": ("MIT",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "isc": ("ISC",), "mpl": ("MPL-2.0",), "boost": ("BSL-1.0",), "zlib": ("Zlib",), "unlicense": ("Unlicense",),
    "cc0": ("CC0-1.0",), "cc-by": ("CC-BY-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-nd": ("CC-BY-ND-4.0",),
}
#: How a short notice names a licence.
NOTICES = ("Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the terms of the {}", "This work is licensed under a {}")


def templates() -> list[tuple[str, str]]:
    """(label, text): the texts, the short notices of all names, and the identifiers' header lines."""
    short = [(label, notice.format(name)) for label, names in NAMES.items() for name in names for notice in NOTICES]
    return [*TEXTS, *short, *((label, f"SPDX-License-Identifier: {name}") for label, names in IDENTIFIERS.items() for name in names)]


#: A match of so many words opens a chain, or as many as the template has; a chain goes on over so many other words.
LONG, GAP = 5, 3
#: Templates of so many words, a notice with the licence's name, must be covered whole; of longer ones this share.
SHORT, COVER = 20, 0.6
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


class Automaton:
    """Generalised suffix automaton over the templates' word ids: states for all runs of words of any template."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, list[int]]] = [{}]  # where in each template a state's runs end
        for words in texts:
            last = 0
            for word in words:
                last = self._add(last, word)
        for k, words in enumerate(texts):  # all states are there, so that each prefix leads to its own
            state = 0
            for place, word in enumerate(words, 1):
                state = self.next[state][word]
                shorter = state
                while shorter > 0:
                    self.places[shorter].setdefault(k, []).append(place)
                    shorter = self.link[shorter]
        self.owners = [set(found) for found in self.places]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(dict(after))
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that `state` reaches by `word`, with runs just one word longer than its own."""
        to = self.next[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, self.link[to], self.next[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each word, the length of the longest run ending there that a template has, and its state."""
        state, length = 0, 0
        for word in words:
            while state > 0 and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield length, state


class Scanner:
    def __init__(self):
        names, texts = zip(*((label, self._words(text)) for label, text in templates()))
        phrases = [self._words(p) for p in PHRASES]
        vocabulary = sorted({w for t in [*texts, *phrases] for w in t})
        ids = {w: i for i, w in enumerate(vocabulary)}
        joined = " ".join(vocabulary).encode()
        data = np.frombuffer(joined, np.uint8)
        start, end, _ = word_table(data != 32, np.array([0, len(data)]))
        hashes = word_hashes(data, start, end)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.names, self.sizes = names, [len(t) for t in texts]
        self.automaton = Automaton([[ids[w] for w in t] for t in texts])
        self.phrases = [([ids[w] for w in p], label) for p, label in zip(phrases, PHRASES.values())]
        self.least = min([LONG, *self.sizes])

    @staticmethod
    def _words(text: str) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in text.lower()).split()

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of words, -1 for all others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def chain(self, words: list[int], start: int, chains: dict[int, list[list[int]]]) -> None:
        """Carry a document's chains [first word, end, words covered, place in the template] of each template on over
        its next run of vocabulary words.

        Matches that end where the next word's match isn't their continuation are the maximal ones.
        Each counts for the templates that have it, if it is long, or covers all of a short template. It goes
        on with the template's last chain if few words of any kind are between them and it stands in the
        template behind what the chain has; else it opens a chain.
        """
        stats = [*self.automaton.statistics(words)]
        for i, (length, state) in enumerate(stats):
            if i + 1 < len(stats) and stats[i + 1][0] == length + 1:
                continue
            for k, places in self.automaton.places[state].items():
                if length < min(LONG, self.sizes[k]):
                    continue
                first, end = start + i + 1 - length, start + i + 1
                if chains[k] and first <= chains[k][-1][1] + GAP:
                    last = chains[k][-1]
                    fresh = end - max(first, last[1])
                    at = bisect_left(places, last[3] + fresh)
                    if at < len(places):
                        last[1:] = end, last[2] + fresh, places[at]
                        continue
                chains[k].append([first, end, length, places[0]])

    def spans(self, chains: dict[int, list[list[int]]]) -> list[tuple[int, int, str, int]]:
        """(first word, end, label, words covered) of a document's chains that cover enough of their templates."""
        return [(a, b, self.names[k], n) for k, found in chains.items() for a, b, n, _ in found if n >= (1 if self.sizes[k] <= SHORT else COVER) * self.sizes[k]]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


class Union:
    """Disjoint intervals in order, as others are added."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start

    def add(self, start: int, end: int) -> None:
        low, high = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]


def _best(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Of spans that overlap, those that cover most words (several if they cover as many).

    Taken by words covered: a span stays if none that covers more meets it, which a union of these tells.
    """
    kept, larger = [], Union()
    for _, alike in groupby(sorted(set(spans), key=lambda s: -s[3]), key=lambda s: s[3]):
        alike = [*alike]
        kept += [s for s in alike if not larger.meets(s[0], s[1])]
        for s in alike:
            larger.add(s[0], s[1])
    return kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = scanner()
    for batch in pieces(batches):
        data, at = utf8(batch.column("text"))
        data = lower(data)
        inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
        start, end, first = word_table(inside, at)
        ids = tool.ids(word_hashes(data, start, end)) if len(start) else np.zeros(0, np.int64)
        doc = np.searchsorted(first[1:], np.arange(len(ids)), "right")
        places: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for phrase, label in tool.phrases:
            m = len(ids) - len(phrase) + 1
            if m > 0:
                hit = doc[:m] == doc[len(phrase) - 1 :]
                for j, word in enumerate(phrase):
                    hit &= ids[j : j + m] == word
                for i in np.flatnonzero(hit):
                    places[doc[i]].append((int(i - first[doc[i]]), label))
        chains: dict[int, dict[int, list[list[int]]]] = defaultdict(lambda: defaultdict(list))
        known = np.concatenate(([False], ids >= 0, [False]))
        new_doc = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        opens = np.flatnonzero(known[1:-1] & (~known[:-2] | new_doc))
        closes = np.flatnonzero(known[1:-1] & (~known[2:] | np.concatenate((new_doc[1:], [True])))) + 1 if len(doc) else opens
        enough = closes - opens >= tool.least
        for a, b in zip(opens[enough].tolist(), closes[enough].tolist()):
            tool.chain(ids[a:b].tolist(), a - int(first[doc[a]]), chains[doc[a]])
        count = np.diff(first)
        out: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for i in range(batch.num_rows):
            base, spans = places.get(i, ()), _best(tool.spans(chains.get(i, {})))
            covered = set().union(*(range(a, b) for a, b, _, _ in spans)) if spans else ()
            out["n_base"].append(len(base))
            out["first_word"].append(min((p for p, _ in base), default=None))
            out["last_word"].append(max((p for p, _ in base), default=None))
            out["base_labels"].append(",".join(sorted({label for _, label in base})))
            out["labels"].append(",".join(sorted({label for _, label in base} | {s[2] for s in spans})))
            out["score"].append(len(covered) / int(count[i]) if count[i] else 0.0)
            out["spans"].append(",".join(f"{label}:{a}:{b}" for a, b, label, _ in sorted(spans)))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": count.astype(np.int64), **{k: pa.array(v, {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64()}.get(k, pa.string())) for k, v in out.items()}})


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) -> base phrases, labels and template spans of each text.

    Null texts are empty: no words, no labels, score 0. The score is the share of a text's words that
    template spans cover. A plain map over the scan; the automaton has some thousand words. Words that
    no template has end every match, so only runs of vocabulary words are streamed through it, which
    changes no matching statistic; chains go on from run to run, forward in the template. A template's label
    counts where a chain covers all of a short template or COVER of a longer one: phrases that licences have in
    common, or share with other prose, name none. Templates that cover as many words of
    one place all give their labels. Equal rows give equal rows, null doc_ids stay null, other columns
    are never read, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
