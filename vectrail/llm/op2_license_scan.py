"""License scan: an exact set-similarity join of text blocks with license templates by containment.

Blocks are windows of words that begin at every half of their length. A template's blocks have a power of two of words, at
least twice its own, so that any passage of its length and one word more lies whole in one of them, however long the template is:
templates may be notices or whole license texts. A block matches a template when it holds at least the threshold's share of
the template's distinct words. Template words are put in order of their frequency in the whole corpus, rarest first; a block
that holds o words of a template of n words must hold one of its first n - o + 1, so only blocks with such a prefix word
are looked at (prefix filter), those with too few template words are dropped (length filter), as are those whose words after
the common one cannot reach o (positional filter). What is left is counted exactly.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import LOWER, map_batches, null_safe_text, row_chunks, runs, table, text_buffers, word_hash

LEAST_BLOCK = 64
THRESHOLD = 0.85
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = THRESHOLD
    phrase: bool = False  #: its words must stand one after the other

    @property
    def words(self) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), self.text))

    @property
    def block(self) -> int:
        """Words of a block that this template is looked for in."""
        return max(LEAST_BLOCK, 1 << (2 * len(self.words) - 1).bit_length())


# The phrases and their labels.
PHRASES = (Template("mit", "under the mit license", 1.0, True), Template("apache-2", "apache license version 2", 1.0, True), Template("cc-by-nc", "cc by nc", 1.0, True))
# Notices, and license texts without their names and dates.
NOTICES = (
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "this work is licensed under a creative commons attribution international license"),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced or transmitted in any form"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
# Whole license texts.
LICENSES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or "
        "altered from any source distribution.",
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
)
TEMPLATES = PHRASES + NOTICES + LICENSES


def hash_words(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return word_hash(data, ends - [len(w) for w in words], ends)


def vocabulary(templates) -> tuple[list[bytes], np.ndarray]:
    words = sorted({w.encode() for t in templates for w in t.words})
    h = hash_words(words)
    order = np.argsort(h)
    return [words[i] for i in order], h[order]


def scan_words(data: np.ndarray, cuts: np.ndarray, known: np.ndarray):
    """(starts, index of the known word or -1) of the words of lower-cased texts laid end to end."""
    low = LOWER[data]
    starts, ends = runs(WORD[low], cuts)
    h = word_hash(low, starts, ends)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return starts, np.where(known[at] == h, at, -1)


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> list[int]:
    """How often each word of the vocabulary stands in all the texts; a count for each task and word is shuffled."""
    words, known = vocabulary(templates)

    def run(batches):
        counts = np.zeros(len(words), np.int64)
        for b in batches:
            offsets, data = text_buffers(b.column(0))
            for lo, hi in row_chunks(offsets):
                base = offsets[lo]
                _, ids = scan_words(data[base : offsets[hi]], offsets[lo : hi + 1] - base, known)
                counts += np.bincount(ids[ids >= 0], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(counts)], ["w", "n"])

    got = dict(map_batches(null_safe_text(docs), run, "w long, n long").groupBy("w").agg(F.sum("n")).collect())
    return [got.get(i, 0) for i in range(len(words))]


class Matcher:
    """Templates with their words in global order, and the inverted index of their prefixes."""

    def __init__(self, templates, frequencies: list[int]):
        self.templates = templates
        self.words, self.known = vocabulary(templates)
        name = {w: i for i, w in enumerate(self.words)}
        order = sorted(range(len(self.words)), key=lambda i: (frequencies[i], self.words[i]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.sets, self.need, self.seq, self.block = [], [], [], []
        index: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(templates):
            seq = [name[w.encode()] for w in template.words]
            self.block.append(template.block)
            ranked = sorted({int(self.rank[i]) for i in seq})
            need = max(1, math.ceil(template.threshold * len(ranked) - 1e-9))
            self.sets.append(frozenset(ranked))
            self.need.append(need)
            self.seq.append(np.array(seq))
            for place, r in enumerate(ranked[: len(ranked) - need + 1]):
                index.setdefault(r, []).append((t, place))
        self.index = index
        self.prefix = np.zeros(len(self.words), bool)
        self.prefix[[int(np.nonzero(self.rank == r)[0][0]) for r in index]] = True

    def document(self, ids: np.ndarray) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(places of phrases, best containment of each label) in a document, given its words' vocabulary numbers."""
        seen = np.nonzero(ids >= 0)[0]
        places, best, tried, looked = set(), {}, set(), set()
        blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # by size and number: places and ranks of its words

        def block_at(size: int, number: int):
            if (size, number) not in blocks:
                lo = number * size // 2
                inside = seen[np.searchsorted(seen, lo) : np.searchsorted(seen, lo + size)]
                blocks[size, number] = inside, np.unique(self.rank[ids[inside]])
            return blocks[size, number]

        for p in seen[self.prefix[ids[seen]]].tolist():
            r = int(self.rank[ids[p]])
            for t, place in self.index[r]:
                need, size, words = self.need[t], len(self.sets[t]), self.block[t]
                half = p // (words // 2)
                for number in {max(0, half - 1), half}:
                    if (number, t) in tried or (number, t, r) in looked:
                        continue
                    looked.add((number, t, r))
                    inside, held = block_at(words, number)
                    j = int(np.searchsorted(held, r))
                    if len(held) < need or len(self.sets[t].intersection(held[:j].tolist())) + 1 + min(size - place - 1, len(held) - j - 1) < need:
                        continue
                    tried.add((number, t))
                    overlap = len(self.sets[t].intersection(held.tolist()))
                    if overlap < need:
                        continue
                    if self.templates[t].phrase:
                        seq = self.seq[t]
                        for a in inside[ids[inside] == seq[0]].tolist():
                            if np.array_equal(ids[a : a + len(seq)], seq):
                                places.add((a, t))
                    else:
                        label = self.templates[t].label
                        best[label] = max(best.get(label, 0.0), overlap / size)
        return sorted(places), best


SCHEMA = "doc_id long, n_words long, places array<struct<word:long,label:string>>, labels map<string,double>"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, labels): every place of a phrase, and each label with its best containment.

    docs needs doc_id and text; a null text is an empty one, without words, places or labels. Repeated rows have equal
    results, an empty table gives no row, texts are read whole, however long, and other columns are not read.
    """
    frequencies = word_frequencies(docs, templates)

    def run(batches):
        m = Matcher(templates, frequencies)
        for b in batches:
            offsets, data = text_buffers(b.column(1))
            n_words = np.zeros(b.num_rows, np.int64)
            places, labels = [[]] * b.num_rows, [[]] * b.num_rows
            for lo, hi in row_chunks(offsets):
                cuts = offsets[lo : hi + 1] - offsets[lo]
                starts, ids = scan_words(data[offsets[lo] : offsets[hi]], cuts, m.known)
                first = np.searchsorted(starts, cuts)
                n_words[lo:hi] = np.diff(first)
                some = np.nonzero(ids >= 0)[0]
                some = some[m.prefix[ids[some]]]
                for k in np.unique(np.searchsorted(first, some, "right") - 1).tolist():
                    found, best = m.document(ids[first[k] : first[k + 1]])
                    best |= {m.templates[t].label: 1.0 for _, t in found}
                    places[lo + k] = [{"word": a, "label": m.templates[t].label} for a, t in found]
                    labels[lo + k] = sorted(best.items())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), pa.array(labels, pa.map_(pa.string(), pa.float64()))], ["doc_id", "n_words", "places", "labels"])

    return map_batches(null_safe_text(docs, "doc_id"), run, SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    r = scan(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    word = F.col("places.word")
    return r.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.map_keys("labels")).alias("labels"),
        F.coalesce(F.array_max(F.map_values("labels")), F.lit(0.0)).alias("score"),
    )
