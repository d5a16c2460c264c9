"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' word pairs are hashed, and of each run of neighbouring hashes the least is kept
(winnowing); an inverted index maps these fingerprints to templates and places. Every word pair of a
document is looked up. How many hashes a run has follows from the words that may be changed: a
template that is alike enough has somewhere so many words in a row unchanged that one of its
fingerprints is whole. Hits of a template on nearby diagonals are a candidate, if they are half as
many as changes alone must leave; its stretch of the document is aligned with the whole template in a
band around those diagonals, all candidates of a template at once. Reported are the share of the
template's words that the alignment matches, and the stretch from the first to the last of them.

The templates are parameters; their index is broadcast, the documents are read once and nothing
is shuffled.

Defined results: null and empty texts match nothing; a text of any length is taken whole, by one
task; repeated rows are reported each; an empty table gives no rows; a null doc_id stays null; extra
columns are ignored. A template without words is nowhere, one of a single word wherever that word
is. Overlapping stretches of one template are reported once: the most matched words, then the shortest,
then the leftmost; different templates are reported side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import MULTIPLIER, U64, batch, bounded, mixed, placed_words, text_chunks

#: Words of a fingerprint, hashes of a run at most, diagonals that are near, and the share of a template's words that must match, in percent.
GRAM, WINNOW, BAND, MIN_COVERAGE = 2, 4, 8, 80
#: What an alignment gains by a matched word and loses by a changed, missing or added one.
GAIN, LOSS = 3, 1
#: Notices as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
_plain = np.where(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), np.arange(256), 32).astype(np.uint8)

FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("template_words", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    m = max(len(words) - size + 1, 0)
    h = np.full(m, size, dtype=U64)
    for i in range(size):
        h *= MULTIPLIER
        h += words[i : m + i]
    return mixed(h)


def winnowed(hashes: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the fingerprints: of each run of `window` hashes the least, the last if several are equal."""
    window = min(window, len(hashes))
    return sorted({i + window - 1 - int(hashes[i : i + window][::-1].argmin()) for i in range(len(hashes) - window + 1)}) if window else []


def needed(n: int) -> int:
    """Words of a template of n that must match."""
    return -(-n * MIN_COVERAGE // 100)


def aligned(template: np.ndarray, words: np.ndarray, centre: np.ndarray, low: np.ndarray, high: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole template aligned with each of many stretches of words: matched words, first matched word, and the word after the last.

    Stretch c is words[low[c] : high[c]]; template word i lies within `band` of centre[c] + i. The
    alignment with the most points counts, of equal ones that which ends first.
    """
    n_c, width = len(centre), 2 * band + 1
    least = -(1 << 28)
    column = np.arange(width)
    score, matched = np.zeros((n_c, width), np.int64), np.zeros((n_c, width), np.int64)
    first, last = np.full((n_c, width), -1), np.full((n_c, width), -1)
    line = np.arange(n_c)[:, None]

    def moved(x: np.ndarray, fill: int) -> np.ndarray:
        """What stands above in the same place of the text: one column to the right."""
        return np.concatenate([x[:, 1:], np.full((n_c, 1), fill)], axis=1)

    for i, word in enumerate(template):
        at = centre[:, None] + i - band + column
        inside = (at >= low[:, None]) & (at < high[:, None])
        same = inside & (words[np.clip(at, 0, len(words) - 1)] == word)
        across = np.where(same, score + GAIN, np.where(inside, score - LOSS, least))
        missing = moved(score, least) - LOSS
        skip = missing > across
        score = np.where(skip, missing, across)
        hit = same & ~skip
        matched = np.where(skip, moved(matched, 0), matched + hit)
        first, last = np.where(skip, moved(first, -1), first), np.where(skip, moved(last, -1), last)
        first, last = np.where(hit & (first < 0), at, first), np.where(hit, at + 1, last)
        # Added words: the best start to the left, less a loss for each word passed.
        reach = np.maximum.accumulate(score + LOSS * column, axis=1)
        start = np.maximum.accumulate(np.where(score + LOSS * column == reach, column, 0), axis=1)
        score = reach - LOSS * column
        matched, first, last = matched[line, start], first[line, start], last[line, start]
    best = score.argmax(axis=1)
    own = np.arange(n_c)
    return matched[own, best], first[own, best], last[own, best]


class TemplateIndex:
    """Fingerprints of all templates, by their size, with the template and place of each."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words, self.least_hits, self.near = [], [], []
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for k, text in enumerate(templates.values()):
            words = plain_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
            n = len(words)
            changed = n - needed(n)
            run = max(1, (n - changed) // (changed + 1))  # so many words in a row are unchanged at least
            size = min(GRAM, run)
            hashes = grams(words, size)
            places = winnowed(hashes, max(1, min(WINNOW, run - size + 1)))
            entries.setdefault(size, []).extend((int(hashes[p]), k, p) for p in places)
            self.words.append(words)
            self.least_hits.append(max(1, (len(places) - size * changed) // 2))
            self.near.append(max(1, min(BAND, n // 2)))  # a short notice may follow itself
        self.prints = {}
        for size, found in entries.items():
            found.sort()
            self.prints[size] = np.array([h for h, _, _ in found], U64), np.array([k for _, k, _ in found], np.int64), np.array([p for _, _, p in found], np.int64)
        self.least_hits, self.near = np.array(self.least_hits, np.int64), np.array(self.near, np.int64)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (template, document, diagonal) of what may be a template; a diagonal is a place in `words`."""
        hits = [np.zeros((0, 3), np.int64)]
        for size, (known, template, place) in self.prints.items():
            hashes = grams(words, size)
            left, right = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            at = np.flatnonzero(left < right)
            doc = np.searchsorted(bounds, at, "right") - 1
            real = at + size <= bounds[doc + 1]
            at, doc = at[real], doc[real]
            n = right[at] - left[at]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[at], n)
            hits.append(np.stack([template[entry], np.repeat(doc, n), np.repeat(at, n) - place[entry]], axis=1))
        hits = np.concatenate(hits)
        hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
        if not len(hits):
            return hits
        group = np.concatenate([[0], np.cumsum((hits[1:, :2] != hits[:-1, :2]).any(axis=1))])
        span = int(hits[:, 2].max() - hits[:, 2].min()) + 2 * BAND + 2
        line = group * span + hits[:, 2] - hits[:, 2].min()
        near = self.near[hits[:, 0]]
        end = np.searchsorted(line, line + near, "right")
        count = end - np.arange(len(line))
        out, free = [], -1
        for k in np.flatnonzero(count >= self.least_hits[hits[:, 0]]).tolist():
            if k < free:
                continue
            best = k + int(count[k : end[k]].argmax())  # the fullest window that begins in this one
            out.append((hits[k, 0], hits[k, 1], (hits[best, 2] + hits[end[best] - 1, 2]) // 2))
            free = best + 1 if best > k else int(end[k])
        return np.array(out, np.int64).reshape(-1, 3)

    def found(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Document, template, matched words, first word and the word after the last of each stretch that covers enough of a template."""
        out = []
        may_be = self.candidates(words, bounds)
        for k in np.unique(may_be[:, 0]).tolist():
            own = may_be[may_be[:, 0] == k]
            low, high = bounds[own[:, 1]], bounds[own[:, 1] + 1]
            matched, first, last = aligned(self.words[k], words, own[:, 2], low, high, 2 * int(self.near[k]))
            enough = np.flatnonzero(matched >= needed(len(self.words[k])))
            stretches = sorted(zip(own[enough, 1].tolist(), (-matched[enough]).tolist(), (last - first)[enough].tolist(), first[enough].tolist(), last[enough].tolist()))
            taken: dict[int, list[tuple[int, int]]] = {}
            for doc, less, _, start, end in stretches:
                mine = taken.setdefault(doc, [])
                if all(end <= x or start >= y for x, y in mine):
                    mine.append((start, end))
                    out.append((doc, k, -less, start, end))
        return sorted(out, key=lambda f: (f[0], f[3], f[1]))


def plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits: hashes, bounds of each text's, first byte, byte after."""
    return placed_words(_plain[data], bounds)


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, matched_words, template_words, start_byte, end_byte of every stretch found."""
    shared = documents.sparkSession.sparkContext.broadcast(templates or TEMPLATES)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(shared.value)
        for b in batches:
            ids, out = b["doc_id"].to_pylist(), []
            for row, data, bounds in text_chunks(b["text"]):
                words, at, first, after = plain_words(data, bounds)
                for d, k, matched, start, end in index.found(words, at):
                    n = len(index.words[k])
                    out.append((ids[row + d], index.names[k], matched / n, matched, n, int(first[start] - bounds[d]), int(after[end - 1] - bounds[d])))
            yield batch(FOUND, **{n: [r[i] for r in out] for i, n in enumerate(FOUND.names)})

    return bounded(docs).mapInArrow(look, "doc_id long, license string, coverage double, matched_words long, template_words long, start_byte long, end_byte long")
