"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the kept positions of a fixed mask; the mask's other
positions may hold any word. The seeds of the benchmark items are joined with those of every
document; each hit fixes a diagonal, along which item and document are compared word by word.
Of the runs of the diagonal that are long and alike enough, the one with the most agreeing words
is reported, so substituted words are tolerated inside it.

The benchmark is the stated query set: it is taken in blocks of bounded size, one after the other,
each of which goes over all rows. Whatever its size, the driver and every task hold one block.

Short items, of under fourteen words, have masks of their own, cut from all their words: as many
parts as words may be changed and one more. One part is always whole, so none that is alike enough is
missed. Items of fewer than INSIDE_WORDS words say too little to be looked for inside texts, whatever
the masks: they match the documents that are that item and nothing else, word for word.

Defined results: null and empty texts, on either side, match nothing; a text of any length is taken
whole, by one task. Of the rows that repeat a (doc_id, item_id), or of its several texts, the best
run is reported: the most agreeing words, then the shortest, the leftmost, and the leftmost in the
item. Rows with a null doc_id or item_id are not one document or item: each is reported. Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import MULTIPLIER, U64, batch, bounded, hashed, mixed
from tidelane.operators.materialise import saved

#: Kept positions of each mask. Together they find every 14-word overlap with 2 words changed.
MASKS = ("111111", "11011011", "110010111", "1010110011")
#: Words that must agree, and their share of the run. Shorter items must agree in that share of all their words.
MIN_WORDS, MIN_IDENTITY = 10, 0.8
#: Words that an item has at least to be looked for inside texts, and from which on the masks are enough.
INSIDE_WORDS, LONG_WORDS = 5, 14
#: Bytes of benchmark text in a block, about.
BLOCK_BYTES = 8 << 20

FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("n_matched", pa.int64()), ("item_start", pa.int64()), ("item_words", pa.int64())])


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed of each window that the mask fits in."""
    m = len(words) - len(mask) + 1
    if m <= 0:
        return words[:0]
    h = np.full(m, np.uint64(int(mask, 2) + (len(mask) << 20)), dtype=U64)
    for i, kept in enumerate(mask):
        if kept == "1":
            h *= MULTIPLIER
            h += words[i : m + i]
    return mixed(h)


def least_matched(n: int, min_words: int, min_identity: float) -> int:
    """Words of an item of n words that must agree."""
    return min(min_words, -(-n * Fraction(min_identity).limit_denominator(1_000_000) // 1))


def own_masks(n: int, least: int) -> list[str]:
    """Masks as long as an item of n words, each of which keeps one part of it: one is whole whichever n - least words are changed."""
    ends = [round(k * n / (n - least + 1)) for k in range(n - least + 2)]
    return ["0" * a + "1" * (b - a) + "0" * (n - b) for a, b in zip(ends, ends[1:])]


def best_run(same: np.ndarray, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int]:
    """Start, end and agreeing words of the run with the most agreeing words among all in which their share is min_identity; the shortest, then leftmost.

    An agreeing word scores 1 - min_identity, another -min_identity, in whole numbers: a run's
    share is enough if its sum isn't negative. For each end the earliest such start has the most.
    """
    share = Fraction(min_identity).limit_denominator(1_000_000)
    sums = np.concatenate([[0], np.cumsum(np.where(same, share.denominator, 0) - share.numerator)])
    agreed = np.concatenate([[0], np.cumsum(same)])
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    matched = agreed - agreed[first]
    most = int(matched.max())
    if not most:
        return 0, 0, 0
    places = np.flatnonzero(same)  # the run with its outer changed words off
    tails = np.flatnonzero(matched == most)
    heads = places[agreed[first[tails]]]
    ends = places[agreed[tails] - 1] + 1
    k = int((ends - heads).argmin())
    return int(heads[k]), int(ends[k]), most


@dataclass
class SeedIndex:
    """The seeds of a block of items, sorted, with the item and place of each."""

    ids: list[int | None]
    items: list[np.ndarray]
    masks: tuple[str, ...] = MASKS
    min_words: int = MIN_WORDS
    min_identity: float = MIN_IDENTITY

    def __post_init__(self):
        whole: dict[bytes, list[int]] = {}
        own: dict[str, None] = {}  # the masks of short items
        all_, who, where = [], [], []
        for k, words in enumerate(self.items):
            n = len(words)
            masks = list(self.masks)
            if 0 < n < INSIDE_WORDS:
                whole.setdefault(words.tobytes(), []).append(k)
                continue
            if 0 < n < LONG_WORDS:
                masks += own_masks(n, least_matched(n, self.min_words, self.min_identity))
                own |= dict.fromkeys(masks[len(self.masks) :])
            for mask in masks:
                s = seeds(words, mask)
                all_.append(s), who.append(np.full(len(s), k)), where.append(np.arange(len(s)))
        self.own, self.whole = list(own), whole
        flat = np.concatenate(all_) if all_ else np.zeros(0, U64)
        order = np.argsort(flat, kind="stable")
        self.seed, self.who, self.where = flat[order], np.concatenate(who or [[]]).astype(np.int64)[order], np.concatenate(where or [[]]).astype(np.int64)[order]
        self.low = np.zeros(1 << 20, dtype=bool)  # most windows end at this table
        self.low[self.seed & U64((1 << 20) - 1)] = True

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each document with a seed that an item has, the distinct (item, diagonal); a diagonal is a place in `words`.

        Document d is words[bounds[d] : bounds[d + 1]]. Windows that cross documents are dropped. Seeds
        are told apart first; pairs are made for one document at a time.
        """
        found = []
        for mask in dict.fromkeys((*self.masks, *self.own)):
            s = seeds(words, mask)
            at = np.flatnonzero(self.low[(s & U64((1 << 20) - 1)).astype(np.int64)])
            left, right = np.searchsorted(self.seed, s[at], "left"), np.searchsorted(self.seed, s[at], "right")
            docs = np.searchsorted(bounds, at, "right") - 1
            real = (left < right) & (at + len(mask) <= bounds[docs + 1])
            found.append(np.column_stack([docs[real], at[real], left[real], right[real]]))
        seen = np.concatenate(found)
        seen = seen[np.argsort(seen[:, 0], kind="stable")]
        for own in np.split(seen, np.flatnonzero(np.diff(seen[:, 0])) + 1) if len(seen) else ():
            met: list[np.ndarray] = []
            for _, at, left, right in own.tolist():
                met.append((self.who[left:right] << 40) + (at - self.where[left:right]) + (1 << 39))
                if sum(map(len, met)) > 1_000_000:
                    met = [np.unique(np.concatenate(met))]
            pairs = np.unique(np.concatenate(met))
            yield int(own[0, 0]), np.column_stack([pairs >> 40, (pairs & (1 << 40) - 1) - (1 << 39)])

    def _likely(self, words: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, int]]:
        """The (item, diagonal) pairs, without those of short items in which too few words agree, counted for all diagonals of an item at once."""
        at = np.concatenate([[0], np.flatnonzero(np.diff(pairs[:, 0])) + 1, [len(pairs)]]).tolist()
        for a, b in zip(at[:-1], at[1:]):
            k, diagonals = int(pairs[a, 0]), pairs[a:b, 1]
            item = self.items[k]
            if len(item) < LONG_WORDS:
                place = diagonals[:, None] + np.arange(len(item))
                inside = (place >= ends[0]) & (place < ends[1])
                agree = ((words[np.clip(place, ends[0], ends[1] - 1)] == item) & inside).sum(axis=1)
                diagonals = diagonals[agree >= least_matched(len(item), self.min_words, self.min_identity)]
            yield from ((k, d) for d in diagonals.tolist())

    def overlaps(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Document, item, start, length and agreeing words of the best run, and its start in the item, where they overlap enough."""
        for doc, pairs in self.hits(words, bounds):
            best: dict[int, tuple[tuple[int, int], int, int, int, int]] = {}
            for k, diagonal in self._likely(words, bounds[doc : doc + 2], pairs):
                item = self.items[k]
                a, b = max(int(bounds[doc]), diagonal), min(int(bounds[doc + 1]), diagonal + len(item))
                same = words[a:b] == item[a - diagonal : b - diagonal]
                start, end, matched = best_run(same, self.min_identity)
                score = (matched, start - end)
                if matched >= least_matched(len(item), self.min_words, self.min_identity) and score > best.get(k, ((0, 0),))[0]:
                    best[k] = (score, a + start - int(bounds[doc]), end - start, matched, a + start - diagonal)
            yield from ((doc, k, *v[1:]) for k, v in best.items())
        for doc in np.flatnonzero(np.diff(bounds) < INSIDE_WORDS).tolist() if self.whole else ():
            own = words[bounds[doc] : bounds[doc + 1]]
            yield from ((doc, k, 0, len(own), len(own), 0) for k in self.whole.get(own.tobytes(), ()))


def _blocks(benchmark: DataFrame, block_bytes: int, *settings) -> Iterator[tuple[Broadcast, bool]]:
    """The items' ids and words, a block at a time, and whether more follow."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") > 0)
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for k in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        words = [h[a:b] for _, h, at in hashed(pa.array([r["text"] for r in rows], pa.string())) for a, b in zip(at, at[1:])]
        shared = benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], words, *settings))
        yield shared, k + 1 < n_blocks
        if k + 1 < n_blocks:
            shared.destroy()


def overlaps(documents: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The overlaps of documents with benchmark items: doc_id, item_id, start, n_words, n_matched, item_start, item_words.

    Places and lengths count words. One row for each document and item, with the best run.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for shared, more in _blocks(benchmark, block_bytes, masks, min_words, min_identity):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(*shared.value)
            for b in batches:
                out = {name: [] for name in FOUND.names}
                for first, words, bounds in hashed(b["text"]):
                    for doc, item, *run in index.overlaps(words, bounds):
                        for name, value in zip(FOUND.names, (b["doc_id"][first + doc].as_py(), index.ids[item], *run, len(index.items[item]))):
                            out[name].append(value)
                yield batch(FOUND, **out)

        block = bounded(docs).mapInArrow(scan, "doc_id long, item_id long, start long, n_words long, n_matched long, item_start long, item_words long")
        block = saved(block) if more else block
        found = block if found is None else found.unionByName(block)
    known = F.col("doc_id").isNotNull() & F.col("item_id").isNotNull()
    order = F.struct("n_matched", -F.col("n_words"), -F.col("start"), -F.col("item_start"), -F.col("item_words"))
    best = found.filter(known).groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*FOUND.names[2:]), order).alias("best"))
    return best.select("doc_id", "item_id", "best.*").unionByName(found.filter(~known))


def clean(documents: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, as they are, that overlap with no item; text must be a string column. Nothing is shuffled.

    A document that is one short item and nothing else goes, too.
    """
    for shared, more in _blocks(benchmark, block_bytes, masks, min_words, min_identity):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(*shared.value)
            for b in batches:
                sound = np.ones(b.num_rows, dtype=bool)
                for first, words, bounds in hashed(b["text"]):
                    for doc, *_ in index.overlaps(words, bounds):
                        sound[first + doc] = False
                yield b.filter(pa.array(sound))

        documents = bounded(documents).mapInArrow(keep, documents.schema)
        documents = saved(documents) if more else documents
    return documents
