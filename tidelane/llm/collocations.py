"""Frequent phrases by compressed position bitmaps, and their scores.

Texts are cut into pieces and pieces into words, and dealt into parts, the shards. In a part every
word has a place; a place stands empty after each piece, so that no phrase runs on across it. A
word's bitmap keeps its places, 8 to a block, and only the blocks that have any. A phrase's bitmap
marks the places of its last word: shifted by one, a bit may carry into the next block, and ANDed
with a word's bitmap, it is that of the phrase one word longer; its popcount is the phrase's count
in the part. Phrases are extended depth-first, a group of first words at a time, down to the
greatest length before the next group.

Counts must reach a minimum over all parts. Parts send their phrases' popcounts to buckets by the
phrase's hash; a bucket adds them up and answers each part with those that suffice. Four rounds
follow one another: words, pairs, triples, and all longer phrases together. A round goes
depth-first through what the rounds before have left, so that only phrases whose shorter beginnings
and endings all suffice are counted. At the end, of the parts that have a phrase the one with the
least number gives it with its words and its sum.

Scores, cuts and containments are joins over the phrases found: a phrase is dropped if one that is a
word longer, at its beginning or end, has its count, as any longer phrase of that count has such a
phrase between.

Words and phrases are known by 64-bit hashes with their lang's until they are given out as text.

Defined results: a null text is empty and a null lang is 'und'; pieces without words count nothing;
a text of any length is taken whole, by one task; repeated rows and ids count each, as no id is
looked at; equal scores go to the larger count, then to the smaller phrase in UTF-8 order, equal cuts
to the shorter first part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.common import MULTIPLIER, U64, distinct, given_back, mixed, numbered, placed_words, text_chunks
from tidelane.llm.dealing import PART_BYTES, dealt, n_parts, text_bytes, unpacked_rows
from tidelane.operators.materialise import saved

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes that part words, those that also end a piece among them: blank and tab; . , ; : ! ? and the line breaks.
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = PIECE_ENDS.copy()
GAPS[[0x20, 0x09]] = True
#: Places in a block of a bitmap, and entries that a step of an extension looks at, about.
PLACES, STEP = 8, 1 << 20
#: Shares of a lang's phrases that are ranked apart at first.
SHARES = 64

MESSAGE_DDL = "bucket int, part int, payload binary"
MESSAGE = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
ANSWER_DDL = "part int, length int, payload binary"
ANSWER = pa.schema([("part", pa.int32()), ("length", pa.int32()), ("payload", pa.binary())])
FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])
FOUND_DDL = "lang string, phrase string, words int, a long"


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that what is alike lies together and compresses away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()


def message(keys: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> bytes:
    """Phrases' hashes, lengths and popcounts, by rising hash."""
    return struct.pack("<I", len(keys)) + planes(keys) + lengths.astype(np.uint8).tobytes() + planes(counts)


def read_message(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    return from_planes(data, n, 4), np.frombuffer(data, np.uint8, n, 4 + 8 * n), from_planes(data, n, 4 + 9 * n)


class Known:
    """Phrases of one length that suffice over all parts: rising hashes, and sums for those that this part gives out."""

    def __init__(self, answers: list[bytes]):
        got = [read_message(x) for x in answers]
        keys = np.concatenate([np.zeros(0, U64), *(k for k, _, _ in got)])
        order = np.argsort(keys)
        self.keys, self.sums = keys[order], np.concatenate([np.zeros(0, U64), *(c for _, _, c in got)])[order]

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, k, -1)


def phrase_keys(tokens: np.ndarray) -> np.ndarray:
    """A hash of each row of words' hashes."""
    h = np.full(len(tokens), U64(tokens.shape[1]))
    for k in range(tokens.shape[1]):
        h = mixed(h * MULTIPLIER + tokens[:, k])
    return h


class Places:
    """The words of a part's texts: hash, lang and place of each, and where its text lies."""

    def __init__(self, packed: list[bytes]):
        tokens, places, langs, where = [], [], [], []
        self.texts: list[np.ndarray] = []
        self.langs: list[str] = []
        known: dict[str, int] = {}
        next_place = 0
        for rows in map(unpacked_rows, packed):
            of_rows = np.array([known.setdefault(x, len(known)) for x in rows["lang"].to_pylist()], np.int32)
            for row, data, bounds in text_chunks(rows["text"]):
                words, at, starts, ends = placed_words(data, bounds, GAPS)
                n = len(words)
                if not n:
                    continue
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
                ended = np.concatenate([np.zeros(1, np.int64), np.cumsum(PIECE_ENDS[data])])
                new_piece = np.ones(n, bool)
                new_piece[1:] = (doc[1:] != doc[:-1]) | (ended[starts[1:]] > ended[ends[:-1]])
                place = next_place + np.arange(n) + np.cumsum(new_piece)
                next_place = int(place[-1]) + 1
                lang = of_rows[row + doc]
                tokens.append(words), places.append(place), langs.append(lang)
                where.append(np.stack([np.full(n, len(self.texts)), starts, ends]))
                self.texts.append(data)
        self.langs = list(known)
        salts = np.array([hash_of(x) for x in self.langs], U64)
        none = np.zeros(0, np.int64)
        self.lang = np.concatenate([none, *langs]).astype(np.int64)
        self.tokens = np.concatenate([none.view(U64), *tokens])
        if len(salts):
            self.tokens = mixed(self.tokens ^ salts[self.lang])
        self.place = np.concatenate([none, *places])
        self.where = np.concatenate([np.zeros((3, 0), np.int64), *where], axis=1)

    def word(self, k: int) -> str:
        text, start, end = self.where[:, k].tolist()
        raw = self.texts[text][start:end].tobytes().decode("utf-8", "replace")
        return raw.translate(LOWER)


LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def hash_of(lang: str) -> int:
    data = np.frombuffer(b"\x00" + lang.encode(), np.uint8)
    h = np.zeros(1, U64)
    for byte in data.tolist():
        h = mixed(h * MULTIPLIER + U64(byte + 1))
    return int(h[0])


class Bitmaps:
    """Compressed bitmaps of a part's words of a set: entries (word, block, bits), by word and by block."""

    def __init__(self, places: Places, words: Known):
        tokens, number = distinct(places.tokens) if len(places.tokens) else (places.tokens, places.tokens.view(np.int64))
        at = words.at(phrase_keys(tokens[:, None]))
        known = at >= 0
        self.used, self.tokens, self.n_words = at[known], tokens[known], int(known.sum())
        word = np.where(known, np.cumsum(known) - 1, -1)[number]
        kept = np.flatnonzero(word >= 0)
        word, place = word[kept], places.place[kept]
        self.first = np.zeros(self.n_words, np.int64)
        self.first[word[::-1]] = kept[::-1]  # the first place of a word is written last
        block, bit = place // PLACES, (1 << (place % PLACES)).astype(np.uint32)
        key = block * max(1, self.n_words) + word
        order, rank = _sorted(key)
        new = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])[: len(rank)])
        key = key[order[new]]
        self.block, self.word = (x.astype(np.int32) for x in np.divmod(key, max(1, self.n_words)))
        self.bits = np.bitwise_or.reduceat(bit[order], new) if len(new) else np.zeros(0, np.uint32)
        self.n_blocks = int(self.block[-1]) + 2 if len(new) else 0
        self.start = np.searchsorted(self.block, np.arange(self.n_blocks + 1)).astype(np.int32)
        self.by_word = _sorted(self.word)[0]
        self.word_start = np.concatenate([[0], np.cumsum(np.bincount(self.word, minlength=self.n_words))])

    def groups(self, step: int = STEP) -> Iterator[Phrases]:
        """All words as phrases of one word, in groups whose extension looks at about `step` entries."""
        per_block = max(1.0, len(self.block) / max(1, self.n_blocks))
        first = 0
        while first < self.n_words:
            last = max(first + 1, int(np.searchsorted(self.word_start, self.word_start[first] + step / per_block, "right")) - 1)
            own = self.by_word[self.word_start[first] : self.word_start[last]]
            yield Phrases(self, np.arange(first, last)[:, None], self.word[own] - first, self.block[own], self.bits[own])
            first = last


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """numbered() of keys that are not negative."""
    return numbered(key.astype(U64), max(1, int(key.max(initial=0)).bit_length()))


def _told_apart(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising distinct keys, and the place of each row's key among them."""
    order, rank = _sorted(key)
    number = np.empty(len(key), np.int64)
    number[order] = rank
    return key[order[np.concatenate([[True], rank[1:] != rank[:-1]])[: len(key)]]], number


class Phrases:
    """Phrases of one length, as rows of words, with the entries of their bitmaps: the places of their last words."""

    def __init__(self, bitmaps: Bitmaps, words: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.bitmaps, self.words, self.phrase, self.block, self.bits = bitmaps, words, phrase, block, bits

    def counts(self) -> np.ndarray:
        return np.bincount(self.phrase, np.bitwise_count(self.bits), len(self.words)).astype(np.int64)

    def keys(self, last: int | None = None) -> np.ndarray:
        """Hashes of the phrases, or of their last words."""
        return phrase_keys(self.bitmaps.tokens[self.words if last is None else self.words[:, -last:]])

    def only(self, kept: np.ndarray) -> Phrases:
        number = np.cumsum(kept) - 1
        entry = kept[self.phrase]
        return Phrases(self.bitmaps, self.words[kept], number[self.phrase[entry]], self.block[entry], self.bits[entry])

    def extended(self) -> Phrases:
        """All phrases one word longer that occur: bitmaps shifted by a place, a carry going to the next block, and ANDed with the words'."""
        b = self.bitmaps
        wide = self.bits << np.uint32(1)
        carry = wide >> np.uint32(PLACES) > 0
        phrase = np.concatenate([self.phrase, self.phrase[carry]])
        block = np.concatenate([self.block, self.block[carry] + 1])
        bits = np.concatenate([wide & np.uint32((1 << PLACES) - 1), wide[carry] >> np.uint32(PLACES)])
        first = b.start[block]
        n = b.start[block + 1] - first
        row = np.repeat(np.arange(len(block), dtype=np.int32), n)
        entry = np.arange(len(row), dtype=np.int32) + (first - (np.cumsum(n, dtype=np.int32) - n))[row]
        both = bits[row] & b.bits[entry]
        hit = np.flatnonzero(both)
        row, entry, both = row[hit], entry[hit], both[hit]
        key = phrase[row].astype(np.int64) * max(1, b.n_words) + b.word[entry]
        found, number = _told_apart(key)
        words = np.concatenate([self.words[found // max(1, b.n_words)], (found % max(1, b.n_words))[:, None]], axis=1)
        return Phrases(b, words, number, block[row], both)


def depth_first(bitmaps: Bitmaps, known: list[Known], longest: int, step: int = STEP) -> Iterator[tuple[Phrases, np.ndarray]]:
    """Phrases up to the longest, a group of first words at a time, each with its place among the known ones of its length (-1: not told).

    Of a length that is known, only known phrases go on; of another, those whose endings are known.
    """
    for group in bitmaps.groups(step):
        now, at = group, bitmaps.used[group.words[:, 0]]
        yield now, at
        while now.words.shape[1] < longest and len(now.words):
            now = now.extended()
            length = now.words.shape[1]
            if length <= len(known):
                at = known[length - 1].at(now.keys())
            else:
                at = np.full(len(now.words), -1)
                ending = known[-1].at(now.keys(len(known))) >= 0
                now, at = now.only(ending), at[ending]
            if length <= len(known):
                now, at = now.only(at >= 0), at[at >= 0]
            yield now, at


def _known(table: pa.Table) -> list[Known]:
    out = []
    for length in range(1, LONGEST + 1):
        rows = table.filter(pc.equal(table["length"], length))
        if not rows.num_rows:
            break
        out.append(Known(rows["payload"].to_pylist()))
    return out


def counting(shortest: int, longest: int, buckets: int, step: int):
    """For a part's texts and the answers so far: messages with the popcounts of phrases of these lengths."""

    @given_back
    def count(key, texts, answers):
        places = Places(texts["packed"].to_pylist())
        keys, lengths, counts = [], [], []
        if longest == 1:
            tokens, number = distinct(places.tokens) if len(places.tokens) else (places.tokens, places.tokens.view(np.int64))
            keys, lengths, counts = [phrase_keys(tokens[:, None])], [np.ones(len(tokens), np.uint8)], [np.bincount(number, minlength=len(tokens))]
        elif answers.num_rows:
            known = _known(answers)
            for found, _ in depth_first(Bitmaps(places, known[0]), known, longest, step):
                if found.words.shape[1] >= shortest and len(found.words):
                    keys.append(found.keys()), lengths.append(np.full(len(found.words), found.words.shape[1], np.uint8)), counts.append(found.counts())
        if not keys:
            return MESSAGE.empty_table()
        keys, lengths, counts = np.concatenate(keys), np.concatenate(lengths), np.concatenate(counts)
        order = np.argsort(keys)
        keys, lengths, counts = keys[order], lengths[order], counts[order]
        bucket = ((keys >> U64(40)).astype(np.int64) * buckets) >> 24
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
        rows = list(zip(at[:-1], at[1:]))
        part = key[0].as_py()
        return pa.Table.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([message(keys[a:b], lengths[a:b], counts[a:b]) for a, b in rows], pa.binary())], schema=MESSAGE)

    return count


def summing(least: int, longest: int):
    """For a bucket's messages: to each part those of its phrases whose sum over all parts suffices; the least part gets the sum itself, others 0."""

    @given_back
    def add(key, table):
        order = np.argsort(table["part"].to_numpy(), kind="stable")
        parts = table["part"].to_numpy()[order]
        got = [read_message(table["payload"][int(k)].as_py()) for k in order]
        keys, lengths, counts = (np.concatenate(x) for x in zip(*got))
        of = np.repeat(np.arange(len(got)), [len(k) for k, _, _ in got])
        by = np.argsort(keys, kind="stable")  # equal hashes stay by their part
        ordered = keys[by]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        sums = np.add.reduceat(counts[by], np.flatnonzero(new))
        enough = sums >= least
        total = np.where(new, sums[np.cumsum(new) - 1], 0)
        kept = enough[np.cumsum(new) - 1]
        by, total = by[kept], total[kept]
        out = []
        back = np.lexsort((keys[by], lengths[by], of[by]))
        by, total = by[back], total[back]
        group = of[by].astype(np.int64) * (longest + 1) + lengths[by]
        at = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist() if len(group) else [0]
        for a, b in zip(at[:-1], at[1:]):
            out.append((int(parts[of[by[a]]]), int(lengths[by[a]]), message(keys[by[a:b]], lengths[by[a:b]], total[a:b])))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else ((), (), ()), ANSWER)], schema=ANSWER)

    return add


def giving(step: int):
    """For a part's texts and all answers: the phrases that this part gives out, and its words by lang (words: 0)."""

    @given_back
    def give(key, texts, answers):
        places = Places(texts["packed"].to_pylist())
        out = {name: [] for name in FOUND.names}
        for lang, n in zip(places.langs, np.bincount(places.lang, minlength=len(places.langs)).tolist()):
            for name, value in zip(FOUND.names, (lang, None, 0, n)):
                out[name].append(value)
        if answers.num_rows:
            known = _known(answers)
            bitmaps = Bitmaps(places, known[0])
            names = np.array([places.word(k) for k in bitmaps.first.tolist()], object)
            langs = [places.langs[k] for k in places.lang[bitmaps.first].tolist()]
            for found, at in depth_first(bitmaps, known, len(known), step):
                length = found.words.shape[1]
                sums = known[length - 1].sums[at]
                mine = np.flatnonzero(sums > 0)
                out["lang"] += [langs[k] for k in found.words[mine, 0].tolist()]
                out["phrase"] += [" ".join(x) for x in names[found.words[mine]].tolist()]
                out["words"] += [length] * len(mine)
                out["a"] += sums[mine].astype(np.int64).tolist()
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in FOUND], schema=FOUND)

    return give


def frequent_phrases(documents: DataFrame, *, least: int = LEAST, longest: int = LONGEST, part_bytes: int = PART_BYTES, step: int = STEP) -> DataFrame:
    """lang, phrase, words, a of the phrases of up to `longest` words that occur `least` times or more; and, with words 0, each lang's number of words. Saved."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    size = text_bytes(docs)
    parts = n_parts(size, docs, part_bytes)
    # Dealt by the rows' numbers alone, so that the copies of a text are spread over all parts.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    texts = saved(dealt(docs, part).repartition(parts, "part"))
    answers = texts.sparkSession.createDataFrame([], ANSWER_DDL)
    for shortest, last in ((1, 1), (2, 2), (3, 3), (4, longest)):
        if last >= shortest and shortest <= longest:
            sent = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(counting(shortest, last, parts, step), MESSAGE_DDL)
            answers = answers.unionByName(saved(sent.groupBy("bucket").applyInArrow(summing(least, longest), ANSWER_DDL)))
    return saved(texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(giving(step), FOUND_DDL))


def collocations(documents: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, part_bytes: int = PART_BYTES, step: int = STEP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first phrases by score."""
    found = frequent_phrases(documents, least=least, longest=longest, part_bytes=part_bytes, step=step)
    n = found.filter("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = found.filter("words > 0")
    longer = phrases.filter("words > 2")
    head = F.expr("substring_index(phrase, ' ', words - 1)")
    tail = F.expr("substring_index(phrase, ' ', 1 - words)")
    inside = longer.select("lang", "a", F.explode(F.array(head, tail)).alias("phrase")).distinct()
    kept = phrases.filter("words > 1").join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    parts = [phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count)) for name, count in (("first", "l"), ("rest", "r"))]
    counted = cuts.join(parts[0], ["lang", "first"]).join(parts[1], ["lang", "rest"]).join(n, "lang")
    # Decimals of up to 38 digits hold the products; div is exact on them.
    score = F.expr("(1000BD * a * n) div (CAST(l AS DECIMAL(19, 0)) * r)")
    lowest = counted.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    scored = lowest.select("lang", "phrase", "a", "m.l", "m.r", "n", F.col("m.score").alias("score"))
    best = (F.desc("score"), F.desc("a"), "phrase")
    # The first of each share of a lang's phrases, then the first of those: no task sorts all of a lang.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    few = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
