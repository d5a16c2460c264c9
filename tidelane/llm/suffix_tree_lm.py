"""Language-model scores from a probabilistic suffix tree over words, beside an add-one unigram base.

The tree's symbols are the lower-cased words, an end, and one symbol for all words that no training
text has. Its contexts are the runs of up to DEPTH words before a word. A context c has N(c) training
words after it; of those, the ones seen there at least twice, n(c, x) times, have estimates of their
own. A discount on each of them, and the share of the words seen once, go to the parent, the context
less its oldest word:

    P(x | c) = (max(n(c, x) - DISCOUNT, 0) + R(c) P(x | parent)) / N(c),   R(c) = N(c) - sum of (n - DISCOUNT)

A context stays only if its distribution diverges enough from its parent's: what it adds to the
log-likelihood of its own words, N(c) times the divergence, must reach MIN_GAIN. A context that
fails passes its parent's distribution on, so a word is scored by the longest kept context before
it. The root is the base's distribution: (n(x) + 1) / (N + V + 1), an unknown word counting 0.

All counts cover all training documents, and the tree grows with them; it is never gathered. The
texts are dealt into parts. For each length of context every part asks, in packed messages, for the
counts of the runs of words that it holds; buckets by context add up and give back the counts and
what the divergence test needs. A run can repeat only if the shorter runs in it do, so of longer
runs only those are asked for. A context with more than HEAVY words after it is dealt over several
buckets by the next word, so that no bucket has all of it.

Capacity: a part has about 6 MB of text, a bucket the messages about twice as much, and of one
context HEAVY words at most. Words are known by 64-bit hashes, contexts by 48 bits of theirs, and
the next words after one by NEXT_BITS more than their number needs, 32 at most.

Defined results: null and empty texts are the end alone; rows with a null id are scored and
learned from; repeated rows count each; without training rows all scores are 0; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import MULTIPLIER, U64, arrow_table, batch, bounded, crc_mod, distinct, given_back, hashed_words, mixed, numbered, text_chunks
from tidelane.llm.dealing import dealt, n_parts, spread, text_bytes, unpacked_rows
from tidelane.llm.exchange import SENT_DDL, answered, sent

#: Words of the longest context; what a word seen again keeps of its count; nats that a context must add.
DEPTH, DISCOUNT, MIN_GAIN = 2, 0.75, 4.0
#: Words after one context that one bucket may get.
HEAVY = 2_000_000
#: Bytes of text in a part: a worker takes some twenty times as much.
TREE_PART_BYTES = 6 << 20
#: The end as a word.
END_WORD = U64(0xE5D0E5D0E5D0E5D0)
FOLD, HELD_OUT = 7, 2
#: Words that a task counts before it gives their counts away.
COUNTED = 1_000_000
#: Parent probabilities travel as a byte: steps of a quarter of a nat.
STEPS = 4
CONTEXT_BITS = ~U64((1 << 16) - 1)
#: Bits that tell the words after a context apart, besides those of their number: one pair in 2 ** NEXT_BITS may be mistaken.
NEXT_BITS = 18
MESSAGE = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
MESSAGE_DDL = "bucket int, part int, payload binary"
ANSWER = pa.schema([("part", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
ANSWER_DDL = "part int, level int, bucket int, payload binary"


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of whole numbers, byte plane by byte plane, so that equal high bytes compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(payload: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(payload, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel(), at + n * width


def bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of contexts of equal width."""
    return (context >> U64(40)).astype(np.int64) * buckets >> 24


def steps_of(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; where `first` holds, the number itself."""
    return np.where(first, x, np.diff(x, prepend=U64(0)))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its group."""
    first = np.zeros(int(sizes.sum()), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return first


@dataclass
class Question:
    """What a part asks of one level: contexts, sorted, with the number of words after each, and of the next words under each,
    sorted, how often the part's training rows have them there and their probability after the parent."""

    context: np.ndarray
    total: np.ndarray
    sizes: np.ndarray
    next: np.ndarray
    count: np.ndarray
    parent: np.ndarray

    def messages(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        where = bucket_of(self.context, buckets)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]).tolist() if len(where) else [0]
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        steps = steps_of(self.next, starts_of(self.sizes))
        for a, b in zip(cuts, cuts[1:]):
            x, y = int(ends[a]), int(ends[b])
            whole = planes(steps_of(self.context[a:b], np.arange(b - a) == 0), 8) + planes(self.total[a:b], 5) + planes(self.sizes[a:b], 4) + planes(steps[x:y], 4) + planes(self.count[x:y], 4) + self.parent[x:y].tobytes()
            yield int(where[a]), struct.pack("<II", b - a, y - x) + pa.compress(whole, "zstd", asbytes=True)

    @classmethod
    def read(cls, payload: bytes) -> Question:
        n, m = struct.unpack_from("<II", payload)
        whole, at = pa.decompress(payload[8:], 17 * n + 9 * m, "zstd", asbytes=True), 0
        context, at = unplaned(whole, at, n, 8)
        total, at = unplaned(whole, at, n, 5)
        sizes, at = unplaned(whole, at, n, 4)
        steps, at = unplaned(whole, at, m, 4)
        count, at = unplaned(whole, at, m, 4)
        sizes = sizes.astype(np.int64)
        sums = np.cumsum(steps)
        before = np.concatenate([np.zeros(1, U64), sums])[np.cumsum(sizes) - sizes]
        return cls(np.cumsum(context), total, sizes, sums - np.repeat(before, sizes), count, np.frombuffer(whole, np.uint8, m, at))


def added_up(questions: list[Question], level: int, heavy: int = HEAVY, discount: float = DISCOUNT, min_gain: float = MIN_GAIN) -> Iterator[bytes]:
    """The answer to each question, in its order: for each context the words counted there that were seen again, their kinds and
    what they add to the log-likelihood; for each next word its count, 0 if it was seen once.

    Contexts that are whole in their bucket are tested there: those that fail have zeros. Of level 0 each word's count is the answer.
    """
    contexts, which = np.unique(np.concatenate([q.context for q in questions]), return_inverse=True)
    ends = np.cumsum([0, *(len(q.context) for q in questions)])
    if level == 0:
        count = np.bincount(which, np.concatenate([q.total for q in questions]), len(contexts)).astype(np.int64)
        yield from (answer_of(*[np.zeros(0)] * 3, count[which[a:b]]) for a, b in zip(ends, ends[1:]))
        return
    total = np.zeros(len(contexts), np.int64)
    total[which] = np.concatenate([q.total for q in questions]).astype(np.int64)
    key = np.concatenate([np.repeat(which[a:b], q.sizes).astype(U64) << U64(32) | q.next for q, a, b in zip(questions, ends, ends[1:])])
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(key)]
    first = np.flatnonzero(new)
    n = np.add.reduceat(np.concatenate([q.count for q in questions]).astype(np.int64)[order], first) if len(first) else np.zeros(0, np.int64)
    n[n < 2] = 0
    parent = np.concatenate([q.parent for q in questions])[order[first]]
    again = np.flatnonzero(n)
    of = (ordered[first[again]] >> U64(32)).astype(np.int64)
    words, kinds = np.bincount(of, n[again], len(contexts)), np.bincount(of, minlength=len(contexts))
    added = np.bincount(of, n[again] * (np.log(n[again] - discount) + parent[again] / STEPS), len(contexts))
    whole = total <= heavy
    fails = whole & (gain(total, words, kinds, added, discount) < min_gain)
    words[fails] = kinds[fails] = 0
    added[whole] = 0
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    at = 0
    for q, a, b in zip(questions, ends, ends[1:]):
        k = which[a:b]
        yield answer_of(words[k], kinds[k], added[k], n[place[at : at + len(q.next)]])
        at += len(q.next)


def answer_of(words: np.ndarray, kinds: np.ndarray, added: np.ndarray, n: np.ndarray) -> bytes:
    return struct.pack("<II", len(words), len(n)) + pa.compress(planes(words, 5) + planes(kinds, 4) + planes(added.astype("<f4").view("<u4"), 4) + planes(n, 5), "zstd", asbytes=True)


def answer_read(payload: bytes) -> tuple[np.ndarray, ...]:
    c, m = struct.unpack_from("<II", payload)
    whole, at = pa.decompress(payload[8:], 13 * c + 5 * m, "zstd", asbytes=True), 0
    words, at = unplaned(whole, at, c, 5)
    kinds, at = unplaned(whole, at, c, 4)
    added, at = unplaned(whole, at, c, 4)
    n, at = unplaned(whole, at, m, 5)
    return words, kinds, added.astype("<u4").view("<f4"), n.astype(np.int64)


def gain(total: np.ndarray, words: np.ndarray, kinds: np.ndarray, added: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """What a context adds to the log-likelihood of the words after it: its own estimates against its parent's, less what the others lose."""
    once = total - words
    with np.errstate(divide="ignore", invalid="ignore"):
        out = added - words * np.log(total) + np.where(once > 0, once * np.log((once + discount * kinds) / total), 0.0)
    return np.where((kinds > 0) & (once >= 0), out, -np.inf)


def with_ends(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words of texts in a row, each text's followed by the end."""
    return np.insert(hashes, at[1:], END_WORD)


class Part:
    """The words of a part's texts in a row, each text's followed by the end, and what is known of the probability of each."""

    def __init__(self, packed: list[bytes], totals: tuple[int, int]):
        hashes, rows, learn, self.ids, self.held = [], [], [], [], []
        n = 0
        for rows_ in map(unpacked_rows, packed):
            self.ids.append(rows_["doc_id"]), self.held.append(rows_["held_out"])
            for first, data, bounds in text_chunks(rows_["text"]):
                h, at = hashed_words(data, bounds)
                sizes = np.diff(at)
                hashes.append(with_ends(h, at))
                rows.append(np.repeat(np.arange(n + first, n + first + len(sizes), dtype=np.int32), sizes + 1))
            n += rows_.num_rows
        self.n_rows, self.totals = n, totals
        self.row = np.concatenate([np.zeros(0, np.int32), *rows])
        held = np.concatenate([h.to_numpy(zero_copy_only=False) for h in self.held]) if self.held else np.zeros(0, bool)
        self.learn = ~held[self.row]
        self.word, self.at = distinct(np.concatenate([np.zeros(0, U64), *hashes]))
        self.level = 0
        # Of the run of words that ends at each place: its number among the distinct ones of its length, and their hashes and counts.
        self.run, self.run_hash = self.at, self.word
        self.p = None

    def question(self, heavy: int = HEAVY) -> Question:
        """Level 0 asks for words. Others ask for the contexts seen twice or more, and the next words whose shorter run was."""
        if self.level == 0:
            n = np.bincount(self.at, self.learn, len(self.word)).astype(np.int64)
            return Question(self.word, n, np.zeros(len(n), np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.uint8))
        before = np.full_like(self.run, -1)
        before[1:] = self.run[:-1]
        before[np.concatenate([[True], self.row[1:] != self.row[:-1]])[: len(before)]] = -1
        before[before >= 0] = np.where(self.count[before[before >= 0]] >= 2, before[before >= 0], -1)
        here = np.flatnonzero(before >= 0).astype(self.row.dtype)
        context, next_ = before[here], self.at[here]
        there = np.zeros(len(self.count), bool)
        there[context] = True
        self.own, self.own_at = np.flatnonzero(there), (np.cumsum(there, dtype=self.run.dtype) - 1)[context]
        # A heavy context is dealt by the next word into shares, each a context of its own. All of them are asked for, those
        # without a next word here, too: their sums belong to it.
        shares = -(-self.count[self.own] // heavy)
        owner, begin = np.repeat(np.arange(len(self.own)), shares), np.cumsum(shares) - shares
        nth = (np.arange(len(owner)) - begin[owner]).astype(U64)
        hashes = self.run_hash[self.own][owner]
        hashes = np.where(shares[owner] > 1, mixed(hashes + U64(1) + nth), hashes) & CONTEXT_BITS
        by = np.argsort(hashes)
        contexts, self.owner = hashes[by], owner[by]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        repeats = np.flatnonzero(self.run_count[here] >= 2).astype(self.row.dtype)
        k = self.own_at[repeats]
        nth_share = (self.word[next_[repeats]] % shares[k].astype(U64)).astype(np.int64) if len(shares) and shares.max() > 1 else 0
        rank = rank[begin[k] + nth_share].astype(U64)
        wide = len(self.word).bit_length()
        rank <<= U64(wide)
        rank |= next_[repeats].astype(U64)
        order, number = numbered(rank, len(by).bit_length() + wide)
        rank >>= U64(wide)
        pair = np.empty_like(number)
        pair[order] = number
        one = order[np.concatenate([[True], number[1:] != number[:-1]])[: len(order)]]
        asked = here[repeats]
        parent = np.clip(np.round(-STEPS * np.log(self.p[asked[one]])), 0, 255).astype(np.uint8)
        self.here, self.asked_at, self.pair, self.n_pairs = here, asked, pair, len(one)
        n = np.bincount(pair, self.learn[asked], len(one)).astype(np.int64)
        total = self.count[self.own]
        bits = np.minimum(NEXT_BITS + np.ceil(np.log2(np.maximum(total, 1) + 1.0)), 32).astype(U64)
        return Question(contexts, total[self.owner], np.bincount(rank[one].astype(np.int64), minlength=len(contexts)), self.word[next_[repeats][one]] >> (U64(64) - bits[k[one]]), n, parent)

    def take(self, answers: list[bytes], heavy: int = HEAVY) -> None:
        """The answers to the question at hand, by bucket: probabilities follow, and the next level."""
        words, kinds, added, n = (np.concatenate(x) for x in zip(*(answer_read(a) for a in answers))) if answers else [np.zeros(0, np.int64)] * 4
        if self.level == 0:
            self.count = n
            self.run_count = n[self.at]
            self.known = self.run_count > 0
            self.base = (self.run_count + 1) / (sum(self.totals) + 1)
            self.p = self.base.copy()
        else:
            words, kinds = (np.bincount(self.owner, x, len(self.own)) for x in (words, kinds))
            added = np.bincount(self.owner, added, len(self.own))
            total = self.count[self.own]
            kept = np.where(total <= heavy, kinds > 0, gain(total, words, kinds, added) >= MIN_GAIN)
            rest = total - words + DISCOUNT * kinds
            run_count = np.zeros(len(self.at), np.int64)
            run_count[self.asked_at] = n[self.pair]
            k = self.own_at
            seen = run_count[self.here]
            deeper = (np.where(seen >= 2, seen - DISCOUNT, 0.0) + rest[k] * self.p[self.here]) / total[k]
            self.p[self.here] = np.where(kept[k], deeper, self.p[self.here])
            hashes = np.zeros(self.n_pairs, U64)
            hashes[self.pair] = mixed(self.run_hash[self.run[self.asked_at - 1]] * MULTIPLIER + self.word[self.at[self.asked_at]])
            run = np.full_like(self.run, -1)
            run[self.asked_at] = self.pair
            self.run, self.run_hash, self.count, self.run_count = run, hashes, n, run_count
        self.level += 1


def vocabulary(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """Words of the training rows, ends included, and how many are distinct."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counts() -> list[pa.RecordBatch]:
            word, n = np.unique(np.concatenate([np.zeros(0, U64), *held]), return_counts=True)
            held.clear()
            return sent(0, word, n, buckets, 64).to_batches()

        for b in batches:
            for _, data, bounds in text_chunks(b["text"]):
                held.append(with_ends(*hashed_words(data, bounds)))
                if sum(map(len, held)) > COUNTED:
                    yield from counts()
        yield from counts()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kinds", pa.int64()), ("total", pa.int64())])
        for b in batches:
            pairs = [struct.unpack("<qq", x) for x in b["payload"].to_pylist()]
            yield batch(schema, kinds=[k for k, _ in pairs], total=[n for _, n in pairs])

    words = bounded(docs).filter(~F.col("held_out")).select("text").mapInArrow(count, SENT_DDL)
    totals = answered(words, 1 << 62, with_totals=True).mapInArrow(sums, "kinds long, total long")  # only the totals reach that count
    return tuple(totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first())


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scored(documents: DataFrame, *, depth: int = DEPTH, heavy: int = HEAVY, part_bytes: int = TREE_PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    held = F.coalesce(crc_mod("doc_id", FOLD) == HELD_OUT, F.lit(False))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held)
    size = text_bytes(docs)
    buckets = n_parts(size, docs, 2 * part_bytes)
    totals = vocabulary(docs, buckets)
    parts = n_parts(size, docs, part_bytes)
    texts = dealt(docs, spread(parts, "doc_id", "text")).repartition(parts, "part")

    def known(table: pa.Table, answers: pa.Table | None) -> Part:
        part = Part(table["packed"].to_pylist(), totals)
        by: dict[int, list[tuple[int, bytes]]] = {}
        for level, bucket, payload in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "payload"))) if answers else ():
            by.setdefault(level, []).append((bucket, payload))
        for level in sorted(by):
            part.question(heavy)
            part.take([payload for _, payload in sorted(by[level])], heavy)
        return part

    @given_back
    def messages(key, table, answers):
        asked = list(known(table, answers).question(heavy).messages(buckets))
        return arrow_table(MESSAGE, bucket=[b for b, _ in asked], part=[key[0].as_py()] * len(asked), payload=[m for _, m in asked])

    def answering(level: int):
        @given_back
        def answer(key, table):
            questions = [Question.read(m) for m in table["payload"].to_pylist()]
            return arrow_table(ANSWER, part=table["part"].combine_chunks(), level=[level] * len(questions), bucket=table["bucket"].combine_chunks(), payload=list(added_up(questions, level, heavy)))

        return answer

    @given_back
    def use(key, table, answers):
        part = known(table, answers)
        n, log = part.n_rows, lambda p: np.bincount(part.row, np.log10(p), part.n_rows)
        return arrow_table(
            OUT, doc_id=pa.concat_arrays(part.ids), held_out=pa.concat_arrays(part.held), n_tokens=np.bincount(part.row, minlength=n), n_known=np.bincount(part.row[part.known], minlength=n),
            train_tokens=np.full(n, totals[0]), base_score=log(part.base), score=log(part.p),
        )

    answers = None
    for level in range(depth + 1):
        asked = texts.groupBy("part").applyInArrow(lambda key, table: messages(key, table, None), MESSAGE_DDL) if answers is None else texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(messages, MESSAGE_DDL)
        got = asked.groupBy("bucket").applyInArrow(answering(level), ANSWER_DDL).repartition(parts, "part")  # each level's answers are shuffled once and read again
        answers = got if answers is None else answers.unionByName(got)
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(use, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
