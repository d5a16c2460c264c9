"""Removal of long byte strings that an earlier document has, by run-length indexes.

A string of LENGTH bytes is repeated if it starts in a document with a smaller doc_id, too. To
bring equal strings together, each one is known by its anchor: of the ANCHOR-byte strings in
it, the one with the least hash. Equal strings have equal anchors, so

1. the documents' anchors are counted over the corpus (see exchange), and those of a single
   document end there;
2. the strings around every other anchor travel to a bucket by the anchor's hash: consecutive
   strings with one anchor are one fragment, in which the anchor itself is its 8-byte hash; the
   strings of an anchor that very many documents share are fragments of their own and go to
   buckets by the hash of the whole, so that no bucket has all of such an anchor;
3. in a bucket, equal fragments are one: its least document decides for the others. Of the fragments
   that differ but share an anchor, those of smaller documents are indexed and those of larger ones
   streamed: the documents of an anchor are halved, and the halves again. The index is a
   run-compressed Burrows-Wheeler transform, which keeps its runs and the places at their ends; a
   fragment streams its matching statistics through it, letter by letter from its end, and where
   the match is a whole string a smaller document has it;
4. the marks return to the documents, whose covered bytes go.

Texts are dealt by doc_id and travel once, in compressed batches, to parts of bounded size; equal
texts are one text until the end. Nothing is sampled: every repeated string is found.

Defined results: null and empty texts are empty; a text of fewer than LENGTH bytes stays whole; a
text of any length is taken whole, by one task;
later copies of a text of LENGTH bytes or more go whole; rows without a doc_id are left out; rows
that repeat a doc_id count once; an empty table gives no rows; extra columns are ignored. Bytes are
removed as bytes, so kept text that is read as UTF-8 may start or end inside a letter; see
deduplicated().
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelane.llm.common import MULTIPLIER, U64, _rng, given_back, mixed, numbered, part_of, powers, text_chunks
from tidelane.llm.copies import chosen, first_copies, first_texts, keyed
from tidelane.llm.dealing import PART_BYTES, dealt, n_parts, text_bytes
from tidelane.llm.exchange import SENT_DDL, answered, cut, looked_up, received, sent

LENGTH, ANCHOR = 50, 32
#: Strings of LENGTH bytes that one anchor may stand for: places of the anchor in them.
PLACES = LENGTH - ANCHOR + 1
CODE = 8
#: Documents that may share an anchor before its strings travel one by one, dealt by all their letters.
HEAVY = 4_000
#: Letters that a bucket indexes at a time, about: what a task holds.
INDEX_LETTERS = 600_000
#: Bytes of text whose anchors are sought at a time: small, as each byte takes several 8-byte numbers meanwhile.
SOUGHT_BYTES = 1 << 17
WINDOW = LENGTH - ANCHOR + CODE
MOST = ~U64(0)
_bytes = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _extreme(x: np.ndarray, width: int, of) -> np.ndarray:
    """The extreme of each run of `width` values."""
    k = 1
    while 2 * k <= width:
        x = of(x[:-k], x[k:])
        k *= 2
    return of(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor's place and hash, and the first and last of the LENGTH-byte strings it stands for.

    Every string is within one text and belongs to one anchor: its leftmost least.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, np.zeros(0, U64), none, none
    h, m, k = _bytes[data], int(MULTIPLIER), 1
    while k < ANCHOR:
        g = h[:-k] * U64(m)
        g += h[k:]
        h, m, k = g, m * m % (1 << 64), 2 * k
    np.minimum(h, MOST - U64(1), out=h)
    real = np.ones(n + 1, dtype=bool)  # starts of strings within one text
    sizes = np.diff(bounds)
    ends = bounds[1:][sizes > 0]
    for back in range(1, LENGTH):
        real[np.maximum(ends - back, 0)] = False
    real = real[: n - LENGTH + 1]
    inside = np.ones(n + 1, dtype=bool)  # starts of anchors within one text
    for back in range(1, ANCHOR):
        inside[np.maximum(ends - back, 0)] = False
    h = np.where(inside[: len(h)], h, MOST)
    least = _extreme(h, PLACES, np.minimum)  # least[i]: of the string that starts at i
    starts = np.flatnonzero(real)
    if not len(starts):
        return none, np.zeros(0, U64), none, none
    low = least[starts]
    joined = starts[1:] == starts[:-1] + 1
    run = np.flatnonzero(np.concatenate([[True], ~joined | (low[1:] != low[:-1])]))
    # Neighbouring strings with the same least share its place, but for those that begin after it.
    place = np.repeat(_leftmost(h, starts[run], low[run]), np.diff(np.concatenate([run, [len(starts)]])))
    after = np.flatnonzero(starts > place)
    place[after] = _leftmost(h, starts[after], low[after])
    change = np.concatenate([[True], (place[1:] != place[:-1]) | ~joined])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    at = place[first]
    # Least hashes crowd at the low end; mixed, which keeps different ones different, they fill buckets evenly.
    return at, mixed(h[at]), starts[first], starts[last]


def _leftmost(h: np.ndarray, starts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each string the first place in it where h is its least."""
    place = np.full(len(starts), -1, dtype=np.int64)
    todo = np.arange(len(starts))
    for offset in range(PLACES):
        hit = h[starts[todo] + offset] == low[todo]
        place[todo[hit]] = starts[todo[hit]] + offset
        todo = todo[~hit]
        if not len(todo):
            break
    return place


#: A letter that no text has: it ends each indexed fragment, so that no match runs on into the next.
END = 256


def sorted_strings(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the text by the `width` letters from each, equal ones by place; and for each in turn the number of different strings before it."""
    n = len(text)
    padded = np.zeros(n + 4, dtype=U64)  # 0 is beyond the text
    padded[:n] = text
    padded[:n] += U64(1)
    key, known = np.zeros(n, dtype=U64), min(4, width)
    for k in range(known):
        key = (key << U64(9)) | padded[k : n + k]
    order, number = numbered(key, 9 * known)
    while known < width:
        step = min(known, width - known)
        rank = np.zeros(n + step, dtype=U64)
        rank[order] = number + U64(1)
        bits = max(1, int(n).bit_length())
        order, number = numbered(rank[:n] << U64(bits) | rank[step:], 2 * bits)
        known += step
    return order, number


def sevens(text: np.ndarray, width: int) -> np.ndarray:
    """The seven letters from each place, 9 bits each, and from the places up to `width` after the end."""
    padded = np.concatenate([text.astype(U64), np.zeros(width + 8, U64)])
    out = np.zeros(len(text) + width + 1, U64)
    for k in range(7):
        out = out << U64(9) | padded[k : k + len(out)]
    return out


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform with the places at either end of each run; nothing is kept by row.

    Rows are sorted by `width` letters, equal ones by place: matches up to that length are exact.
    """

    def __init__(self, text: np.ndarray, width: int):
        order, _ = sorted_strings(text, width)
        self.width, n = width, len(text)
        before = text[order - 1].astype(np.int64)
        before[order == 0] = END + 1  # nothing stands before the whole text
        self.run_start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        run_end = np.concatenate([self.run_start[1:], [n]])
        self.run_char = before[self.run_start]
        self.first, self.last = order[self.run_start].astype(np.int64), order[run_end - 1].astype(np.int64)
        # Where a run's rows go, one letter to the left: after the runs of lesser letters and the earlier runs of its
        # own. The last letter has a run of its own, in front: the suffix of no letters precedes it.
        self.last_char, self.n = int(text[-1]), n
        chars, sizes = np.concatenate([text[-1:].astype(np.int64), self.run_char]), np.concatenate([[1], run_end - self.run_start])
        by_char = np.argsort(chars, kind="stable")
        target = np.empty(len(sizes), dtype=np.int64)
        target[by_char] = np.concatenate([[0], np.cumsum(sizes[by_char])[:-1]])
        self.run_target, self.run_end, self.own_row = target[1:], run_end, int(target[0])
        self.by_char = np.sort(self.run_char * (len(self.run_char) + 1) + np.arange(len(self.run_char)))  # each letter's runs, in order
        self.seven = sevens(text, width)

    def alike(self, a: np.ndarray, b: np.ndarray, seven: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Letters that the places a here and b in the text of `seven` have in common, `most` at most."""
        out, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(0, self.width, 7):
            x = self.seven[np.minimum(a + k, len(self.seven) - 1)] ^ seven[np.minimum(b + k, len(seven) - 1)]
            same = np.where(x == 0, 7, 0)
            for j in range(1, 7):
                same += (x < U64(1 << 9 * j)) & (x != 0)
            out += np.where(going, same, 0)
            going &= x == 0
        return np.minimum(out, np.minimum(most, self.n - a))

    def stream(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Matching statistics of the stretches text[starts[k] : ends[k]], each from its end, a letter a step: the stretches
        still going, and the length of a longest match that begins at the letter, `width` at most. If only whole
        matches are wanted, a stretch is given up once its first `width` letters can't be one: then no others to come can.
        """
        live, at = np.flatnonzero(ends > starts), ends.copy()
        row, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        n_runs, seven = len(self.run_char) + 1, sevens(text, self.width)
        while len(live):
            at[live] -= 1
            c = text[at[live]].astype(np.int64)
            run = np.searchsorted(self.run_start, row[live], "right") - 1
            turn = np.flatnonzero((self.run_char[run] != c) | (length[live] == 0))
            nowhere = np.zeros(len(live), bool)
            if len(turn):
                k, letter = live[turn], c[turn]
                after = np.searchsorted(self.by_char, letter * n_runs + run[turn])
                best = np.full(len(turn), -1)
                for near, row_of, place_of in ((after - 1, self.run_end - 1, self.last), (after, self.run_start, self.first)):
                    other = self.by_char[np.clip(near, 0, len(self.by_char) - 1)]
                    there = np.flatnonzero((near >= 0) & (near < len(self.by_char)) & (other // n_runs == letter))
                    r = other[there] % n_runs
                    common = self.alike(place_of[r], at[k[there]] + 1, seven, length[k[there]])
                    better = common > best[there]
                    j = there[better]
                    best[j], run[turn[j]], row[k[j]] = common[better], r[better], row_of[r[better]]
                length[k] = np.maximum(best, 0)
                # A letter without a run stands at the end of the text alone, or nowhere.
                at_end = best < 0
                nowhere[turn[at_end & (letter != self.last_char)]] = True
                lost = k[at_end]
                row[lost], length[lost] = -1, 0
            row[live] = np.where(row[live] < 0, self.own_row, self.run_target[run] + row[live] - self.run_start[run])
            length[live] = np.minimum(length[live] + 1, self.width)
            length[live[nowhere]] = 0
            yield live, length[live]
            ahead = at[live] - starts[live]
            live = live[(ahead > 0) & (length[live] + ahead >= self.width)] if whole else live[ahead > 0]


def ranks(slot: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Each fragment's document's place, from 0, among the documents of its slot."""
    by = np.lexsort((docs, slot))
    new_slot = np.concatenate([[True], slot[by][1:] != slot[by][:-1]])[: len(by)]
    new = new_slot | np.concatenate([[True], docs[by][1:] != docs[by][:-1]])[: len(by)]
    count = np.cumsum(new)
    out = np.empty(len(by), np.int64)
    out[by] = count - np.maximum.accumulate(np.where(new_slot, count, 0))
    return out


def repeated(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, slot: np.ndarray, left: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each fragment, text[starts[k] : starts[k + 1]] of document docs[k], bits of its windows that a smaller document of its slot has. Bit 0 is the first window.

    left[k] letters stand before the anchor's code. The documents of a slot are halved and halved again, by the
    bits of their ranks: at each level the lower halves are indexed, and the upper halves streamed as far as they
    have windows without a mark. The halves that belong together have a code of their own there.
    """
    sizes = np.diff(starts)
    windows = np.maximum(sizes - window + 1, 0)
    whole, bits, rank = (1 << windows) - 1, np.zeros(len(sizes), np.int64), ranks(slot, docs)

    def coded(k: np.ndarray, pair: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray]:
        """The fragments k in a row, each with its pair in its code and `ends` letters after it, and their starts."""
        size = sizes[k] + ends
        begin = np.cumsum(size) - size
        out = np.full(int(size.sum()), END, np.uint16)
        out[np.arange(int(sizes[k].sum())) + np.repeat(begin - (np.cumsum(sizes[k]) - sizes[k]), sizes[k])] = _taken(text, starts[k], sizes[k])
        own = mixed(pair.astype(U64) + U64(1))
        for b in range(CODE):
            out[begin + left[k] + b] ^= (own >> U64(8 * b) & U64(255)).astype(np.uint16)
        return out, begin

    for level in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        upper = (rank >> level & 1 == 1) & (bits != whole)
        pairs, pair = np.unique(np.stack([slot, rank >> level + 1]), axis=1, return_inverse=True)
        pair = pair.ravel()
        busy = np.zeros(pairs.shape[1], bool)
        busy[pair[upper]] = True
        high, low = np.flatnonzero(upper), np.flatnonzero((rank >> level & 1 == 0) & busy[pair])
        if not len(high):
            continue
        index = RunLengthIndex(coded(low, pair[low], 1)[0], window)
        streamed, begin = coded(high, pair[high], 0)
        # From the first to the last window without a mark.
        open_ = whole[high] & ~bits[high]
        first, last = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        for m in range(int(windows[high].max()) - 1, -1, -1):
            here = open_ >> m & 1 == 1
            first[here] = m
            last[here & (open_ >> (m + 1) == 0)] = m
        for step, (k, length) in enumerate(index.stream(streamed, begin + first, begin + last + window, whole=True)):
            at = last[k] + window - 1 - step
            hit = np.flatnonzero((length == window) & (at <= last[k]))
            bits[high[k[hit]]] |= np.int64(1) << at[hit]
    return bits


MARKS = np.dtype([("doc_id", "<i8"), ("at", "<u4"), ("bits", "<u4")])


def fragments_of(data: np.ndarray, at: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fragments' letters in a row and their bounds: bytes before the anchor, its hash, bytes after it."""
    left, right = at - first, last + LENGTH - (at + ANCHOR)
    starts = np.concatenate([[0], np.cumsum(left + CODE + right)])
    out = np.empty(starts[-1], dtype=np.uint8)
    for size, begin, to in ((left, first, starts[:-1]), (right, at + ANCHOR, starts[:-1] + left + CODE)):
        k = np.repeat(np.arange(len(at)), size)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        out[to[k] + nth] = data[begin[k] + nth]
    code = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for b in range(CODE):
        out[starts[:-1] + left + b] = code[:, b]
    return out, starts


def _taken(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of the text, one after the other."""
    return text[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(payload: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(payload, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.int64), at + n * width


_RIGHT = ("part", "payload", "doc_id", "h", "first_id")


def single(heavy: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of which the heavy ones are cut into their single strings; the last two columns are the first and last string."""
    *others, first, last = columns
    n = np.where(heavy, last - first + 1, 1)
    k = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[k] + nth
    return (*(c[k] for c in others), begin, np.where(heavy[k], begin, last[k]))


def marks_of(slot: np.ndarray, text: np.ndarray, starts: np.ndarray, docs: np.ndarray, left: np.ndarray) -> np.ndarray:
    """repeated() of a bucket's fragments; those that may have windows in common have one slot."""
    sizes = np.diff(starts)
    # Equal fragments: the least document's stands for them, and decides for the others.
    hashes = _fragment_hashes(text, starts)
    order = np.lexsort((docs, sizes, hashes))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])])[: len(order)]
    lead, nth = order[new], np.cumsum(new) - 1
    # Of the others only those with company in their slot have anything to look for.
    lead_bits = np.zeros(len(lead), np.int64)
    by = np.lexsort((docs[lead], slot[lead]))
    crowd = slot[lead][by]
    by = by[np.concatenate([[False], crowd[1:] == crowd[:-1]])[: len(by)] | np.concatenate([crowd[1:] == crowd[:-1], [False]])[: len(by)]]
    ends, crowd = np.cumsum(sizes[lead[by]]), slot[lead[by]]
    begin = 0
    while begin < len(by):  # an index for a few slots at a time
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + INDEX_LETTERS, "right")))
        end = int(np.searchsorted(crowd, crowd[end - 1], "right"))
        some = by[begin:end]
        k = lead[some]
        lead_bits[some] = repeated(_taken(text, starts[k], sizes[k]), np.concatenate([[0], np.cumsum(sizes[k])]), docs[k], slot[k], left[k])
        begin = end
    bits = np.empty(len(sizes), np.int64)
    bits[order] = np.where(docs[order] == docs[lead][nth], lead_bits[nth], (1 << (sizes[order] - WINDOW + 1)) - 1)
    return bits


def _removed(documents: DataFrame, fields: pa.Schema, ddl: StructType, row_of, carry: tuple[str, ...] = (), heavy: int = HEAVY) -> DataFrame:
    """For every document what row_of(doc_id, bytes, covered) gives of the fields, and the columns `carry`."""
    docs = keyed(documents, carry)
    firsts = first_copies(docs)
    size = text_bytes(docs)
    parts, n_buckets, n_indexes = n_parts(size, docs), n_parts(size, docs, 2 * PART_BYTES), n_parts(size, docs)
    dealt_docs = dealt(docs.select("doc_id", "h", "text", *carry), part_of(parts, "doc_id")).repartition(parts, "part")
    wanted = firsts.select(part_of(parts, "doc_id").alias("part"), "doc_id", "h", "first_id")

    def with_firsts(answers: DataFrame) -> DataFrame:
        nulls = [f"CAST(NULL AS LONG) AS {c}" for c in _RIGHT[2:]]
        return answers.selectExpr("part", "payload", *nulls).unionByName(wanted.selectExpr("part", "CAST(NULL AS BINARY) AS payload", *_RIGHT[2:]))

    def chunks(table: pa.Table, firsts: pa.Table) -> Iterator[tuple]:
        """Of some first copies at a time: each anchor's doc_id, its place in the text, and anchors()."""
        for own, texts in first_texts(table["packed"].to_pylist(), firsts):
            ids = own.to_numpy()
            for row, data, bounds in text_chunks(texts, SOUGHT_BYTES):
                found = anchors(data, bounds)
                k = np.searchsorted(bounds, found[0], "right") - 1
                yield ids[row + k], bounds[k], data, *found

    @given_back
    def send(key, table, firsts):
        h, doc = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for ids, _, _, _, hashes, _, _ in chunks(table, firsts):
            own = np.lexsort((ids, hashes))  # an anchor counts once for a document
            a, b = cut(hashes)[own], ids[own]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
            h.append(a[new]), doc.append(b[new])
        tokens, counts = np.unique(np.concatenate(h), return_counts=True)
        return sent(key[0].as_py(), tokens, counts, n_buckets)

    @given_back
    def offer(key, table, answers):
        """Fragments around shared anchors for the buckets; marks that are certain within the part for the part."""
        part = key[0].as_py()
        df = received(answers["payload"].to_pylist())
        rows = answers.filter(answers["payload"].is_null())
        letters, sizes, docs, places, codes, hashed_, lefts = [], [], [], [], [], [], []
        for ids, text_start, data, at, h, first, last in chunks(table, rows):
            n_docs = looked_up(cut(h), df)
            keep = n_docs >= 2
            ids, text_start, at, h, n_docs, first, last = single(n_docs[keep] > heavy, ids[keep], text_start[keep], at[keep], h[keep], n_docs[keep], first[keep], last[keep])
            text, starts = fragments_of(data, at, h, first, last)
            hashes = _fragment_hashes(text, starts)
            letters.append(text), sizes.append(np.diff(starts)), docs.append(ids), codes.append(np.where(n_docs > heavy, hashes, h))
            places.append(first - text_start), hashed_.append(hashes), lefts.append(at - first)
        out = {"bucket": [], "part": [], "payload": []}
        if letters and sum(map(len, sizes)):
            text, size, doc, place, code, hashes, left = (np.concatenate(x) for x in (letters, sizes, docs, places, codes, hashed_, lefts))
            starts = np.concatenate([[0], np.cumsum(size)])
            # Equal fragments of a part: the least document's stands for them, and decides for the others.
            order = np.lexsort((place, doc, hashes))
            same = np.concatenate([[False], (hashes[order][1:] == hashes[order][:-1]) & (size[order][1:] == size[order][:-1])])
            lead = order[~same]
            nth = np.cumsum(~same) - 1
            own = doc[order] == doc[lead][nth]
            local = order[same & ~own]
            if len(local):
                marks = np.zeros(len(local), MARKS)
                marks["doc_id"], marks["at"], marks["bits"] = doc[local], place[local], (1 << (size[local] - WINDOW + 1)) - 1
                out["bucket"].append(-1 - part), out["part"].append(part), out["payload"].append(marks.tobytes())
            lead = np.concatenate([lead, order[same & own]])  # a document's own repeats wait for the same answer
            slot = (cut(code[lead]) >> U64(16)).astype(np.int64) * n_indexes >> 16  # a bucket has 65,536 slots
            by = np.argsort(slot, kind="stable")
            lead, slot = lead[by], slot[by]
            bucket = slot >> 16
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                k = lead[a:b]
                out["bucket"].append(int(bucket[a])), out["part"].append(part)
                out["payload"].append(struct.pack("<I", len(k)) + _planes(slot[a:b] & 65535, 2) + _planes(size[k], 1) + _planes(left[k], 1) + _planes(doc[k], 8) + _planes(place[k], 4) + _taken(text, starts[k], size[k]).tobytes())
        return pa.Table.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["payload"], pa.binary())], names=["bucket", "part", "payload"])

    @given_back
    def mark(key, table):
        if key[0].as_py() < 0:
            return table.select(["part", "payload"])
        parts_, slots, sizes, lefts, docs, places, letters = [], [], [], [], [], [], []
        for part, payload in zip(table["part"].to_pylist(), table["payload"].to_pylist()):
            (n,), at = struct.unpack_from("<I", payload), 4
            slot, at = _unplaned(payload, at, n, 2)
            size, at = _unplaned(payload, at, n, 1)
            left, at = _unplaned(payload, at, n, 1)
            doc, at = _unplaned(payload, at, n, 8)
            place, at = _unplaned(payload, at, n, 4)
            parts_.append(np.full(n, part)), slots.append(slot), sizes.append(size), lefts.append(left), docs.append(doc), places.append(place), letters.append(np.frombuffer(payload, np.uint8, offset=at))
        part, slot, size, left, doc, place, text = (np.concatenate(x) for x in (parts_, slots, sizes, lefts, docs, places, letters))
        bits = marks_of(slot, text, np.concatenate([[0], np.cumsum(size)]), doc, left)
        hit = np.flatnonzero(bits)
        hit = hit[np.argsort(part[hit], kind="stable")]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part[hit])) + 1, [len(hit)]]) if len(hit) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k = hit[a:b]
            marks = np.zeros(len(k), MARKS)
            marks["doc_id"], marks["at"], marks["bits"] = doc[k], place[k], bits[k]
            out.append((int(part[k[0]]), marks.tobytes()))
        return pa.Table.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], names=["part", "payload"])

    @given_back
    def remove(key, table, answers):
        rows = answers.filter(answers["payload"].is_null())
        marks = np.concatenate([np.zeros(0, MARKS), *(np.frombuffer(x, MARKS) for x in answers["payload"].to_pylist() if x is not None)])
        marks = marks[np.argsort(marks["doc_id"], kind="stable")]
        done = []
        for found, at, first in chosen(table["packed"].to_pylist(), rows):
            own = found.take(pa.array(at, pa.int64()))
            ids = own["doc_id"].to_numpy()
            lo, hi = np.searchsorted(marks["doc_id"], ids, "left"), np.searchsorted(marks["doc_id"], ids, "right")
            out = {name: [] for name in fields.names}
            for k, (doc_id, is_first, text) in enumerate(zip(ids.tolist(), first, own["text"].cast(pa.binary()))):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                n = len(data)
                begins = np.zeros(n + 1, dtype=np.int32)
                if not is_first:
                    begins[: max(n - LENGTH + 1, 0)] = 1
                m = marks[lo[k] : hi[k]]
                for bit in range(PLACES):
                    begins[m["at"][(m["bits"] >> np.uint32(bit)) & 1 == 1].astype(np.int64) + bit] = 1
                sums = np.cumsum(begins)
                covered = (sums[:n] - np.concatenate([np.zeros(min(LENGTH, n), np.int32), sums[: max(n - LENGTH, 0)]])) > 0
                for name, value in zip(fields.names, row_of(doc_id, data, covered)):
                    out[name].append(value)
            done.append(pa.table([*(pa.array(out[f.name], f.type) for f in fields), *(own[name] for name in carry)], names=[*fields.names, *carry]))
        return pa.concat_tables(done)

    counts = answered(dealt_docs.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(send, SENT_DDL), 2)
    offers = dealt_docs.groupBy("part").cogroup(with_firsts(counts).groupBy("part")).applyInArrow(offer, SENT_DDL)
    marks = offers.groupBy("bucket").applyInArrow(mark, "part int, payload binary")
    return dealt_docs.groupBy("part").cogroup(with_firsts(marks).groupBy("part")).applyInArrow(remove, StructType([*ddl.fields, *(docs.schema[name] for name in carry)]))


def remove_repeats(documents: DataFrame, *, with_kept: bool = True, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document."""

    def row(doc_id: int, data: np.ndarray, covered: np.ndarray) -> tuple:
        kept = data[~covered].tobytes()
        return doc_id, len(data), len(data) - len(kept), int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_kept else None

    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    return _removed(documents, fields, StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"), row, heavy=heavy)


def _fragment_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(text))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_bytes[text] * power)])
    return mixed((sums[starts[1:]] - sums[starts[:-1]]) * inverse[starts[:-1]])


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents with what remains of their texts; n_chars, if they have it, follows. Letters that a removal cut through go.

    Rows without a doc_id stay as they are; of rows that repeat a doc_id one stays. Other columns
    are kept, whatever their names.
    """
    others = [f for f in documents.schema.fields if f.name not in ("doc_id", "text")]
    rows = documents.select("doc_id", "text", *([F.struct(*(F.col(f"`{f.name}`") for f in others)).alias("others")] if others else []))
    carry = ("others",) if others else ()

    def row(doc_id: int, data: np.ndarray, covered: np.ndarray) -> tuple[int, str]:
        return doc_id, data[~covered].tobytes().decode("utf-8", "ignore")

    kept = _removed(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), StructType.fromDDL("doc_id long, text string"), row, carry)
    own = {"doc_id": F.col("doc_id").cast(documents.schema["doc_id"].dataType), "text": F.col("text")} | {f.name: F.col("others").getField(f.name) for f in others}
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType)
    return kept.select(*(own[name].alias(name) for name in documents.columns)).unionByName(documents.filter("doc_id IS NULL"))
