"""Packing of tokenised documents into fixed-length training sequences.

Documents are dealt at random (by a hash of their row's number, so that equal rows part) into groups
of bounded size; each group is packed on its own by first-fit decreasing. A tournament tree over the bins' free room
finds the first bin that takes a piece in O(log bins).

Defined results: a null or empty text has the end id alone; a null doc_id is packed like
any other; repeated rows are packed once each; an empty table gives no rows; extra columns
are ignored. Texts of any length are cut into full sequences and one remainder.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import arrow_table

CAPACITY = 2048
END_ID = 1
#: Text bytes in a group, on average: about a thousand sequences.
GROUP_BYTES = 4_000_000
#: Chunks of text whose ids a worker remembers: about 350 MB.
CACHE = 2_000_000
POINTS = b".,;:!?"

PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class FirstFit:
    """Bins of equal capacity under a tournament tree: each node holds the larger free room of its two children."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = np.full(2 * self.leaves, capacity, dtype=np.int64).tolist()

    def place(self, size: int) -> int:
        """The first bin with room for size; its room shrinks."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        bin_, room = k - self.leaves, tree[k]
        while k > 1:
            other = tree[k ^ 1]
            k //= 2
            room = tree[k] = max(room, other)
        return bin_


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing: each piece's bin and its offset there. No size exceeds the capacity."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fit, filled = FirstFit(capacity, len(sizes)), {}
    for i in order.tolist():
        size = int(sizes[i])
        bins[i] = b = fit.place(size)
        offsets[i] = filled.get(b, 0)
        filled[b] = filled.get(b, 0) + size
    return bins, offsets


def pieces_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Document, start, length, bin and offset of each piece of a group.

    Full sequences are cut off first and the remainders are packed; then the emptiest bins
    are dissolved into the gaps of the others, and what is left of them becomes sequences
    whose lengths are powers of two, which need no padding.
    """
    docs, starts, lengths, bins, offsets = [], [], [], [], []

    def put(doc, start, length, bin_, offset):
        docs.append(doc), starts.append(start), lengths.append(length), bins.append(bin_), offsets.append(offset)

    used = 0
    rest = sizes % capacity
    for doc in np.flatnonzero(sizes >= capacity).tolist():
        for k in range(int(sizes[doc]) // capacity):
            put(doc, k * capacity, capacity, used, 0)
            used += 1
    tails = np.flatnonzero(rest)
    tail_bins, tail_offsets = packed(rest[tails], capacity)
    n_bins = int(tail_bins.max()) + 1 if len(tails) else 0
    fill = np.bincount(tail_bins, weights=rest[tails], minlength=n_bins).astype(np.int64)
    by_fill = np.argsort(fill, kind="stable")
    room = n_bins * capacity - int(fill.sum())
    gone, freed = set(), 0
    for b in by_fill.tolist():  # dissolve while the other bins' gaps take it all
        freed += int(fill[b])
        room -= capacity - int(fill[b])
        if freed > room:
            freed -= int(fill[b])
            break
        gone.add(b)
    last = next((b for b in by_fill.tolist() if b not in gone and fill[b] < capacity), None)
    if last is not None:
        gone.add(last)
    number, loose = {}, []
    for doc, b, o in sorted(zip(tails.tolist(), tail_bins.tolist(), tail_offsets.tolist()), key=lambda x: (x[1], x[2])):
        if b in gone:
            loose.append([doc, int(sizes[doc]) - int(rest[doc]), int(rest[doc])])
        else:
            put(doc, int(sizes[doc]) - int(rest[doc]), int(rest[doc]), used + number.setdefault(b, len(number)), o)
    gaps = [(used + number[b], int(fill[b])) for b in number if fill[b] < capacity]
    used += len(number)
    left = sum(x[2] for x in loose)
    targets = [(b, o, capacity) for b, o in gaps]
    spare = left - sum(capacity - o for _, o in gaps)
    while spare > 0:
        length = capacity if spare >= capacity else 1 << (spare.bit_length() - 1)
        targets.append((used, 0, length))
        used += 1
        spare -= length
    loose.reverse()
    for b, o, end in targets:
        while o < end and loose:
            doc, start, length = loose[-1]
            take = min(length, end - o)
            put(doc, start, take, b, o)
            o += take
            if take == length:
                loose.pop()
            else:
                loose[-1] = [doc, start + take, length - take]
    return tuple(np.array(x, dtype=np.int64) for x in (docs, starts, lengths, bins, offsets))


#: The normaliser and pre-tokeniser of the files that work chunk by chunk.
BY_CHUNK = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


#: A chunk of printable ASCII without A-Z, and the pre-tokeniser's pieces of it.
PLAIN, PIECES = re.compile(rb"[!-@\[-~]+"), re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Words that are given to the tokenizer as one text.
TOGETHER = 64


class ChunkIds:
    """The ids of texts, as little-endian unsigned 32-bit bytes.

    A tokenizer with the settings of BY_CHUNK drops white space and no token crosses it, so a text's
    ids are those of the chunks between ASCII white space, in a row. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_chunk = (settings["normalizer"], settings["pre_tokenizer"]) == BY_CHUNK and all(t["content"].startswith("<|") for t in settings["added_tokens"])
        self.known: dict[bytes, bytes] = {}
        #: For words of a-z, which the normaliser and the bytes' alphabet leave as they are.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Which ids end a word; None where a word's end can't be told by its last id.
        self.ends = None
        suffix, vocab = settings["model"].get("end_of_word_suffix"), settings["model"].get("vocab")
        if self.by_chunk and suffix and all(byte + suffix in vocab for byte in pre_tokenizers.ByteLevel.alphabet()):
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        for first in range(0, len(texts), 256):
            if not self.by_chunk:
                encoded = self.tokenizer.encode_batch_fast([t or "" for t in texts[first : first + 256]], add_special_tokens=False)
                yield from (array("I", e.ids).tobytes() for e in encoded)
                continue
            raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[first : first + 256]]
            chunks = [(r if b"<|" in r else r.lower()).split() for r in raw]  # the tokenizer lower-cases all but the special tokens' strings
            if len(self.known) > CACHE:
                self.known.clear()
            found = [list(map(self.known.get, c)) for c in chunks]
            gaps = [[i for i, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
            if new := {c[i] for c, lacking in zip(chunks, gaps) for i in lacking}:
                self.learn(new)
            for c, f, lacking in zip(chunks, found, gaps):
                for i in lacking:
                    f[i] = self.known[c[i]]
                yield b"".join(f)

    def learn(self, new: set[bytes]) -> None:
        """Remembers the chunks' ids. A token never spans two pieces of a chunk, nor a letter and the points after it, so these have ids of their own."""
        split, single, plain, words, others = {}, set(), [], [], []
        for c in new:
            word = c.rstrip(POINTS)
            if word.isalpha() or word and not word.isascii() and (word[-1:].isalnum() or _is_word(word)):
                if len(word) < len(c):
                    split[c] = word, c[len(word) :]
                    single.update(split[c])
                else:
                    single.add(c)
            elif PLAIN.fullmatch(c) and b"<|" not in c:
                split[c] = PIECES.findall(c)
                single.update(split[c])
            else:
                single.add(c)
        for c in single.difference(self.known):
            if c.isalpha() and c.islower():
                plain.append(c)
            elif not c.isascii() and _is_word(c):
                words.append(c)
            else:
                others.append(c)
        for kind, tokenizer in ((plain, self.plain), (words, self.tokenizer)):
            others += self.learn_words(kind, tokenizer)
        encoded = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in others], add_special_tokens=False)
        self.known.update(zip(others, (array("I", e.ids).tobytes() for e in encoded)))
        self.known.update((c, b"".join(map(self.known.__getitem__, pieces))) for c, pieces in split.items())

    def learn_words(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Remembers the words' ids, many words given as one text, and gives those whose ids can't be told apart."""
        if self.ends is None:
            return words
        runs = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        left = []
        for run, e in zip(runs, tokenizer.encode_batch_fast([b" ".join(run).decode() for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            bounds = np.flatnonzero(self.ends[ids]) + 1
            if len(bounds) != len(run) or bounds[-1] != len(ids):  # a word of several pieces
                left += run
                continue
            data, bounds = ids.tobytes(), [0, *(4 * bounds).tolist()]
            self.known.update((c, data[a:b]) for c, a, b in zip(run, bounds, bounds[1:]))
        return left


def _is_word(c: bytes) -> bool:
    """Whether the chunk is of letters alone."""
    try:
        return c.decode().isalpha()
    except UnicodeDecodeError:
        return False


_chunk_ids: dict[str, ChunkIds] = {}


def pack(documents: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    tokenizer is a file of the tokenizers library, present on every executor; by default the
    installed word_bpe_49k.json. ids holds the piece's ids, little-endian unsigned 32-bit.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    ending = np.array([end_id], dtype="<u4").tobytes()

    def group(key, table):
        if tokenizer is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        else:
            path = tokenizer
        if path not in _chunk_ids:
            _chunk_ids[path] = ChunkIds(path)
        ids = [x + ending for x in _chunk_ids[path].of(table["text"].to_pylist())]
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        doc, start, length, bins, offset = pieces_of(sizes, capacity)
        cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
        return arrow_table(
            PACKED, doc_id=table["doc_id"].combine_chunks().take(pa.array(doc)), start=start, length=length, ids_crc32=[zlib.crc32(x) for x in cut], doc_tokens=sizes[doc],
            sequence_id=bins + (key[0].as_py() << 32), offset=offset, ids=cut if with_ids else [None] * len(cut),
        )

    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    dealt = docs.select(own.alias("group"), "doc_id", "text")
    return dealt.groupBy("group").applyInArrow(group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
