import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelane.llm.packing import ChunkIds, FirstFit, pack, packed, pieces_of

TEXTS = [None, "", "One two, don't 3,000 stop.", "Ünïcode spaces\x1c\x1d here é <|endoftext|>x", "word " * 9000, "a\tb\x0bc\r\nd", "Word... word.) it's. 3,000; É! x?! <|EndOfText|> <|startoftext|>. A.B", "same", "same"]


def test_first_fit_matches_a_plain_search():
    sizes = np.random.default_rng(1).integers(1, 100, 500)
    room, expected = [], []
    for s in sizes.tolist():
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= s
        expected.append(b)
    fit = FirstFit(100, len(sizes))
    assert [fit.place(s) for s in sizes.tolist()] == expected


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_pieces_hold_each_id_once_with_no_gap(n):
    sizes = np.random.default_rng(n).integers(1, 5000, n)
    doc, start, length, bins, offset = pieces_of(sizes, 2048)
    assert length.sum() == sizes.sum()
    for d in range(n):
        at = np.argsort(start[doc == d])
        assert (np.cumsum(np.r_[0, length[doc == d][at]])[:-1] == start[doc == d][at]).all()
    ends = {}
    for b in set(bins.tolist()):
        at = np.argsort(offset[bins == b])
        assert (np.cumsum(np.r_[0, length[bins == b][at]])[:-1] == offset[bins == b][at]).all()
        ends[b] = int(length[bins == b].sum())
    assert all(e <= 2048 for e in ends.values())
    assert sum(2048 - e for e in ends.values() if e & (e - 1)) <= 0.01 * sizes.sum() + 2048


def test_pack_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x")], "doc_id long, text string, sequence_id string")
    rows = pack(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)
    assert sum(r.doc_id is None for r in rows) == 1


def test_pack_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decreasing_order_is_used():
    bins, offsets = packed(np.array([10, 90, 50, 50]), 100)
    assert bins.tolist() == [0, 0, 1, 1] and offsets.tolist() == [90, 0, 0, 50]


def test_other_tokenizers_get_whole_texts(spark):

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {1: "The Tide, TURNS  slowly.\n\nX", 2: "", 3: None, 4: " <|endoftext|> é"}
    rows = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path).orderBy("doc_id", "start").collect()
    got = {i: np.frombuffer(b"".join(bytes(r.ids) for r in rows if r.doc_id == i), "<u4").tolist() for i in texts}
    known = Tokenizer.from_file(path)
    assert got == {i: [*known.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}


def test_repeated_rows_part(spark):
    """Rows that are equal in all columns are spread over the groups like any others."""
    docs = spark.createDataFrame([(None, "word " * 400)] * 400, "doc_id long, text string")
    rows = pack(docs, group_bytes=40_000, with_ids=False).selectExpr("sequence_id >> 32 AS g", "length").groupBy("g").sum("length").collect()
    sizes = [r["sum(length)"] for r in rows]
    assert len(sizes) == 21 and max(sizes) < 2.5 * sum(sizes) / len(sizes)


class Counted:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.strings += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_new_words_are_tokenised_together():
    """Many different words are few strings for the tokenizer, and have the ids of the whole text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    words = ["".join(w) + end for w, end in zip(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüñß"), (6000, 9)), rng.choice(["", ",", ".", "?!", ")"], 6000))]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 6000, 100)]
    known = ChunkIds(path)
    counted = [Counted(t) for t in vars(known).values() if hasattr(t, "encode_batch_fast")]
    vars(known).update({k: next(c for c in counted if c.tokenizer is t) for k, t in vars(known).items() if hasattr(t, "encode_batch_fast")})
    got = list(known.of(texts))
    plain = Tokenizer.from_file(path)
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sum(c.strings for c in counted) < 2000


ODD = ["İstanbul", "don't", "rock'n'roll's.", "x'", "'s", "-'s", "á", "́abc", "한", "ÀB<|endoftext|>CD's", "9a9.", "naïve's.", "ﬁne", "²", "ªº", "ŉ", "ΣΑΣ.", "A'LL", "...", "ab.cd", "3.é,", "ǅ", "\U0001d400b", "क्षि", "ab\x00c", "x̸=", "≠"]


def test_odd_chunks_have_the_ids_of_the_whole_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(6)
    texts = [*ODD, *(" ".join(rng.choice([*ODD, "same", "Words,"], 40)) for _ in range(300))]
    plain, known = Tokenizer.from_file(path), ChunkIds(path)
    assert list(known.of(texts)) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
