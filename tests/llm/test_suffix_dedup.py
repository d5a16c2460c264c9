import hashlib
import random

import numpy as np
import pytest

from brute import kept_bytes
from tidelane.llm.suffix_dedup import RunLengthIndex, deduplicated, marks_of, ranks, remove_repeats, repeated, single, sorted_strings

SCHEMA = "doc_id long, text string, kept string, n_chars long"


def texts(seed):
    rng = random.Random(seed)
    def chars(n, letters="abcdé ñ"):
        return "".join(rng.choice(letters) for _ in range(n))

    passages = [chars(rng.randint(45, 200)) for _ in range(6)]
    rows = {}
    for i in range(60):
        rows[(i * 7) % 61] = "".join(rng.choice([chars(rng.randint(0, 60)), rng.choice(passages), rng.choice(passages)[5:70]]) for _ in range(rng.randint(0, 6)))
    rows |= {100: None, 101: "", 102: "a" * 500, 103: "a" * 60, 104: "short", 105: "short", 106: rows[3], 107: rows[3], 108: "ab" * 900, 109: passages[0][:49], 110: passages[0][:50]}
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_bytes_match_brute_force(spark, seed):
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows.items()], SCHEMA)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    for i, (data, covered) in kept_bytes(rows).items():
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(data), sum(covered), spans, kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    whole = {r.doc_id: r for r in deduplicated(docs).collect()}
    assert all(whole[i].text == bytes(got[i].kept).decode("utf-8", "ignore") and whole[i].kept == "clash" and whole[i].n_chars == len(whole[i].text) for i in rows)


def test_null_ids_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 80, "k", 80)] * 2 + [(None, "x" * 80, "k", 80)], SCHEMA)
    assert [(r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()] == [(1, 0)]
    assert sorted((r.doc_id is None, r.text) for r in deduplicated(docs).collect()) == [(False, "x" * 80), (True, "x" * 80)]
    assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_index_and_marks_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 98 + seed % 4, 300, dtype=np.uint8) if seed % 5 else rng.integers(0, 3, 300, dtype=np.uint8)
    raw, width = text.tobytes(), int(rng.integers(1, 27))
    order, number = sorted_strings(text, width)
    assert order.tolist() == sorted(range(len(raw)), key=lambda k: (raw[k : k + width], k))
    assert number.tolist() == [sorted({raw[k : k + width] for k in range(300)}).index(raw[k : k + width]) for k in order]
    starts = np.concatenate([[0], np.sort(rng.choice(np.arange(1, 300), 12, replace=False)), [300]])
    docs = np.sort(rng.integers(0, 6, 13))
    index = RunLengthIndex(text, width)
    pattern = np.concatenate([rng.integers(97, 98 + seed % 4 + 1, 60, dtype=np.uint8), text[40:90], np.zeros(1, np.uint8), text[-9:]])
    asked = pattern.tobytes()
    ends = np.sort(rng.choice(np.arange(1, len(asked)), 5, replace=False))
    begins, ends = np.concatenate([[0], ends]), np.concatenate([ends, [len(asked)]])
    for step, (k, length) in enumerate(index.stream(pattern, begins, ends)):
        for end, n in zip(ends[k].tolist(), length.tolist()):
            a = end - 1 - step
            assert n == max(m for m in range(min(width, end - a) + 1) if asked[a : a + m] in raw)


def fragments(rng, n, letters):
    """Fragments as buckets get them: some letters, a code of 8, and more, so that every window of 26 has the whole code."""
    slot, left, made = rng.integers(0, 4, n), [], []
    for s in slot.tolist():
        m = int(rng.integers(1, 20))
        left.append(int(rng.integers(m - 1, 19)))
        made.append(np.concatenate([rng.integers(97, 97 + letters, left[-1]), np.full(8, 200 + s), rng.integers(97, 97 + letters, 25 + m - 8 - left[-1])]).astype(np.uint8))
    return slot, np.array(left), np.concatenate(made), np.concatenate([[0], np.cumsum([len(x) for x in made])])


def plain_marks(slot, text, starts, docs):
    raw, first = text.tobytes(), {}
    spans = list(zip(starts.tolist(), starts[1:].tolist(), docs.tolist(), slot.tolist()))
    for a, b, d, s in spans:
        for k in range(a, b - 25):
            first[s, raw[k : k + 26]] = min(first.get((s, raw[k : k + 26]), 10**9), d)
    return [sum((first[s, raw[k : k + 26]] < d) << k - a for k in range(a, b - 25)) for a, b, d, s in spans]


@pytest.mark.parametrize("seed", range(12))
def test_earlier_documents_mark_later_ones(seed, monkeypatch):
    """Against a dictionary of all windows; matches fall short of the window, and without them no mark is made."""
    rng = np.random.default_rng(seed)
    slot, left, text, starts = fragments(rng, 60, 1 + seed % 3)
    docs = rng.integers(0, [3, 9, 100][seed % 3], 60)
    lengths = []
    plain = RunLengthIndex.stream

    def noted(self, *args, **how):
        for k, length in plain(self, *args, **how):
            lengths.append(length.copy())
            yield k, length

    monkeypatch.setattr(RunLengthIndex, "stream", noted)
    got = repeated(text, starts, docs, slot, left)
    assert got.tolist() == plain_marks(slot, text, starts, docs)
    assert marks_of(slot, text, starts, docs, left).tolist() == got.tolist()
    last = np.concatenate(lengths)
    assert (last < 26).any() and ((last == 26).any() or not got.any())
    monkeypatch.setattr(RunLengthIndex, "stream", lambda self, *args, **how: iter(()))
    assert not repeated(text, starts, docs, slot, left).any()


def test_runs_and_samples_are_all_that_is_kept():
    """On a text of many like copies what the index holds, beside the letters, follows its runs."""
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 400, dtype=np.uint8)
    few, many = (RunLengthIndex(np.concatenate([np.append(base, i % 7) for i in range(n)]).astype(np.uint16), 26) for n in (20, 200))
    held = [sum(len(v) for name, v in vars(x).items() if isinstance(v, np.ndarray) and name != "seven") for x in (few, many)]
    assert held[1] < 1.5 * held[0] and many.n == 10 * few.n


def test_equal_fragments_and_crowded_slots():
    rng = np.random.default_rng(3)
    slot, left, text, starts = fragments(rng, 12, 2)
    pick = rng.integers(0, 12, 200)
    made = [text[a:b] for a, b in zip(starts, starts[1:])]
    docs, text = rng.integers(0, 40, 200), np.concatenate([made[k] for k in pick])
    starts = np.concatenate([[0], np.cumsum([len(made[k]) for k in pick])])
    assert marks_of(slot[pick], text, starts, docs, left[pick]).tolist() == plain_marks(slot[pick], text, starts, docs)
    assert ranks(np.array([1, 1, 0, 1, 1]), np.array([5, 3, 9, 5, 8])).tolist() == [1, 0, 0, 1, 2]


def test_strings_of_a_heavy_anchor_travel_alone():
    heavy, at, first, last = np.array([True, False, True]), np.array([9, 30, 60]), np.array([5, 20, 60]), np.array([7, 30, 60])
    got = single(heavy, at, first, last)
    assert [x.tolist() for x in got] == [[9, 9, 9, 30, 60], [5, 6, 7, 20, 60], [5, 6, 7, 30, 60]]


def test_heavy_anchors_give_the_same_marks_in_smaller_groups(spark):
    rng = random.Random(5)
    line = "this stock line of forty-nine bytes is in them all"[:49]
    def chars(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    rows = {i: chars(40) + line + chars(40) for i in range(60)} | {100 + i: chars(9) + rows_ for i, rows_ in enumerate([chars(30) + line + "same end"] * 4)} | {200: "a" * 300, 201: "b" + "a" * 200}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows.items()], SCHEMA)
    for heavy in (1, 10):
        got = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, heavy=heavy).collect()}
        assert got == {i: bytes(b for b, c in zip(data, covered) if not c) for i, (data, covered) in kept_bytes(rows).items()}
