from itertools import combinations

import numpy as np
import pytest

from tidelane.llm.decontamination import INSIDE_WORDS, LONG_WORDS, MASKS, MIN_IDENTITY, MIN_WORDS, best_run, clean, least_matched, overlaps, own_masks

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew some strong potion tonight".split()


def mixed_in(changes=(), pad=30):
    w = list(ITEM)
    for k in changes:
        w[k] = "other"
    filler = [f"f{k}" for k in range(pad)]
    return " ".join(filler + w + filler)


def test_masks_find_every_overlap_of_14_words_with_two_changed():
    for changed in combinations(range(14), 2):
        assert any(all(m[i] == "0" or p + i not in changed for i in range(len(m))) for m in MASKS for p in range(14 - len(m) + 1))


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(0, mixed_in()), (1, mixed_in((4, 11))), (2, mixed_in(range(0, 16, 2))), (3, " ".join(ITEM[:6])), (4, None), (5, ""), (6, "tiny item Here"), (9, "a tiny item here, in a longer text"), (10, "the"), (7, "word " * 40_000 + mixed_in((7,))), (8, mixed_in((15,)) + " " + mixed_in()), (None, mixed_in())]
    docs += [(11, "before such an item of eight words, no more after"), (12, "such an item of"), (13, "and such one item of eight words, no more of it")]
    bench = [(0, " ".join(ITEM).upper(), "x"), (1, None, "x"), (2, "", "x"), (3, "tiny ITEM here", "x"), (0, " ".join(ITEM), "x"), (4, "the", "x"), (5, "such an item of eight words, no more", "x")]
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int"), spark.createDataFrame(bench, "item_id long, text string, doc_id string")


def test_substitutions_are_tolerated(tables):
    got = {(r.doc_id, r.item_id): r for r in overlaps(*tables).collect()}
    assert set(got) == {(0, 0), (1, 0), (6, 3), (7, 0), (8, 0), (None, 0), (10, 4), (11, 5), (13, 5)}
    assert (got[1, 0].n_words, got[1, 0].n_matched, got[1, 0].start) == (17, 15, 30)
    assert got[7, 0].start == 40_030 and got[8, 0].n_matched == 17


def test_blocks_of_items_give_the_same(tables):
    assert sorted(map(str, overlaps(*tables, block_bytes=60).collect())) == sorted(map(str, overlaps(*tables).collect()))


def test_clean_keeps_whole_rows(tables):
    docs, bench = tables
    kept = clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 9, 12]
    assert clean(docs.limit(0), bench).count() == 0 and clean(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("changed", [0.1, 0.2, 0.3, 0.5])
def test_best_run_is_that_of_an_exhaustive_search(changed):
    rng = np.random.default_rng(int(changed * 10))
    for n in [0, 1, 2, *rng.integers(3, 60, 150)]:
        same = rng.random(n) >= changed
        sums = np.concatenate([[0], np.cumsum(same)]).tolist()
        every = [(sums[b] - sums[a], a - b, -a) for a in range(n) for b in range(a + 1, n + 1) if sums[b] > sums[a] and 5 * (sums[b] - sums[a]) >= 4 * (b - a)]
        most, less, start = max(every, default=(0, 0, 0))
        assert best_run(same, 0.8) == (-start, -start - less, most)


def test_exact_runs_between_changed_stretches_are_found(spark):
    words = [f"w{k}" for k in range(51)]
    text = [w if k % 19 < 13 else "other" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_words, r.n_matched) for r in overlaps(docs, bench).collect()] == [(1, 7, 32, 26)]
    assert [r.doc_id for r in clean(docs, bench).collect()] == [2]


def test_many_items_with_one_passage_are_met_one_document_at_a_time(spark):
    words = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(i, f"d{i} {words} e{i} " + " ".join([words] * 20)) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"x{i} {words} y{i}") for i in range(40)], "item_id long, text string")
    got = overlaps(docs, bench).collect()
    assert len(got) == 30 * 40 and all((r.n_words, r.n_matched) == (12, 12) for r in got)


@pytest.mark.parametrize("n", range(INSIDE_WORDS, LONG_WORDS))
def test_short_items_are_never_missed(n):
    least = least_matched(n, MIN_WORDS, MIN_IDENTITY)
    masks = own_masks(n, least)
    assert all(len(m) == n for m in masks) and [sum(int(m[i]) for m in masks) for i in range(n)] == [1] * n
    for changed in combinations(range(n), n - least):
        assert any(all(m[i] == "0" for i in changed) for m in masks)


def brute(docs, items):
    """Every document and item with their best run, by looking at all diagonals."""
    out = {}
    for d, text in docs:
        w = text.lower().split()
        for k, item in items:
            v = item.lower().split()
            least = min(10, -(-4 * len(v) // 5))
            if len(v) < INSIDE_WORDS:
                if w == v:
                    out[d, k] = (len(v), -len(v), 0)
                continue
            for shift in range(1 - len(v), len(w)):
                same = [0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(v)]
                sums = np.concatenate([[0], np.cumsum(same)]).tolist()
                for a in range(len(v)):
                    for b in range(a + 1, len(v) + 1):
                        if same[a] and same[b - 1] and sums[b] - sums[a] >= least and 5 * (sums[b] - sums[a]) >= 4 * (b - a):
                            out[d, k] = max(out.get((d, k), (0, 0, 0)), (sums[b] - sums[a], a - b, -(shift + a)))
    return out


def test_recall_by_length_and_change_against_all_diagonals(spark):
    """Every item of under fourteen words that meets the threshold is found; of longer ones nearly all."""
    rng = np.random.default_rng(12)
    items = [(n, " ".join(f"w{n}_{k}" for k in range(n))) for n in [1, 2, 3, 4, *range(5, 20), 30]]
    docs = []
    for n, text in items:
        for _ in range(40):
            w = text.split()
            for k in rng.choice(n, rng.integers(0, max(1, round(0.3 * n)) + 1), replace=False):
                w[k] = "other"
            docs.append((len(docs), " ".join(["x"] * rng.integers(0, 3) + w + ["y"] * rng.integers(0, 3))))
    got = {(r.doc_id, r.item_id): (r.n_matched, -r.n_words, -r.start) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    missed = [k for k in set(want) - set(got)]
    assert all(k[1] >= LONG_WORDS for k in missed) and len(missed) <= 0.05 * sum(k[1] >= LONG_WORDS for k in want)


def test_repeated_and_null_ids(spark):
    two = [(5, mixed_in((4,))), (5, mixed_in((4, 11, 13))), (None, mixed_in()), (None, mixed_in((2,)))]
    bench = spark.createDataFrame([(0, " ".join(ITEM)), (None, " ".join(ITEM))], "item_id long, text string")
    for rows in (two, two[::-1]):
        got = sorted((r.doc_id or -1, -1 if r.item_id is None else r.item_id, r.n_matched) for r in overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
        assert got == [(-1, -1, 16), (-1, -1, 17), (-1, 0, 16), (-1, 0, 17), (5, -1, 14), (5, -1, 16), (5, 0, 16)]
