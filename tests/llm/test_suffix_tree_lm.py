import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm.suffix_tree_lm import DEPTH, DISCOUNT, MIN_GAIN, STEPS, Question, added_up, scored

SCHEMA = "doc_id long, text string, score string, part long, held_out string"


def corpus(n=150, seed=9):
    rng = random.Random(seed)
    vocabulary = ["The", "quick", "tide", "turns", "é", "slowly.", *(f"w{k}" for k in range(60))]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(5)]
    rows = [(i, " ".join(rng.choice([rng.choice(vocabulary), rng.choice(passages)]) for _ in range(rng.randint(1, 30)))) for i in range(n)]
    rows += [(1000 + i, rng.choice(["one tall ship sails", "two tall ship sinks"])) for i in range(60)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "tide " * 3000), (5, rows[5][1]), (n + 4, "nul\0 word \0"), (None, "tide turns")]


def by_hand(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) of every row, from counts in dictionaries."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    n = [defaultdict(Counter) for _ in range(DEPTH + 1)]
    for ws, out in zip(tokens, held):
        for k in range(len(ws)) if not out else ():
            for d in range(min(DEPTH, k) + 1):
                n[d][tuple(ws[k - d : k])][ws[k]] += 1
    total, kinds = sum(n[0][()].values()), len(n[0][()])
    kept = {}

    def p(c, x):
        """After the longest kept context that ends c."""
        if not c:
            return (n[0][()][x] + 1) / (total + kinds + 1)
        up = p(c[1:], x)
        here = n[len(c)].get(c)
        if here is None or sum(here.values()) < 2:
            return up
        again = {w: k for w, k in here.items() if k >= 2}
        size = sum(here.values())
        rest = size - sum(again.values()) + DISCOUNT * len(again)
        if c not in kept:
            once = size - sum(again.values())
            gain = sum(k * (math.log((k - DISCOUNT) / size) + min(255, round(-STEPS * math.log(p(c[1:], w)))) / STEPS) for w, k in again.items())
            kept[c] = bool(again) and gain + (once * math.log(rest / size) if once else 0) >= MIN_GAIN
        return (max(again.get(x, 0) - DISCOUNT, 0) + rest * up) / size if kept[c] else up

    out = []
    for (i, _), ws, h in zip(rows, tokens, held):
        base = sum(math.log10((n[0][()][w] + 1) / (total + kinds + 1)) for w in ws)
        score = sum(math.log10(p(tuple(ws[max(0, k - DEPTH) : k]), w)) for k, w in enumerate(ws))
        out.append((i, h, len(ws), sum(n[0][()][w] > 0 for w in ws), total, base, score))
    return out, kept


@pytest.mark.parametrize("heavy", [2_000_000, 50])
def test_scores_match_a_tree_built_by_hand(spark, heavy):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    def key(r):
        return r[0] is None, r[0], r[2], r[6]

    got = sorted(map(tuple, scored(docs, heavy=heavy, part_bytes=4000).collect()), key=key)
    want, kept = by_hand(rows)
    assert len(got) == len(want) and {len(c) for c, k in kept.items() if k} == {1, 2} and not all(kept.values())
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-4, rel=1e-6), g[0]


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b", "x", 1, "y") for i in range(40)], SCHEMA)
    assert scored(docs.limit(0)).count() == 0
    out = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = scored(docs.filter(F.col("doc_id").isin(out))).collect()
    assert len(got) == len(out) and all(r.held_out and r.train_tokens == 0 and r.base_score == r.score == 0 for r in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_tree_beats_the_base_on_held_out_texts(spark, sf):
    documents = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    held = scored(documents).filter("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert held.score > held.base and held.better > 0.8


def test_probabilities_after_a_context_sum_to_one():
    counts = {1: 9, 2: 5, 3: 2, 4: 1, 5: 1}
    size = sum(counts.values())
    whole = Question(np.array([7], np.uint64), np.array([size]), np.array([5]), np.array(list(counts), np.uint64), np.array(list(counts.values())), np.full(5, 40, np.uint8))
    halves = [Question(whole.context, whole.total, whole.sizes, whole.next, np.array(n), whole.parent) for n in ([9, 0, 1, 0, 1], [0, 5, 1, 1, 0])]
    for (a,), (b, c) in [(tuple(added_up([whole], 1)), tuple(added_up(halves, 1)))]:
        assert a == b == c
    words, kinds = 16, 3
    rest = size - words + DISCOUNT * kinds
    assert sum(k - DISCOUNT for k in counts.values() if k >= 2) + rest == pytest.approx(size)


def test_questions_travel_whole():
    q = Question(np.array([1 << 8, 1 << 63], np.uint64), np.array([5, 1 << 33]), np.array([2, 1]), np.array([4, 9, 2], np.uint64), np.array([1, 300, 0]), np.array([0, 255, 7], np.uint8))
    got = [Question.read(m) for _, m in q.messages(4)]
    assert [b for b, _ in q.messages(4)] == [0, 2]
    for name in ("context", "total", "sizes", "next", "count", "parent"):
        assert np.concatenate([getattr(x, name) for x in got]).tolist() == getattr(q, name).tolist()
