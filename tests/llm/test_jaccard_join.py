import random

import numpy as np
import pytest

from brute import components, shingle_set
from pyspark.sql import functions as F
from tidelane.llm.copies import first_copies, keyed
from tidelane.llm.common import hashed
from tidelane.llm.jaccard_join import ORDERS, candidates, links, one_of_each, prefix_length, prefixes, similar_documents, token_sets

SCHEMA = "doc_id long, text string, gone string, component_id long, a long"


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(12)]
    line = [rng.choice(vocabulary) for _ in range(30)]  # a passage that many texts share
    rows = {}
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows[i * 3] = " ".join(line + w if rng.random() < 0.4 else w)
    rows |= {400: None, 401: "", 402: " \n\t", 403: "One two", 404: "one TWO", 405: "x " * 3000, 406: "X " * 2999}
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, "en", 7, 8) for i, t in rows.items()], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(docs).collect()}
    assert got == components(rows)
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 0, 0)] * 3 + [(None, "a b c d e f", "x", 0, 0), (0, "a b c d e f", "x", 0, 0)], SCHEMA)
    assert sorted(map(tuple, similar_documents(docs).collect())) == [(0, 2, 0, 0), (1, 2, 0, 0)]
    assert sum(r.doc_id is None for r in one_of_each(docs).collect()) == 1
    assert similar_documents(docs.limit(0)).count() == 0


def test_prefixes_of_alike_sets_meet_under_every_order():
    rng = np.random.default_rng(5)
    for _ in range(200):
        all_ = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
        a = np.sort(rng.permutation(all_)[:50])
        b = np.sort(np.concatenate([a[: rng.integers(40, 50)], all_[~np.isin(all_, a)][:3]]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        counts = {t: int(rng.integers(2, 9)) for t in all_.tolist()}
        pa, pb = (prefixes(x, np.array([counts[t] if t in set(a.tolist()) & set(b.tolist()) else 1 for t in x.tolist()])) for x in (a, b))
        needed = -(-75 * (len(a) + len(b)) // 175) - max(len(a) - prefix_length(len(a)), len(b) - prefix_length(len(b)))
        assert len(pa) == len(ORDERS) and all(len(np.intersect1d(x, y)) >= max(1, needed) for x, y in zip(pa, pb))


def test_every_order_filters_and_none_loses_a_link(spark):
    """Each order removes candidates, all orders together more than any of them; links stay."""
    rng = random.Random(3)
    rows = {}
    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    pool = [words(50) for _ in range(10)]
    for g in range(30):  # a rare passage that few share, in texts of frequent ones
        rare = words(40)
        for i in range(5):
            w = rare + sum(rng.sample(pool, 3), [])
            rows[g * 10 + i] = " ".join(w)
            if i == 0:
                w[rng.randrange(190)] = "changed"
                rows[g * 10 + 9] = " ".join(w)
    docs = keyed(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    units = token_sets(docs, first_copies(docs), 5, 75)
    prefix = units.select("doc_id", F.explode("prefix_0").alias("t"))
    pairs = prefix.alias("x").join(prefix.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    found = candidates(pairs, units, 75).collect()
    by_order = [sum(r[f"passes_{k}"] for r in found) for k in range(len(ORDERS))]
    passing = {(r.a, r.b) for r in found if all(r[f"passes_{k}"] for k in range(len(ORDERS)))}
    sets = {i: shingle_set(t) for i, t in rows.items()}
    linked = {(a, b) for r in found for a, b in [(r.a, r.b)] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    print("candidates", len(found), "by order", by_order, "together", len(passing), "links", len(linked))
    assert linked and linked <= passing and len(passing) < min(by_order) <= max(by_order) < len(found)
    assert {(r.a, r.b) for r in links(units)[0].collect()} <= linked


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    rows = ["", None, "Ab  cD\x0b\x0cé\x1c x", "ab", "É é", "cd ab"]
    found = [h[a:b].tolist() for _, h, at in hashed(pa.array(rows)) for a, b in zip(at, at[1:])]
    assert [len(f) for f in found] == [0, 0, 4, 1, 2, 2]
    assert found[2][0] == found[3][0] == found[5][1] and found[2][1] == found[5][0] and found[4][0] != found[4][1]
