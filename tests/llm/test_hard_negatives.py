import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelane.llm.hard_negatives import first_of, hard_negatives, partial_tile

SCHEMA = "vec_id long, label int, embedding array<double>, anchor string, x int"


def brute(rows, scale, positives=5, negatives=5):
    sound = [(i, la, [math.floor(scale * x) for x in v]) for i, la, v, *_ in rows if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _, _ in sound if i % 10 == 0}):
        _, own, q = min((r for r in sound if r[0] == i), key=lambda r: (r[1], r[2]))
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j, la) for j, la, v in sound if j != i), key=lambda s: s[:2])
        for s, j, _ in [s for s in scored if s[2] == own][:positives]:
            hits = [(k, t) for t, k, la in scored if la != own and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (k, t) in enumerate(hits, 1)]
    return sorted(out)


def vectors(n=260, dims=9, labels=4, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, *range(labels)]), [rng.choice([0.5, 1.0, -0.25, rng.random()]) for _ in range(dims)], "mine", 1) for i in range(n)]
    rows += [(n, None, [1.0] * dims, "", 1), (n + 1, 1, None, "", 1), (n + 2, 1, [None] * dims, "", 1), (n + 3, 1, [math.nan] * dims, "", 1), (n + 4, 2, [math.inf] * dims, "", 1), (None, 1, [1.0] * dims, "", 1)]
    rows += [(n + 10, 1, [], "", 1), (n + 20, 3, [9.0] * (dims - 4), "", 1), (20, 0, [0.75] * dims, "", 1), rows[3], rows[3], rows[5]]
    return rows


@pytest.mark.parametrize("tile", [{}, {"tile_rows": 16, "tile_anchors": 4, "chunk": 2}, {"tile_rows": 50, "tile_anchors": 3, "chunk": 4}])
def test_against_brute_force(spark, tile):
    rows = vectors()
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **tile)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 256)


def test_one_label_and_hot_label(spark):
    rows = [(i, 7, [float(i % 5), 1.0], "", 0) for i in range(120)]
    assert hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, tile_rows=16).count() == 0
    rows += [(1000 + i, i, [1.0, 1.0], "", 0) for i in range(100, 130)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, tile_rows=16, tile_anchors=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 256)


def test_scores_beyond_exact_doubles(spark):
    rows = [(0, 1, [2.0**20, 1.0], "", 0), (1, 1, [2.0**18, 3.0], "", 0), (2, 2, [2.0**18, 2.0], "", 0), (3, 2, [2.0**18 - 1, 0.0], "", 0)]
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()))
    assert got == [r for r in brute(rows, 256) if r[0] == 0] and len(got) == 2
    with pytest.raises(PySparkException):
        hard_negatives(spark.createDataFrame([*rows, (4, 1, [1e300, 0.0], "", 0)], SCHEMA), F.col("vec_id") == 0).collect()


def test_empty_tables(spark):
    rows = spark.createDataFrame(vectors(), SCHEMA)
    assert hard_negatives(rows.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives(rows, F.lit(False)).count() == 0


def test_pieces():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(1 << 40), 1 << 40, (5, 7)), rng.integers(-(1 << 12), 1 << 12, (6, 7))
    assert partial_tile(x, y).tolist() == [[sum(a * b for a, b in zip(p, q)) for q in y.tolist()] for p in x.tolist()]
    scores, ids = rng.integers(0, 9, 100), rng.permutation(100)
    assert ids[first_of(scores, ids, 5)].tolist() == [i for _, i in sorted(zip((-scores).tolist(), ids.tolist()))[:5]]
