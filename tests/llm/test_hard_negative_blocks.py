"""Hard negatives by blocks: what a task keeps of the tiles, and what is shuffled."""

import random
import time

import numpy as np
from pyspark.sql import functions as F
from test_hard_negatives import SCHEMA, brute

from tidelane.llm.hard_negatives import Best, first_of, hard_negatives


def _shuffled(spark) -> int:
    """Bytes written to shuffles in this session so far, once the last tasks' figures are in."""
    time.sleep(1)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_best_by_pieces():
    """Ties, windows that end at other scores, pieces whose ids lie between those before: as all at once."""
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(-4, 5, (6, 300)), rng.permutation(300)
    high = rng.integers(-3, 5, (6, 3))
    best = Best(high - 4, high, 5)
    for part in np.array_split(np.arange(300), 11):
        part = part[np.argsort(ids[part])]
        best.take(scores[:, part].astype(rng.choice([np.float32, np.int64])), ids[part])
    for i in range(6):
        for w in range(3):
            at = np.flatnonzero((scores[i] > high[i, w] - 4) & (scores[i] <= high[i, w]))
            at = at[first_of(scores[i, at], ids[at], 5)]
            assert best.id[i, w].tolist() == ids[at].tolist() and best.score[i, w].tolist() == scores[i, at].tolist()


def test_blocks_of_several_labels(spark):
    """Labels of one group share blocks, so that a tile has pairs of one label and of two; equal vectors everywhere."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(300), [float(rng.randrange(3)), 1.0, float(rng.randrange(2))], "", 0) for i in range(1500)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 256)


def test_scores_are_not_shuffled(spark):
    """20,000 rows and 1,000 anchors have 20 million scores; what is shuffled is little beside the vectors."""
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.rand(7) + k * 0).alias("embedding"))
    before = _shuffled(spark)
    assert hard_negatives(rows, F.col("vec_id") % 20 == 0).count() > 0
    assert _shuffled(spark) - before < 20_000_000
