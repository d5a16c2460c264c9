"""Connected components of an edge list by alternating star contractions.

Each round points every node's neighbours at the least node nearby, first those above the
node (large star), then those below it (small star). The rounds needed grow with the logarithm
of the longest path; no node's neighbours are ever collected, they only meet a minimum. Before the
first round each task replaces the edges it has by stars, a bounded number at a time, which leaves
one edge a node at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.materialise import saved


#: Edges that a task turns into stars at a time.
CONTRACTED = 500_000


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the places 0 to n - 1 the least place that the links a[k] to b[k] connect it with."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        for end in (least[a], least[b], a, b):  # the roots of either side, and the sides themselves
            np.minimum.at(least, end, low)
        least = least[least]
        if (least == before).all():
            return least


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v, with v the least node that the edges of a stretch connect u with."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held))
        held.clear()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        least = least_linked(len(nodes), at[: len(u)], at[len(u) :])
        other = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[least[other]])], names=["u", "v"])

    for rows in batches:
        if rows.num_rows:
            held.append((rows["u"].to_numpy(), rows["v"].to_numpy()))
        if sum(len(u) for u, _ in held) > CONTRACTED:
            yield stars()
    if held:
        yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node in edges(src, dst). Self loops count as nodes."""
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    now = saved(ends.filter("u <> v").mapInArrow(_stars, "u long, v long").distinct())
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        now = saved(_small_star(_large_star(now).distinct()).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = ends.select(F.col("u").alias("node")).unionByName(ends.select(F.col("v").alias("node"))).distinct()
    return nodes.join(now.withColumnRenamed("u", "node").hint("merge"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
