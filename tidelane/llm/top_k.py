"""Exact top-k by inner product with block-at-a-time pruning.

A vector's dimensions are terms. A task lays its rows out in blocks of neighbours; a block keeps the
rows' values as its forward index, and for each term the largest and the least value in it. A
query's bound for a block sums, over its terms, the query's value times the extreme that suits its
sign. Each query takes blocks in order of its bounds and scores whole blocks through the forward index
until its next bound falls below its kth score so far; ties at the bound are still scored. All
queries take a step at a time together, as one product. The kth scores stand from one batch of rows
to the next, and a task gives each query's k best once, at its end.

Queries go over all rows in groups of bounded size, one after the other, so that the driver and a
task hold one group; a window picks the k best of the tasks' results.

Scores are exact 64-bit integers. Values and their products are summed in doubles only where the
sums stay below 2**53; larger ones are added up as integers. A component that is 2**53 or more when
scaled is an error, and so is a score outside the 64-bit range: never a wrong number.

Defined results: vectors that are null, or hold null or non-finite components, and rows without a
vec_id, take no part; shorter vectors count as padded with zeros; a candidate with the query's own
vec_id is the query itself; repeated rows of a query count as one query, repeated candidates each
count; equal scores go to the smaller vec_id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.common import batch, bounded, scaled
from tidelane.operators.materialise import saved

SCALE = 1024
BLOCK_ROWS = 64
#: Queries in a group, at most: about 10 MB of 64 dimensions.
GROUP_QUERIES = 20_000
#: Queries that take a step together, at most.
STEP_QUERIES = 512
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of the components, of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound).select("vec_id", F.transform("x", lambda v: scaled(v, scale)).alias("x"))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def small(*arrays: np.ndarray) -> bool:
    """Whether doubles hold all sums of products of the arrays' rows exactly."""
    most = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in arrays]
    return most[0] * most[1] * max(x.shape[-1] for x in arrays) < 1 << 53


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, as exact integers."""
    if small(x, q[None]):
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    most = sum(abs(a) * b for a, b in zip(q.tolist(), [max(-lo, hi) for lo, hi in zip(x.min(0).tolist(), x.max(0).tolist())]))
    if most >= 1 << 63:
        big = x.astype(object) @ q.astype(object)
        if any(not -(1 << 63) <= v < 1 << 63 for v in big):
            raise OverflowError("an inner product is outside the 64-bit range")
        return big.astype(np.int64)
    return x @ q


class Blocks:
    """A batch's rows in blocks of neighbours, so that a block's extremes lie close."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: int = BLOCK_ROWS):
        order = self.layout(x, rows)
        self.ids, self.x = ids[order], x[order]
        self.at = np.arange(0, len(ids), rows)
        self.top, self.low = np.maximum.reduceat(self.x, self.at, axis=0).astype(float), np.minimum.reduceat(self.x, self.at, axis=0).astype(float)
        self.rows, self.scored = rows, 0

    @staticmethod
    def layout(x: np.ndarray, rows: int) -> np.ndarray:
        """Splits at the median of the widest dimension, again and again: an order of the rows in which neighbours are alike."""
        runs, done = [np.arange(len(x))], []
        while runs:
            k = runs.pop()
            if len(k) <= rows:
                done.append(k)
                continue
            d = int(np.argmax(x[k].var(axis=0)))
            half = -(-len(k) // (2 * rows)) * rows
            by = np.argsort(x[k, d], kind="stable")
            runs += [k[by[half:]], k[by[:half]]]
        return np.concatenate(done)

    def improve(self, best: Best, first: int, q: np.ndarray) -> None:
        """Better rows for the queries `first` and on, whose vectors are q."""
        wide = q.astype(float)
        bounds = np.maximum(wide, 0) @ self.top.T + np.minimum(wide, 0) @ self.low.T
        exact = small(self.x, q)
        if not exact:  # above what rounding may have taken off
            bounds += np.abs(bounds) * 2.0**-40 + 1
        order = np.argsort(-bounds, axis=1, kind="stable")
        forward = self.x.astype(float) if exact else self.x
        going = np.arange(len(q))
        for step in range(len(self.at)):
            block = order[going, step]
            on = ~best.full(first + going) | (bounds[going, block] >= best.kth(first + going))
            going, block = going[on], block[on]
            if not len(going):
                return
            self.scored += len(going)
            rows = self.at[block][:, None] + np.arange(self.rows)
            there = rows < len(self.ids)
            rows = np.minimum(rows, len(self.ids) - 1)
            if exact:
                scores = np.matmul(forward[rows], wide[going][:, :, None])[:, :, 0].astype(np.int64)
            else:
                scores = np.stack([products(forward[r], q[i]) for r, i in zip(rows, going.tolist())])
            best.take(first + going, self.ids[rows], scores, there)


class Best:
    """The k best rows so far of every query."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.ids, self.scores = np.zeros((len(own), k), np.int64), np.zeros((len(own), k), np.int64)
        self.n = np.zeros(len(own), np.int64)

    def full(self, i: np.ndarray) -> np.ndarray:
        return self.n[i] == self.k

    def kth(self, i: np.ndarray) -> np.ndarray:
        return self.scores[i, self.k - 1]

    def take(self, i: np.ndarray, ids: np.ndarray, scores: np.ndarray, there: np.ndarray) -> None:
        """Rows for the queries i, a line of them for each: their ids and scores, and whether they are there."""
        better = there & (ids != self.own[i][:, None]) & (~self.full(i)[:, None] | (scores >= self.kth(i)[:, None]))
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        i, better = i[some], better[some]
        line, at = np.nonzero(better)
        held_line, held_at = np.nonzero(np.arange(self.k) < self.n[i][:, None])
        lines = np.concatenate([held_line, line])
        ids = np.concatenate([self.ids[i][held_line, held_at], ids[some][line, at]])
        scores = np.concatenate([self.scores[i][held_line, held_at], scores[some][line, at]])
        order = np.lexsort((ids, ~scores, lines))  # ~ turns the order without overflow
        lines, ids, scores = lines[order], ids[order], scores[order]
        counts = np.bincount(lines, minlength=len(i))
        place = np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = place < self.k
        self.ids[i[lines[kept]], place[kept]], self.scores[i[lines[kept]], place[kept]] = ids[kept], scores[kept]
        self.n[i] = np.minimum(counts, self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(self.own), 10_000):
            n = self.n[first : first + 10_000]
            there = np.arange(self.k) < n[:, None]
            yield batch(FOUND, query_id=np.repeat(self.own[first : first + 10_000], n), vec_id=self.ids[first : first + 10_000][there], score=self.scores[first : first + 10_000][there])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, scale: int = SCALE, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of vectors, its own row left out."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    asked = saved(quantised(queries, scale).groupBy("vec_id").agg(F.min("x").alias("x")))
    n_groups = max(1, -(-asked.count() // group_queries))
    rows = saved(rows) if n_groups > 1 else rows
    found = None
    for g in range(n_groups):
        group = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)) == g).orderBy("vec_id").toArrow()  # a group at a time
        shared = spark.sparkContext.broadcast((group["vec_id"].to_numpy(), matrix(group["x"].combine_chunks()) if group.num_rows else np.zeros((0, 0), np.int64)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, q = shared.value
            best = Best(query_ids, k)
            for b in batches:
                if not b.num_rows or not len(query_ids):
                    continue
                x = matrix(b["x"], q.shape[1])
                wide = np.zeros((len(q), x.shape[1]), np.int64)
                wide[:, : q.shape[1]] = q
                blocks = Blocks(b["vec_id"].to_numpy(), x)
                for first in range(0, len(wide), STEP_QUERIES):
                    blocks.improve(best, first, wide[first : first + STEP_QUERIES])
            yield from best.rows()

        part = bounded(rows).mapInArrow(scan, "query_id long, vec_id long, score long")
        if n_groups > 1:
            part = saved(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
