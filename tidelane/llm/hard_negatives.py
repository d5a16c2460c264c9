"""Hard negatives by a two-dimensional block matrix multiply.

Rows are dealt into blocks by their label's hash and their own, anchors and all rows alike. Each
anchor block meets each row block: a task multiplies them a piece of the rows at a time, so that
it holds a tile of bounded size, and keeps of each tile what is better than the first few rows
that it has of an anchor. Scores are neither shuffled nor kept: of these, which are as many as
anchors times rows, a task gives each anchor's first few rows at its end, and a window picks the
first of all. Anchor blocks go to the row blocks, which stay where they are.

Two passes share the tiles between them. The first takes the pairs of blocks that may share a
label and finds each anchor's positives; the second takes those that may differ in it, with the
positives' scores beside the anchors, and finds the negatives in each positive's window of scores.
Blocks of one label each, as a few labels give them, are so multiplied once.

A block holds BLOCK_BYTES of components at most, about, however many rows share a label: a hot
label has more blocks. Scores are exact: floats of 4 or 8 bytes where these hold all sums of
products, else integers, which are summed over chunks of the dimensions; a component or score that
64-bit integers or exact doubles can't hold is an error, not a wrong number.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take
no part; shorter vectors count as padded with zeros, empty ones score 0; rows with an anchor's own
id are the anchor itself, and of an anchor's repeated rows the one with the least label and vector
counts; other repeated rows count each, as positives and as negatives; equal scores go to the
smaller id; an anchor without another row of its label has no positives, and a positive without a
row in its window gives no row; no positive of a negative score has a window; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.llm.common import arrow_table, batch, bounded, given_back, scaled
from tidelane.llm.top_k import matrix
from tidelane.operators.materialise import saved

SCALE = 256
POSITIVES = NEGATIVES = 5
#: Percent of the positive's score that a negative has at least and at most.
LOW, HIGH = 80, 100
#: Blocks of rows that there are at least, if these have so many rows each; bytes of components in one, and anchors in one, at most.
BLOCKS, LEAST_ROWS = 64, 2048
BLOCK_BYTES, ANCHOR_BYTES, TILE_ANCHORS = 1 << 24, 1 << 22, 1024
#: Dimensions in a chunk, where sums need integers, and scores that a task holds at a time.
CHUNK, TILE_SCORES = 32, 1 << 21
#: Anchor blocks that a task keeps the first rows of.
HELD = 64
#: Groups of labels: blocks hold rows of one group.
SHARDS = 64
#: A score below, and an id above, all that there are.
NO_SCORE, NO_ID = -(1 << 63), (1 << 63) - 1

BLOCK = pa.schema([("block", pa.int32()), ("least", pa.int64()), ("largest", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("meta", pa.binary()), ("values", pa.binary())])
BLOCK_DDL = "block int, least long, largest long, n int, width int, meta binary, `values` binary"
FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor_id long, place int, vec_id long, score long"


def dealt_rows(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows with a block: rows of a group of labels, about block_rows of them."""
    shard = F.pmod(F.xxhash64("label"), F.lit(SHARDS)).cast("int")
    sizes = {r["shard"]: r["n"] for r in rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}  # SHARDS rows at most
    blocks = [-(-sizes.get(k, 0) // block_rows) for k in range(SHARDS)]
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), shard + 1)
    # The row's number parts rows that are equal in all columns, too.
    own = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), at([max(1, b) for b in blocks])).cast("int")
    return rows.withColumn("block", at(first[:-1]) + own)


def packed(rows: DataFrame) -> DataFrame:
    """Blocks, their rows by id: their ids, labels and positives, if there are any, and their components in as few bytes as they fit. Saved."""

    @given_back
    def pack(key, table):
        table = table.sort_by("vec_id")
        x = matrix(table["x"].combine_chunks())
        labels = table["label"].to_numpy()
        meta = [table["vec_id"].to_numpy(), labels]
        if "positives" in table.column_names:
            lists = table["positives"].combine_chunks()
            meta += [np.diff(lists.offsets.to_numpy()), lists.flatten().field("score").to_numpy()]
        x = x.astype(np.promote_types(np.min_scalar_type(x.min(initial=0)), np.min_scalar_type(-1 - int(x.max(initial=0)))))
        held = b"".join(np.asarray(m, np.int64).tobytes() for m in meta)
        return arrow_table(BLOCK, block=[key[0].as_py()], least=[int(labels.min())], largest=[int(labels.max())], n=[len(x)], width=[x.itemsize], meta=[held], values=[x.tobytes()])

    return saved(rows.groupBy("block").applyInArrow(pack, BLOCK_DDL))


def largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def partial_tile(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with those of y as exact int64."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    if largest(x) * largest(y) * x.shape[1] < 1 << 53:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    if (np.abs(x.astype(float)) @ np.abs(y.T.astype(float))).max(initial=0) >= 2.0**53:  # far from what partial sums could lose
        big = x.astype(object) @ y.T.astype(object)
        if any(abs(v) >= 1 << 57 for v in big.ravel()):
            raise OverflowError("a partial inner product is outside the range that sums stay exact in")
        return big.astype(np.int64)
    return x @ y.T


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller id. The plain form of what Best keeps."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= kth)
        return among[np.lexsort((ids[among], ~scores[among]))[:k]]  # ~ turns the order without overflow
    return np.lexsort((ids, ~scores))[:k]


class Best:
    """For each anchor, and each of its windows of scores, the k highest scores in it so far; equal ones by the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score, self.id = np.full((*low.shape, k), NO_SCORE), np.full((*low.shape, k), NO_ID)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all anchors by rows, which are in the order of their ids. Those that don't count are the least of their type."""
        last = self.score[..., -1]
        # Rows as good as the last one matter while they may have smaller ids.
        above = np.maximum(self.low, last - ((ids[0] < self.id[..., -1]) & (last > NO_SCORE)))
        some = above < self.high
        floor, ceiling = (x[:, None].astype(scores.dtype) for x in (np.where(some, above, NO_ID).min(1), np.where(some, self.high, NO_SCORE).max(1)))
        i, j = np.nonzero((scores > floor) & (scores <= ceiling))
        if not len(i):
            return
        found = scores[i, j].astype(np.int64)
        at, window = np.nonzero((found[:, None] > above[i]) & (found[:, None] <= self.high[i]))
        place = i[at] * self.low.shape[1] + window
        # What is there is sorted together with what comes to it.
        score, id_ = self.score.reshape(-1, self.k), self.id.reshape(-1, self.k)
        some = np.unique(place)
        place = np.concatenate([np.repeat(some, self.k), place])
        all_scores, all_ids = np.concatenate([score[some].ravel(), found[at]]), np.concatenate([id_[some].ravel(), ids[j[at]]])
        order = np.lexsort((all_ids, ~all_scores, place))  # ~ turns the order without overflow
        first = order[np.searchsorted(place[order], some)[:, None] + np.arange(self.k)]
        score[some], id_[some] = all_scores[first], all_ids[first]


class Block:
    """A block's ids, labels, components, and the scores of its positives where it has any."""

    def __init__(self, n: int, width: int, meta: bytes, values: bytes):
        meta = np.frombuffer(meta, np.int64)
        self.ids, self.labels, self.positives = meta[:n], meta[n : 2 * n], meta[2 * n :]
        self.x = np.frombuffer(values, f"<i{width}").reshape(n, len(values) // (width * n))
        self.largest, self.kinds, self.floats = largest(self.x), np.unique(self.labels), {}

    def part(self, rows: slice, wide: int, kind: type) -> np.ndarray:
        if kind not in self.floats:
            self.floats[kind] = self.x.astype(kind)
        return self.floats[kind][rows, :wide]


def scores_of(a: Block, b: Block, rows: slice, chunk: int) -> np.ndarray:
    """Inner products of all of a with some rows of b: floats that are exact, or integers."""
    wide = min(a.x.shape[1], b.x.shape[1])
    most = a.largest * b.largest * wide
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return a.part(slice(None), wide, kind) @ b.part(rows, wide, kind).T
    total = np.zeros((len(a.ids), len(b.ids[rows])), np.int64)
    for k in range(0, wide, chunk):
        total += partial_tile(a.x[:, k : min(wide, k + chunk)], b.x[rows, k : min(wide, k + chunk)])
        if total.size and max(-int(total.min()), int(total.max())) >= 1 << 62:
            raise OverflowError("an inner product is outside the range that sums stay exact in")
    return total


def _multiplied(a: Block, b: Block, best: Best, seen: int, same_label: bool, chunk: int) -> None:
    """Takes the tiles of a pair of blocks. Pieces of the rows are small at first, while nearly all of them are among the best."""
    shared = np.intersect1d(a.kinds, b.kinds)
    plain = len(a.kinds) == len(b.kinds) == len(shared) == 1 if same_label else not len(shared)
    at, most = 0, max(1, TILE_SCORES // max(1, len(a.ids)))
    while at < len(b.ids):
        rows = slice(at, at + min(most, max(64, seen + at)))
        ids = b.ids[rows]
        scores = scores_of(a, b, rows, chunk)
        none = NO_SCORE if scores.dtype == np.int64 else -np.inf
        if not plain:
            np.copyto(scores, none, where=(a.labels[:, None] == b.labels[None, rows]) != same_label)
        own = [np.searchsorted(ids, a.ids, side) for side in ("left", "right")]
        for i in np.flatnonzero(own[1] > own[0]):
            scores[i, own[0][i] : own[1][i]] = none
        best.take(scores, ids)
        at = rows.stop


def _windows(a: Block, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """What the scores of an anchor's negatives are above, and at most, for each of its positives."""
    n = len(a.ids)
    sizes, scores = a.positives[:n], a.positives[n:].tolist()
    ends = [np.full((n, int(sizes.max(initial=0))), NO_SCORE) for _ in range(2)]
    row = np.repeat(np.arange(n), sizes)
    for end, values in zip(ends, ([-(-low * s // 100) - 1 for s in scores], [high * s // 100 for s in scores])):
        end[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return ends[0], ends[1]


def first_rows(anchors: DataFrame, rows: DataFrame, k: int, chunk: int, window: tuple[int, int] | None = None) -> DataFrame:
    """anchor_id, place, vec_id, score: k rows at most that a task found for each anchor's positive in its window, from rows of other labels; without a window, for each anchor, from rows of its label."""
    n_blocks = rows.agg(F.coalesce(F.max("block"), F.lit(-1)) + 1).first()[0]
    left, right = (df.select(*(F.col(c).alias(f"{c}_{s}") for c in BLOCK.names)) for df, s in ((anchors, "a"), (rows, "b")))
    one = (F.col("least_a") == F.col("largest_a")) & (F.col("least_b") == F.col("largest_b")) & (F.col("least_a") == F.col("least_b"))
    meet = (F.col("least_a") <= F.col("largest_b")) & (F.col("least_b") <= F.col("largest_a"))
    pairs = left.select("block_a", "least_a", "largest_a", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))).alias("block_b")).join(right.select("block_b", "least_b", "largest_b"), "block_b")
    pairs = pairs.filter(meet if window is None else ~one).select("block_a", "block_b")
    # Tasks are as many as blocks: what they read is little beside what they multiply.
    tasks = max(1, min(20_000, 2 * n_blocks))
    sent = pairs.join(left.hint("merge"), "block_a").select("block_a", "block_b", "n_a", "width_a", "meta_a", "values_a")
    met = sent.repartition(tasks, "block_b").join(right.repartition(tasks, "block_b").hint("merge"), "block_b").select("block_a", "block_b", *(f"{c}_{s}" for s in "ab" for c in ("n", "width", "meta", "values")))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by anchor block: the block, its best rows, and how many rows they are of
        at, b = None, None

        def block(row: pa.RecordBatch, s: str) -> Block:
            return Block(*(row[f"{c}_{s}"][0].as_py() for c in ("n", "width", "meta", "values")))

        def given() -> Iterator[pa.RecordBatch]:
            for a, best, _ in held.values():
                i, place, n = np.nonzero(best.id != NO_ID)
                yield batch(FOUND, anchor_id=a.ids[i], place=place, vec_id=best.id[i, place, n], score=best.score[i, place, n])
            held.clear()

        for row in (rows.slice(r, 1) for rows in batches for r in range(rows.num_rows)):
            name = row["block_a"][0].as_py()
            if name not in held:
                if len(held) == HELD:
                    yield from given()
                a = block(row, "a")
                ends = (np.full((len(a.ids), 1), NO_SCORE), np.full((len(a.ids), 1), NO_ID)) if window is None else _windows(a, *window)
                held[name] = [a, Best(*ends, k), 0]
            if at != row["block_b"][0].as_py():
                at, b = row["block_b"][0].as_py(), block(row, "b")
            a, best, seen = held[name]
            _multiplied(a, b, best, seen, window is None, chunk)
            held[name][2] += len(b.ids)
        yield from given()

    return bounded(met).mapInArrow(multiply, FOUND_DDL)


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, tile_rows: int | None = None, tile_anchors: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive, its hard negatives.

    vectors: vec_id, label, embedding. is_anchor says of each row whether it is an anchor, too. Blocks have tile_rows rows and
    tile_anchors anchors, about; unless these are given, as many as suit the vectors' number and size.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.dropna(subset=["vec_id", "label", "x"]).filter(sound)
    rows = saved(rows.select("vec_id", "label", F.transform("x", lambda v: scaled(v, scale)).alias("x"), "anchor"))
    n, wide = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    size = 8 * max(1, wide or 0)
    tile_rows = tile_rows or max(1, min(BLOCK_BYTES // size, max(LEAST_ROWS, n // BLOCKS)))
    tile_anchors = tile_anchors or max(1, min(ANCHOR_BYTES // size, TILE_ANCHORS))
    anchors = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    blocks = packed(dealt_rows(rows.select("vec_id", "label", "x"), tile_rows))
    anchors = saved(dealt_rows(anchors, tile_anchors))

    found = first_rows(packed(anchors), blocks, positives, chunk)
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= positives)
    first = saved(first.select("anchor_id", "k", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    lists = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", F.col("positive_score").alias("score")))).alias("positives"))  # `positives` at most
    with_positives = anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("block", "vec_id", "label", "x", "positives")

    found = first_rows(packed(with_positives), blocks, negatives, chunk, (low, high))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.select("anchor_id", "place", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).withColumn("k", F.col("place") + 1)
    return ranked.join(first, ["anchor_id", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
