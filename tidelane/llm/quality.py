"""Quality scores from a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over one feature's bins at a time, then over the bins of the
pairs whose interaction explains most of what is left. The trees of a feature or pair add up to
one lookup table, so a document's score is an intercept and a sum of table entries.

Defined results: null and empty texts have the features of no text and are scored like any other; a
text of any length is taken whole, by one task; equal gains go to the earlier bin and the feature
first in order; repeated rows are scored each; extra columns are ignored; an empty table gives no rows; with no labelled rows of both kinds
every score is the base rate (0 without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import batch, bounded
from tidelane.llm.labelled import SAMPLE_ROWS, held_out, labelled_sample

FEATURES = ("log_words", "word_length", "longest_word", "lower", "upper", "digit", "space", "newline", "point", "exclaim", "symbol", "pipe", "beyond_ascii", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "words_per_line")
_kinds = np.full(256, 9, dtype=np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"()-?", b"!", b"#$%&*+/<=>@[\\]^_`{}~", b"|")):
    _kinds[list(_chars)] = _k


def features_of(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    shares = np.bincount(_kinds[np.frombuffer(raw, np.uint8)], minlength=10) / size
    lines = [x for x in raw.split(b"\n") if x]
    counts = Counter(words)
    return [
        np.log1p(n), sum(map(len, words)) / max(n, 1), float(max(map(len, counts), default=0)), *shares.tolist(),
        len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1), len(set(zip(words, words[1:]))) / max(n - 1, 1), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
    ]


@dataclass
class AdditiveModel:
    """Lookup tables over binned features, learned by cyclic boosting of shallow trees."""

    bins: int = 32
    pair_bins: int = 8
    rounds: int = 200
    pair_rounds: int = 60
    n_pairs: int = 6
    rate: float = 0.1
    least: float = 5.0
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]) if len(edges) else np.zeros((len(x), 0), int)

    def _best_cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best cut of a run of bins."""
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= self.least / 4) & (hr >= self.least / 4), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), 0.0)
        return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
        """A step per bin: the best cuts of the bins into `leaves` runs."""
        runs, step = [(0, len(g))], np.zeros(len(g))
        while len(runs) < leaves:
            gain, (a, b), cut = max(((*(x := self._best_cut(g[a:b], h[a:b]))[:1], (a, b), a + x[1]) for a, b in runs), key=lambda t: t[0])
            if gain <= 1e-9:
                break
            runs.remove((a, b))
            runs += [(a, cut), (cut, b)]
        for a, b in runs:
            step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        return step

    def _pair_tree(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """A cut of one feature, and on either side the best cut of the other."""
        best, step = 0.0, np.zeros_like(g)
        for turn in (False, True):
            gg, hh = (g.T, h.T) if turn else (g, h)
            for cut in range(1, gg.shape[0]):
                halves = [(slice(0, cut), gg[:cut].sum(0), hh[:cut].sum(0)), (slice(cut, None), gg[cut:].sum(0), hh[cut:].sum(0))]
                gain = sum(self._best_cut(a, b)[0] for _, a, b in halves)
                if gain > best:
                    best, grown = gain, np.zeros_like(gg)
                    for rows, a, b in halves:
                        grown[rows] = self._tree(a, b, 2)
                    step = grown.T if turn else grown
        return best, step

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 1e-6
        self.intercept = float(np.log(rate / (1 - rate)))
        if len(y) < 10 or y.min() == y.max():
            return self
        self.edges = [self._cuts(x[:, k], self.bins) for k in range(x.shape[1])]
        self.pair_edges = [self._cuts(x[:, k], self.pair_bins) for k in range(x.shape[1])]
        at = self._binned(x, self.edges)
        sizes = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(s) for s in sizes]
        z = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for k, size in enumerate(sizes):
                p = 1 / (1 + np.exp(-z))
                step = self.rate * self._tree(np.bincount(at[:, k], y - p, size), np.bincount(at[:, k], p * (1 - p), size))
                self.tables[k] += step
                z += step[at[:, k]]
        coarse = self._binned(x, self.pair_edges)
        wide = [len(e) + 1 for e in self.pair_edges]

        def sums(i, j):
            p = 1 / (1 + np.exp(-z))
            cell = coarse[:, i] * wide[j] + coarse[:, j]
            return cell, *(np.bincount(cell, v, wide[i] * wide[j]).reshape(wide[i], wide[j]) for v in (y - p, p * (1 - p)))

        ranked = sorted(((self._pair_tree(*sums(i, j)[1:])[0], (i, j)) for i, j in combinations(range(x.shape[1]), 2) if min(wide[i], wide[j]) > 1), reverse=True)
        self.pairs = {pair: np.zeros((wide[pair[0]], wide[pair[1]])) for gain, pair in ranked[: self.n_pairs] if gain > 0}
        for _ in range(self.pair_rounds):
            for (i, j), grid in self.pairs.items():
                cell, g, h = sums(i, j)
                step = self.rate * self._pair_tree(g, h)[1]
                grid += step
                z += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        at, coarse = self._binned(x, self.edges), self._binned(x, self.pair_edges)
        for k, t in enumerate(self.tables):
            z += t[at[:, k]]
        for (i, j), grid in self.pairs.items():
            z += grid[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-z))


def quality(documents: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3, model: AdditiveModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. The fit sees sample_rows rows at most."""
    spark = documents.sparkSession

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            yield batch(schema, label=b["label"], x=[features_of(t) for t in b["text"].to_pylist()])

    fitted = bounded(labelled_sample(documents, labels, "quality", sample_rows)).orderBy("doc_id").select("label", "text").mapInArrow(rows, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in fitted]).reshape(-1, len(FEATURES))
    learned = (model or AdditiveModel()).fit(x, np.array([r["label"] for r in fitted], dtype=float))
    shared = spark.sparkContext.broadcast(learned)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            if b.num_rows:
                yield batch(schema, doc_id=b["doc_id"], score=shared.value.score(np.array([features_of(t) for t in b["text"].to_pylist()])))

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = bounded(docs).mapInArrow(scores, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
