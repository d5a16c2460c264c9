"""Toxicity scores from a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: accents and homoglyphs to their Latin letters, digits and signs that
stand for letters to those letters, everything else to spaces. The lexicon's entries are whole
words and word beginnings whose share of toxic training documents is high; their weights are
smoothed log odds. Matches within exception phrases do not count. The summed weight, by itself
and per hundred words, goes through a logistic curve fitted to the training rows.

Defined results: null, empty and letterless texts score as texts without a match; a text of any
length is taken whole, by one task; of entries that begin at one place the heaviest counts; repeated
rows are scored each; extra columns are ignored; an empty table gives no rows; with no labelled rows of both kinds the lexicon is
empty and every score is the base rate (0 without labels).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tidelane.llm.common import batch, bounded, free_name
from tidelane.llm.labelled import SAMPLE_ROWS, held_out, labelled_sample

#: Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ı": "i", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d"}
#: Signs that stand for letters inside words; l and 1 are one letter, i.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "l": "i"}
#: Contexts in which a listed word is harmless.
EXCEPTIONS = ("clown fish", "circus clown", "trash can", "trash bin", "sore loser", "idiot proof", "worthless currency", "not stupid")
PREFIXES = range(4, 9)
MIN_DOCS, MIN_LOG_ODDS, MAX_WEIGHT = 4, 2.0, 6.0

_table = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
_letters = bytes(ord(SIGNS.get(chr(c).lower(), chr(c).lower())) if chr(c).isalpha() or chr(c) in SIGNS else 32 for c in range(128)) + b" " * 128
_unlike = re.compile("[Ā-ԯÆØßæø]")


def folded(text: str | None) -> str:
    """The text as lower-case Latin words, with a space on either side."""
    if not text:
        return " "
    if not text.isascii():
        if _unlike.search(text):
            text = text.translate(_table)
        text = unicodedata.normalize("NFKD", text)
    return f" {text.encode('ascii', 'ignore').translate(_letters).decode('ascii')} "


def entries_of(text: str | None) -> set[str]:
    """What the lexicon may hold of a text: ' word ' and ' beginning'."""
    found: set[str] = set()
    for word in set(folded(text).split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in PREFIXES if n <= len(word))
    return found


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            phrase = " ".join(folded(phrase).split())
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not weights
        self.automaton.make_automaton()

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Summed weight, number of matched words, number of words."""
        plain = folded(text)
        n_words = plain.count(" ") and len(plain.split())
        if self.empty:
            return 0.0, 0, n_words
        at: dict[int, float] = {}
        excepted = []
        for end, (length, weight) in self.automaton.iter(plain):
            start = end - length + 1
            if weight is None:
                excepted.append((start, end))
            elif weight > at.get(start, 0.0):
                at[start] = weight
        for a, b in excepted:
            for start in [s for s in at if a <= s < b]:
                del at[start]
        return sum(at.values()), len(at), n_words


def features(weight: float, n_words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(100.0 * weight / max(n_words, 20))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge-regularised logistic curve; the intercept comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entry to weight: every entry that MIN_DOCS toxic documents of the sample have and whose log odds reach MIN_LOG_ODDS."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        for b in batches:
            by = (Counter(), Counter())
            for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist()):
                by[label].update(entries_of(text))
            entries = list(by[0].keys() | by[1].keys())
            yield batch(schema, entry=entries, toxic=[by[1][e] for e in entries], clean=[by[0][e] for e in entries])

    totals = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    if not n.get(0) or not n.get(1):
        return {}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n[0] + 1.0))
    summed = bounded(sample).mapInArrow(counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rows = summed.filter(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS).collect()  # of a bounded sample
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["entry"]), r["entry"])):  # a longer entry stays only if it says more
        shorter = [kept[r["entry"][:k]] for k in range(2, len(r["entry"])) if r["entry"][:k] in kept]
        if not shorter or r["odds"] > max(shorter) + 0.7:
            kept[r["entry"]] = min(float(r["odds"]), MAX_WEIGHT)
    return kept


def weighing(weights: Broadcast, exceptions: tuple[str, ...], schema: pa.Schema):
    """For mapInArrow: the rows with the columns of the schema's last three, weight, n_matches and n_words, after their own."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights.value, exceptions)
        for b in batches:
            found = [lexicon.weigh(t) for t in b["text"].to_pylist()]
            own = [b.column(k) for k, name in enumerate(b.schema.names) if name != "text" or "text" in schema.names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64())))], schema=schema)

    return weigh


def found_fields(taken: list[str]) -> StructType:
    """weight, matches and words, under names that no column has."""
    return StructType([StructField(free_name(name, taken), t) for name, t in (("weight", DoubleType()), ("matches", LongType()), ("words", LongType()))])


@dataclass
class ToxicityModel:
    """A lexicon and the logistic curve over its summed weights."""

    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    @classmethod
    def learned(cls, documents: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
        sample = labelled_sample(documents, labels, "toxic", sample_rows)
        weights = learn_lexicon(sample)
        shared = documents.sparkSession.sparkContext.broadcast(weights)
        schema = StructType([StructField("label", IntegerType()), *found_fields([])])
        fitted = sample.select("label", "text").mapInArrow(weighing(shared, exceptions, to_arrow_schema(schema)), schema).collect()  # sample_rows rows at most
        y = np.array([r["label"] for r in fitted], dtype=float)
        if weights:
            return cls(weights, tuple(logistic_fit(np.array([features(r["weight"], r["words"]) for r in fitted]), y).tolist()), exceptions)
        rate = y.mean() if len(y) else 0.0
        return cls({}, (math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), 0.0, 0.0), exceptions)

    def score(self, weight: str, words: str) -> Column:
        """The score of weighed() rows by the names of two of their columns."""
        per_words = 100.0 * F.col(weight) / F.greatest(words, F.lit(20))
        a, b, c = map(F.lit, self.curve)
        z = a + b * F.log1p(weight) + c * F.log1p(per_words)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))

    def weighed(self, rows: DataFrame, keep_text: bool) -> tuple[DataFrame, list[str]]:
        """The rows, which have a string column text, with three more columns, and the names of those: weight, matches, words."""
        own = [f for f in rows.schema.fields if keep_text or f.name != "text"]
        found = found_fields(rows.columns)
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)
        schema = StructType([*own, *found])
        return bounded(rows).mapInArrow(weighing(shared, self.exceptions, to_arrow_schema(schema)), schema), found.names


def toxicity(documents: DataFrame, labels: DataFrame, *, exceptions: tuple[str, ...] = EXCEPTIONS, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, weight, n_matches, n_words of every document."""
    model = ToxicityModel.learned(documents, labels, exceptions, sample_rows)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, (weight, matches, words) = model.weighed(docs, False)
    scored = rows.withColumn("score", model.score(weight, words))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col(weight).alias("weight"), F.col(matches).alias("n_matches"), F.col(words).alias("n_words"))


def without_toxic(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The documents, as they are, that score below the threshold; text must be a string column."""
    model = ToxicityModel.learned(documents, labels, **options)
    rows, (weight, _, words) = model.weighed(documents, True)
    return rows.filter(model.score(weight, words) < threshold).drop(*rows.columns[-3:])
