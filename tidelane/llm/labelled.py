"""The labelled training rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import crc_mod
from tidelane.operators.materialise import saved

#: Labelled rows used for a fit, at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
FOLDS = 5


def held_out(column: str = "doc_id"):
    return F.coalesce(crc_mod(column, FOLDS) == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, label of at most `rows` labelled ids outside the held-out fold: those with the least hash, each once, with its largest label.

    Labels other than 0 and 1, and null ids, are ignored.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents outside the held-out fold, one row for each. Saved.

    Labels other than 0 and 1, and null ids, are ignored; if an id has several labels the largest counts,
    and if it has several texts the one with the least hash does. The broadcast side has `rows` rows at most,
    whatever the size of the tables.
    """
    known = known_labels(labels, label, rows)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("row"))
    return saved(one.select("doc_id", "row.text", "row.label"))
