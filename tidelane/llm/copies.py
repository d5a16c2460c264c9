"""Rows with equal texts, so that each different text is worked on once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.dealing import unpacked_rows
from tidelane.operators.materialise import saved


def keyed(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty) and h, g, n: two hashes and the length that identify the text. Rows without an id are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *carry).filter("doc_id IS NOT NULL")
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").alias("n_bytes"), *carry)


def first_copies(keyed_docs: DataFrame) -> DataFrame:
    """doc_id, h, first_id: the document and the least doc_id that has the same text; saved.

    If rows repeat a doc_id, the text with the least hashes stands for it.
    """
    one = keyed_docs.groupBy("doc_id").agg(F.min(F.struct("h", "g", "n_bytes")).alias("k")).select("doc_id", "k.*")
    one = saved(one)
    # Counted before the join, and read again for it, so that a text with very many copies is a skewed key that Spark can split.
    least = saved(one.groupBy("h", "g", "n_bytes").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return saved(one.join(least, ["h", "g", "n_bytes"], "left").select("doc_id", "h", "n_bytes", F.coalesce("first_id", "doc_id").alias("first_id")))


def chosen(packed: list[bytes], firsts: pa.Table) -> Iterator[tuple[pa.RecordBatch, list[int], list[bool]]]:
    """The rows dealt to a part, a batch at a time: one row of each document, by the batch's order, and whether it is the first copy of its text.

    firsts has doc_id, h and first_id of the part's documents, as first_copies() gives them.
    """
    known = dict(zip(zip(firsts["doc_id"].to_pylist(), firsts["h"].to_pylist()), firsts["first_id"].to_pylist()))
    for rows in map(unpacked_rows, packed):
        at, first = [], []
        for k, key in enumerate(zip(rows["doc_id"].to_pylist(), rows["h"].to_pylist())):
            id_ = known.pop(key, None)
            if id_ is not None:
                at.append(k), first.append(id_ == key[0])
        yield rows, at, first


def first_texts(packed: list[bytes], firsts: pa.Table) -> Iterator[tuple[pa.Array, pa.Array]]:
    """doc_id and text of a part's first copies, a batch at a time."""
    for rows, at, first in chosen(packed, firsts):
        own = pa.array([k for k, f in zip(at, first) if f], pa.int64())
        yield rows["doc_id"].take(own), rows["text"].take(own)
