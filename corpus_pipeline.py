"""From raw documents to packed training sequences, each stage on all that its predecessor kept.

Toxic documents go; of each group of near copies the document with the least id stays; byte
strings that an earlier document has go from the texts; documents that overlap with benchmark
items go; what is left is packed.

Defined results, in every stage: null and empty texts are clean, unlike any other and without
repeats, and are packed as their end id; texts of any length are worked on whole; rows without a doc_id
go through all stages unchanged; repeated rows and ids count as the stages' modules say (near
copies: one row for an id stays; packing: each row); ties go to the smaller doc_id; empty tables
give no rows; extra columns, whatever their names, are kept until the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm.common import table
from tidelane.llm.decontamination import clean
from tidelane.llm.jaccard_join import one_of_each
from tidelane.llm.packing import pack
from tidelane.llm.suffix_dedup import deduplicated
from tidelane.llm.toxicity import without_toxic
from tidelane.operators.materialise import saved


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages learn, hash and pack in ways that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
