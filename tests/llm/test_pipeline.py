import random

import pytest
from brute import components, kept_bytes
from pyspark.sql import functions as F

import corpus_pipeline
from tidelane.llm.decontamination import overlaps
from tidelane.llm.toxicity import toxicity

DATA = "/root/testdata/sf0.001"
#: Names that the stages use, or used, for columns of their own.
CLASHES = "weight matches words _weight _matches _words gone _gone _carried_0 others kept label component_id h part packed covered score carried Weight2 n_bytes start"


@pytest.fixture(scope="module")
def made(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns, before all stages."""
    rng = random.Random(8)
    spark_docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = [(r.doc_id, r.text) for r in spark_docs.orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 80").orderBy("item_id").first().text
    passage = " ".join(f"shared{k}" for k in range(60))
    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))

    big = words(130_000)
    near = words(80).split()
    rows = own + [(9000, None), (9001, None), (9002, ""), (9003, " \n"), (9004, big), (9005, big), (9006, f"{words(30)} {passage} {words(30)}"), (9007, f"{words(30)} {passage} {words(30)}"), (9008, f"{words(20)} {item} {words(20)}")]
    rows += [(9010 + k, " ".join(["other" if k and i == 7 * k else w for i, w in enumerate(near)])) for k in range(4)]
    rows += [(9020, "same row"), (9020, "same row"), (None, "lost"), (None, "lost"), (None, None)]
    names = CLASHES.split()
    docs = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), *range(len(names))) for i, t in rows], spark_docs.select("doc_id", "text", "lang", "source", "n_chars").schema.simpleString()[7:-1] + "".join(f",{n}:int" for n in names))
    return docs.repartition(3)


def run_stages(spark, docs):
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, DATA))
        results.append(docs)
    return results


def texts_of(df):
    return {r.doc_id: r.text for r in df.filter("doc_id IS NOT NULL").collect()}


def test_stages_on_made_documents_match_brute_force(spark, made):
    before, clean, distinct, cut, decontaminated, packed = run_stages(spark, made)
    for df in (clean, distinct, cut, decontaminated):
        assert df.dtypes == made.dtypes
    # Every other column of every row is as it was.
    names = CLASHES.split()
    for df in (clean, distinct, decontaminated, cut):
        assert all(tuple(r[n] for n in names) == tuple(range(len(names))) and r.lang == "en" for r in df.collect())
    # 1: what the operator rejects goes.
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    verdicts = toxicity(made, labels).filter("predicted = 0").count()
    assert clean.count() == verdicts
    # 2: the least document of each component stays, and rows without an id.
    at_hand = texts_of(clean)
    firsts = {i for i, (_, c) in components(at_hand).items() if c == i}
    assert set(texts_of(distinct)) == firsts and {9000, 9001, 9002, 9003}.issubset(firsts) and 9005 not in firsts and not {9011, 9012, 9013} & firsts
    assert distinct.filter("doc_id IS NULL").count() == clean.filter("doc_id IS NULL").count() == 3
    # 3: repeated strings go.
    at_hand = texts_of(distinct)
    want = {i: bytes(b for b, c in zip(data, covered) if not c).decode("utf-8", "ignore") for i, (data, covered) in kept_bytes(at_hand).items()}
    assert texts_of(cut) == want and "shared30" in want[9006] and "shared30" not in want[9007]
    assert all(r.n_chars == len(r.text) for r in cut.filter("doc_id IS NOT NULL").collect())
    # 4: documents with benchmark passages go.
    dirty = {r.doc_id for r in overlaps(cut, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert 9008 in dirty and set(texts_of(decontaminated)) == set(want) - dirty
    # 5: every document is packed whole and once.
    pieces = packed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.min("start").alias("first")).collect()
    assert {r.doc_id for r in pieces} == set(want) - dirty and all(r.n == r["all"] and r["first"] == 0 for r in pieces)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n > 2048 OR n <> end").isEmpty()


def test_stages_keep_their_contract(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    results = run_stages(spark, documents)
    counts = [df.count() for df in results[:-1]]
    assert all(df.dtypes == documents.dtypes for df in results[:-1]) and counts == sorted(counts, reverse=True)
    assert results[-1].select("doc_id").distinct().count() == counts[-1] > 0


def test_empty_documents_go_through(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert run_stages(spark, docs)[-1].count() == 0
