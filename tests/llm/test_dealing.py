import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidelane.llm.common import distinct, numbered
from tidelane.llm.dealing import dealt, n_parts, spread, text_bytes, unpacked_rows


def test_rows_come_back_whole_in_their_parts(spark):
    rows = [(i, None if i == 3 else "é" * i, [i]) for i in range(50)] * 2 + [(7, "x" * 1_000_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, packed array<long>").repartition(4)
    got = dealt(docs, F.col("doc_id").cast("int") % 5).collect()
    found = [(r.part, *row.values()) for r in got for row in unpacked_rows(bytes(r.packed)).to_pylist()]
    assert sorted(map(str, found)) == sorted(str((i % 5, i, t, x)) for i, t, x in rows)
    assert dealt(docs.limit(0), F.lit(0)).count() == 0


def test_parts_follow_the_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(100)] + [(None, None)], "doc_id long, text string")
    size = text_bytes(docs)
    assert size == 100 * 1016 + 16 and n_parts(size, docs) == 8 and n_parts(size, docs, 1000) == 102
    assert text_bytes(docs.limit(0)) == 0
    assert docs.select(spread(3, "doc_id")).distinct().count() <= 3
    assert unpacked_rows(bytes(dealt(docs.limit(1), F.lit(2)).first().packed)).schema.names == ["doc_id", "text"]
    assert isinstance(unpacked_rows(bytes(dealt(docs.limit(1), F.lit(2)).first().packed)), pa.RecordBatch)


def test_numbered_and_distinct():
    rng = np.random.default_rng(2)
    for bits in (3, 40, 60):
        key = rng.integers(0, 1 << bits, 500, dtype=np.uint64)
        key[200:300] = key[:100]
        order, number = numbered(key, bits)
        assert order.tolist() == sorted(range(500), key=lambda k: (key[k], k)) and number.tolist() == np.unique(key[order], return_inverse=True)[1].tolist()
    for hashes in (key, np.repeat(np.array([1 << 60, (1 << 60) + 1, 5], np.uint64), 9), key[:0]):
        words, at = distinct(hashes)
        assert words.tolist() == sorted(set(hashes.tolist())) and (words[at] == hashes).all()
