"""Texts dealt into parts of bounded size, each part's rows in compressed batches.

The number of parts follows the bytes of the texts, so that what a task holds stays the same
whatever the size of the table; a task decodes one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidelane.llm.common import bounded

#: Bytes of text in a part, about, and those that a task gathers before it deals them out.
PART_BYTES, GATHERED_BYTES = 8 << 20, 16 << 20
PACKED = pa.schema([("part", pa.int32()), ("packed", pa.binary())])
PACKED_DDL = "part int, packed binary"


def text_bytes(rows: DataFrame) -> int:
    """Bytes of all texts, and a few for each row."""
    return rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0


def n_parts(size: int, rows: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts for so many bytes of text: as many as shuffle partitions at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def spread(n: int, *cols: str) -> Column:
    """A part by the columns' hash. Equal rows of different input partitions go to different parts."""
    return F.pmod(F.xxhash64(*cols, F.spark_partition_id()), F.lit(n)).cast("int")


def dealt(rows: DataFrame, part: Column) -> DataFrame:
    """part, packed: the rows in record batches, each of rows of one part."""
    arrow = to_arrow_schema(rows.schema)

    def packed(rows_: pa.Table) -> Iterator[pa.RecordBatch]:
        by = rows_["part"].combine_chunks()
        rows_ = rows_.drop_columns(["part"]).take(pc.sort_indices(by))
        counts = sorted(zip(*(x.to_pylist() for x in by.value_counts().flatten())))
        first, payloads = 0, []
        for _, n in counts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, arrow, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as out:
                out.write_table(rows_.slice(first, n).combine_chunks().cast(arrow))
            payloads.append(sink.getvalue().to_pybytes())
            first += n
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.int32()), pa.array(payloads, pa.binary())], schema=PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.nbytes for x in held) > GATHERED_BYTES:
                yield from packed(pa.Table.from_batches(held))
                held = []
        if held:
            yield from packed(pa.Table.from_batches(held))

    return bounded(rows).withColumn("part", part).mapInArrow(pack, PACKED_DDL)


def unpacked_rows(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()
