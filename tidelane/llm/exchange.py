"""Counts of tokens over the whole corpus, brought back to the documents that hold them.

Documents are dealt into parts. Each part sends its distinct tokens, with their counts there,
to buckets by token; a bucket adds the counts up and answers each part that asked. Tokens
travel as packed binaries, a few bytes each, and a token that many documents of a part share
is sent once, so frequent tokens are aggregated before they are shuffled.

Where a count may come out too high but never too low, tokens may be cut to 48 bits: two that
agree in them count as one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelane.llm.common import given_back

CUT_BITS = 48
SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
ANSWER = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
SENT_DDL = "bucket int, part int, payload binary"
ANSWER_DDL = "part int, payload binary"


def cut(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(64 - CUT_BITS)


def packed(tokens: np.ndarray, counts: np.ndarray) -> bytes:
    """Tokens and counts below 2**32, byte plane by byte plane, so that equal high bytes compress away."""
    wide = 6 if not len(tokens) or int(tokens.max()) < 1 << CUT_BITS else 8
    width = 1 if not len(counts) or counts.max() < 256 else 4
    planes = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T, counts.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return struct.pack("<IBB", len(tokens), wide, width) + b"".join(np.ascontiguousarray(p).tobytes() for p in planes)


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, width = struct.unpack_from("<IBB", payload)
    tokens, counts = np.zeros((n, 8), np.uint8), np.zeros((n, 4), np.uint8)
    tokens[:, :wide] = np.frombuffer(payload, np.uint8, wide * n, 6).reshape(wide, n).T
    counts[:, :width] = np.frombuffer(payload, np.uint8, width * n, 6 + wide * n).reshape(width, n).T
    return tokens.view("<u8").ravel(), counts.view("<u4").ravel()


def sent(part: int, tokens: np.ndarray, counts: np.ndarray, buckets: int, bits: int = CUT_BITS) -> pa.Table:
    """The rows of a part's distinct tokens, sorted, for their buckets: ranges of tokens of equal width."""
    bucket = (tokens >> np.uint64(bits - 24)).astype(np.int64) * buckets >> 24
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    rows = list(zip(at[:-1].tolist(), at[1:].tolist()))
    return pa.Table.from_arrays([pa.array(bucket[at[:-1]], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([packed(tokens[a:b], counts[a:b]) for a, b in rows], pa.binary())], schema=SENT)


#: The part that gets each bucket's number of tokens with a count, and the sum of their counts.
TOTALS = -1


def merging(least: int, with_totals: bool = False) -> Callable:
    """For applyInArrow over a bucket: answers each part with the summed counts of its tokens, of those that reach `least`."""

    @given_back
    def merge(key, table):
        parts = table["part"].to_pylist()
        got = [unpacked(x) for x in table["payload"].to_pylist()]
        tokens = np.concatenate([t for t, _ in got])
        ends = np.cumsum([0, *(len(t) for t, _ in got)])
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        sums = np.add.reduceat(np.concatenate([c for _, c in got]).astype(np.int64)[order], np.flatnonzero(first))
        total = np.empty(len(tokens), np.int64)
        total[order] = np.minimum(sums, (1 << 32) - 1)[np.cumsum(first) - 1]
        out = [(TOTALS, struct.pack("<qq", int((sums > 0).sum()), int(sums.sum())))] if with_totals else []
        for k, part in enumerate(parts):
            mine = slice(ends[k], ends[k + 1])
            kept = total[mine] >= least
            if kept.any():
                out.append((part, packed(tokens[mine][kept], total[mine][kept])))
        return pa.Table.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=ANSWER)

    return merge


def answered(sent_rows: DataFrame, least: int, with_totals: bool = False) -> DataFrame:
    return sent_rows.groupBy("bucket").applyInArrow(merging(least, with_totals), ANSWER_DDL)


def received(payloads: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All answers of a part as one sorted table of tokens and counts."""
    got = [unpacked(x) for x in payloads if x is not None]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    tokens, counts = np.concatenate([t for t, _ in got]), np.concatenate([c for _, c in got])
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def looked_up(tokens: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The count of each token; 0 if the table lacks it."""
    known, counts = table
    if not len(known):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, counts[at], 0).astype(np.int64)
