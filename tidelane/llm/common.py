"""What the corpus operators share: tables, folds, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to Python at a time: texts may be long, and a batch is held several times over on its way.
BATCH_BYTES = "4m"


def bounded(rows: DataFrame) -> DataFrame:
    """The rows, as they are, in a session whose Arrow batches are bounded by bytes, too. The session keeps that bound from now on; one that it has stays."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows


def free_name(name: str, taken: list[str]) -> str:
    """The name, after as many underscores as make it differ, in any case, from all that are taken."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def scaled(value: Column, scale: int) -> Column:
    """floor(scale * value) of a double as a long; an error, not a wrong number, from 2**53 on, where doubles leave integers out."""
    return F.when(F.abs(value * scale) < float(1 << 53), F.floor(value * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large to be scaled exactly")).cast("long"))


def part_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")


#: Bytes of text hashed at a time: small enough for the processor's caches.
CHUNK_BYTES = 1 << 19
_space = np.zeros(256, dtype=bool)
_space[[32, *range(9, 14)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte; A-Z have those of a-z.
_values = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_values[65:91] = _values[97:123]
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 modulo 2**64, and their inverses."""
    if len(_powers[0]) < n:
        inverse = U64(pow(int(MULTIPLIER), -1, 1 << 64))
        for k, m in enumerate((MULTIPLIER, inverse)):
            p = np.full(max(n, CHUNK_BYTES), m, dtype=U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts' UTF-8 bytes in runs of rows: first row, bytes, bounds. Text k is bytes[bounds[k] : bounds[k + 1]]; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """placed_words() without the places."""
    return placed_words(data, bounds)[:2]


def placed_words(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z lower-cased, the bounds of each text's words, and the
    first byte of each word and the byte after it. Words are [^\\x20\\x09-\\x0D]+, or runs of other bytes than the gaps.

    A word's hash is a polynomial in the multiplier over its bytes' random numbers, taken
    from running sums, so that no word becomes a Python object.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64), none, none
    power, inverse = powers(n)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_values[data] * power, out=sums[1:])
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~gaps[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(U64)), np.searchsorted(starts, bounds), starts, ends


def hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """hashed_words() of the texts in runs of rows: first row, hashes, bounds."""
    for row, data, bounds in text_chunks(texts):
        yield row, *hashed_words(data, bounds)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on every other."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def numbered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by key, equal keys by place, and the number of different keys before each. Keys are below 2 ** bits."""
    n = len(key)
    wide = max(1, n.bit_length())
    small = np.int32 if wide < 32 else np.int64
    if bits + wide <= 64:  # the place in the low bits: one plain sort, which is several times faster
        ordered = key << U64(wide)
        ordered |= np.arange(n, dtype=U64)
        ordered.sort()
        order = (ordered & U64((1 << wide) - 1)).astype(small)
        ordered >>= U64(wide)
    else:
        order = np.argsort(key, kind="stable").astype(small)
        ordered = key[order]
    number = np.zeros(n, small)
    np.cumsum(ordered[1:] != ordered[:-1], out=number[1:])
    return order, number


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, and the place of each row's hash among them."""
    n = len(hashes)
    wide = U64(max(1, n.bit_length()))
    order, number = numbered(hashes >> wide, 64 - int(wide))
    ordered = hashes[order]
    if ((ordered[1:] != ordered[:-1]) & (number[1:] == number[:-1])).any():  # two that agree in their high bits
        return np.unique(hashes, return_inverse=True)
    at = np.empty_like(number)
    at[order] = number
    return ordered[np.concatenate([[True], number[1:] != number[:-1]])[:n]], at


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def given_back(f: Callable) -> Callable:
    """f over a group, or two: memory that it freed goes back to the system before the worker waits for its next group."""

    def grouped(key, table):
        out = f(key, table)
        _give_back()
        return out

    def cogrouped(key, table, other):
        out = f(key, table, other)
        _give_back()
        return out

    return cogrouped if f.__code__.co_argcount == 3 else grouped


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of the whole if there are fewer."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    m = len(words) - n + 1
    h = words[:m] + U64(n)
    for i in range(1, n):
        h *= MULTIPLIER
        h += words[i : m + i]
    h = mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch in the schema's column order and types."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def arrow_table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
