"""Rows laid out along a space-filling curve, and boxes read by runs of it.

A place's key interleaves the bits of its longitude and latitude, so that neighbours mostly have
neighbouring keys. Files are sorted by the key; a box is covered by a few runs of keys, which reach the
files' statistics, so that row groups without any are skipped. The box itself is then taken exactly.

Defined results: rows with a null coordinate are kept, under a key of their own, and are in no box;
places beyond the world's bounds have the keys of its edges, and are still found in their boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each coordinate.
BITS = 16
#: Runs that a box is covered by, at most.
RUNS = 32
KEY = "curve_key"
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _step(value: Column, low: float, high: float) -> Column:
    """The coordinate in 2**BITS steps of its range."""
    step = F.floor((value - low) / (high - low) * (1 << BITS))
    return F.least(F.greatest(step, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def _spread(step: Column) -> Column:
    """The bits of a step with a gap after each."""
    for shift, mask in _SPREAD:
        step = step.bitwiseOR(F.shiftleft(step, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return step


def curve_key(lon: Column, lat: Column) -> Column:
    key = _spread(_step(lon, -180.0, 180.0)).bitwiseOR(F.shiftleft(_spread(_step(lat, -90.0, 90.0)), 1))
    return F.when(lon.isNotNull() & lat.isNotNull(), key).otherwise(F.lit(-1).cast("long"))


def _plain_step(value: float, low: float, high: float) -> int:
    return min(max(int((value - low) / (high - low) * (1 << BITS) // 1), 0), (1 << BITS) - 1)


def key_runs(box: tuple[float, float, float, float], most: int = RUNS) -> list[tuple[int, int]]:
    """Runs [first, last] of keys that cover the box (min lon, min lat, max lon, max lat): squares of the curve, split while they are few, then joined."""
    x0, x1 = (_plain_step(v, -180.0, 180.0) for v in (box[0], box[2]))
    y0, y1 = (_plain_step(v, -90.0, 90.0) for v in (box[1], box[3]))
    if box[0] > box[2] or box[1] > box[3]:
        return []
    whole, open_ = [], [(0, 0, BITS, 0)]  # column, row, log of the side, first key
    while open_:
        inner = [s for s in open_ if s[0] >= x0 and s[0] + (1 << s[2]) - 1 <= x1 and s[1] >= y0 and s[1] + (1 << s[2]) - 1 <= y1 or s[2] == 0]
        whole += inner
        split = [s for s in open_ if s not in inner]
        if len(whole) + 4 * len(split) > most:
            whole += split
            break
        open_ = []
        for x, y, side, key in split:
            half = 1 << (side - 1)
            for k in range(4):
                cx, cy = x + (k & 1) * half, y + (k >> 1) * half
                if cx <= x1 and cx + half - 1 >= x0 and cy <= y1 and cy + half - 1 >= y0:
                    open_.append((cx, cy, side - 1, key + k * half * half))
    runs: list[tuple[int, int]] = []
    for first, last in sorted((key, key + (1 << 2 * side) - 1) for _, _, side, key in whole):
        if runs and first <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    return runs


def write_laid_out(rows: DataFrame, path: str, lon: str = "lon", lat: str = "lat", group_bytes: int = 1 << 20) -> None:
    """The rows sorted along the curve, in files by ranges of it and row groups of about `group_bytes`."""
    keyed = rows.withColumn(KEY, curve_key(F.col(lon), F.col(lat)))
    keyed.repartitionByRange(KEY, lon, lat).sortWithinPartitions(KEY).write.mode("overwrite").option("parquet.block.size", str(group_bytes)).parquet(path)


def in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The rows laid out there that are in the box, its edges included."""
    near = F.lit(False)
    for first, last in key_runs(box):
        near = near | F.col(KEY).between(first, last)
    inside = F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])
    return spark.read.parquet(path).filter(near & inside).drop(KEY)
