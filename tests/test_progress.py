"""Search progress: any split of the messages into batches, in any order, gives what their order gives."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidelane.streaming import progress
from tidelane.streaming.snapshots import run_once

SCHEMA = "search_id long, ts timestamp, seq long, kind string, payload string"


def messages(n=160, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        kind = rng.choices(["expansion", "partial_path", "final", "other"], [6, 3, 0.4, 1])[0]
        out.append((rng.choice([1, 1, 1, 2, 3]), f"2024-01-{1 + k // 20:02d} {k % 20:02d}:30:00", k, kind, f"p{k}" if rng.random() < 0.9 else None))
    return out


def plain(rows):
    want = {}
    for search, own in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        want[search] = progress.folded((0, None, False), [(0, s, k, p) for _, _, s, k, p in own])
    return want


def streamed(spark, path, batches, **options):
    """What the stream over files, one to a batch, gives last for each search."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "search_id long, ts string, seq long, kind string, payload string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.parquet(f"{path}/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    got = run_once(progress.search_progress(stream, **options), "test", "update", ("search_id",), progress.STORE)
    return {r.search_id: (r.expansions, r.last_partial, r.closed) for r in got.collect()}


@pytest.mark.parametrize("n_batches", [1, 5])
def test_any_split_in_any_order(spark, tmp_path, n_batches):
    rows = [r for r in messages() if r[3] != "final"] + [(1, "2024-01-06 00:00:00", 500, "final", None), (2, "2024-01-03 10:30:00", 501, "final", None)]
    random.Random(n_batches).shuffle(rows)
    rows.sort(key=lambda r: r[3] != "final")  # the ends arrive first
    got = streamed(spark, str(tmp_path / "in"), [rows[k::n_batches] if n_batches == 1 else rows[k * len(rows) // n_batches : (k + 1) * len(rows) // n_batches] for k in range(n_batches)], late="100 days")
    assert got == plain(rows) and got[1][2] and got[2][2] and not got[3][2]


def test_settled_by_the_watermark(spark, tmp_path):
    """In the order of time, with a narrow watermark: timers settle what is past, and the results are the same."""
    rows = messages(seed=5)
    got = streamed(spark, str(tmp_path / "in"), [rows[k : k + 40] for k in range(0, 160, 40)], late="1 hour", keep="30 days")
    assert got == plain(rows)


def test_late_and_forgotten(spark, tmp_path):
    first, second = [(1, "2024-01-01 00:00:00", 1, "expansion", None)], [(2, "2024-03-01 00:00:00", 2, "expansion", None)]
    third = [(1, "2024-01-01 01:00:00", 3, "final", None), (2, "2024-03-01 01:00:00", 4, "expansion", None)]  # the first comes too late
    fourth = [(1, "2024-03-02 00:00:00", 5, "expansion", None)]  # heard of again after it was forgotten
    got = streamed(spark, str(tmp_path / "in"), [first, second, third, fourth], late="1 hour", keep="2 days")
    assert got == {1: (1, None, False), 2: (2, None, False)}


def test_settings_are_put_back(spark, tmp_path):
    key = next(iter(progress.STORE))
    before = spark.conf.get(key, None)
    streamed(spark, str(tmp_path / "in"), [messages(20)])
    assert spark.conf.get(key, None) == before
