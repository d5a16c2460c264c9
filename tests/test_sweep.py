"""The sweep across failures and restarts, and the newest thing at a time, against plain Python."""

import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators.asof import newest_at
from tidelane.streaming import sweep

SLOTS, VARIABLES = ("00z", "12z"), ("a", "b", "c")


def fetcher():
    """A function of its own, which travels to the tasks whole."""

    def fetch(day, slot, variable):
        if variable == "b" and day.day % 2 == 0:
            raise FileNotFoundError(f"{day} {slot}")
        return day.day + len(slot)

    return fetch


def all_items(days):
    return [(datetime.date(2024, 1, 1) + datetime.timedelta(days=d), s, v) for d in range(days) for s in SLOTS for v in VARIABLES]


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    fetch = fetcher()
    have = [(datetime.date(2024, 1, 2), "00z", "a"), (datetime.date(2024, 1, 3), "12z", "c"), (None, "00z", "a")]
    manifest = spark.createDataFrame(have, "date date, slot string, variable string")
    stream = lambda until: sweep.wanted(spark, "2024-01-01", until, SLOTS, VARIABLES, at_once=5)

    def breaks(batch_id):
        if batch_id == 2:
            raise RuntimeError("the driver is lost")

    path = f"file://{tmp_path}/sweep"
    with pytest.raises(Exception, match="the driver is lost"):
        sweep.swept(stream("2024-01-04"), manifest, fetch, path, 3, breaks)
    assert sweep.log(spark, path).count() > 0
    rows = sweep.swept(stream("2024-01-04"), manifest, fetch, path, 3).collect()
    want = [x for x in all_items(4) if x not in have]
    assert sorted((r.date, r.slot, r.variable) for r in rows) == sorted(want)
    for r in rows:
        failed = r.variable == "b" and r.date.day % 2 == 0
        assert (r.status, r.value) == (("failed", None) if failed else ("stored", r.date.day + 3)) and (r.error or "").startswith("FileNotFoundError") == failed
    # A day later the sweep goes on where it was.
    more = sweep.swept(stream("2024-01-05"), manifest, fetch, path, 3).collect()
    assert sorted((r.date, r.slot, r.variable) for r in more) == sorted(x for x in all_items(5) if x not in have)
    assert len({r.item for r in more}) == len(more)


def test_no_days(spark, tmp_path):
    reader = sweep.WantedReader({"first": "2024-01-02", "until": "2024-01-01", "slots": "a", "variables": "b"})
    assert reader.total() == 0 and list(reader.read({"item": 0})[0]) == [] and reader.read({"item": 0})[1] == {"item": 0}


@pytest.mark.parametrize("parts", [1, 7])
def test_newest_at_a_time(spark, parts):
    rng = random.Random(parts)
    things = [(t, k, float(k)) for k, t in enumerate(rng.randint(0, 200) for _ in range(60))] + [(None, 999, 1.0)]
    rows = [(rng.randint(-20, 230), k, "hot" if k % 3 else "x") for k in range(900)] + [(100, k, "hot") for k in range(900, 1400)] + [(None, 5000, "n")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts * 5))
    try:
        got = newest_at(spark.createDataFrame(rows, "t int, id long, user string"), spark.createDataFrame(things, "t int, k int, wave double"), "t", "k", ["wave"])
        assert got.columns == ["t", "id", "user", "wave"]
        found = {r.id: r.wave for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((t, k, w) for t, k, w in things if t is not None)
    for t, i, _ in rows:
        at = 0 if t is None else bisect.bisect_right([x[0] for x in order], t)
        assert found[i] == (order[at - 1][2] if at else None), (t, i)
    assert len(found) == len(rows)


def test_newest_at_with_one_side_empty(spark):
    rows, things = spark.createDataFrame([(1, 2)], "t int, id int"), spark.createDataFrame([(1, 2, 3.0)], "t int, k int, wave double")
    assert [tuple(r) for r in newest_at(rows, things.limit(0), "t", "k", ["wave"]).collect()] == [(1, 2, None)]
    assert newest_at(rows.limit(0), things, "t", "k", ["wave"]).count() == 0
    with pytest.raises(ValueError):
        newest_at(rows.withColumn("Wave", F.lit(1)), things, "t", "k", ["wave"])
