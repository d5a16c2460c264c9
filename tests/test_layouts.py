"""Layouts that spare work, and counts and fits that come out of one pass."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelane.operators import fitted, motion
from tidelane.sources import layout, stores


def test_keys_interleave_bits(spark):
    rng = random.Random(1)
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(200)] + [(-180.0, -90.0), (180.0, 90.0), (500.0, -500.0), (None, 1.0)]
    for r in spark.createDataFrame(places, "lon double, lat double").withColumn("key", layout.curve_key(F.col("lon"), F.col("lat"))).collect():
        if r.lon is None:
            assert r.key == -1
            continue
        x, y = (min(max(int((v + h) / (2 * h) * 65536 // 1), 0), 65535) for v, h in ((r.lon, 180), (r.lat, 90)))
        assert r.key == sum(((x >> k) & 1) << (2 * k) | ((y >> k) & 1) << (2 * k + 1) for k in range(16))


@pytest.mark.parametrize("most", [1, 8, 32, 500])
def test_runs_cover_their_box(most):
    rng = random.Random(most)
    spread = lambda v: sum(((v >> k) & 1) << 2 * k for k in range(16))
    for _ in range(30):
        x0, x1 = sorted(rng.uniform(-180, 180) for _ in "ab")
        y0, y1 = sorted(rng.uniform(-90, 90) for _ in "ab")
        runs = layout.key_runs((x0, y0, x1, y1), most)
        assert 1 <= len(runs) <= max(4, most) and all(a <= b for a, b in runs) and all(p[1] < q[0] for p, q in zip(runs, runs[1:]))
        for _ in range(40):
            key = spread(layout._plain_step(rng.uniform(x0, x1), -180.0, 180.0)) | spread(layout._plain_step(rng.uniform(y0, y1), -90.0, 90.0)) << 1
            assert any(a <= key <= b for a, b in runs)
    assert layout.key_runs((1.0, 0.0, 0.0, 1.0)) == []


def test_row_groups_are_skipped(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, rng.uniform(90, 140), rng.uniform(-15, 10), "x" * 200 + str(rng.random())) for k in range(20_000)] + [(-1, None, 1.0, "")]
    frame = spark.createDataFrame(rows, "id long, lon double, lat double, filler string")
    path = f"{tmp_path}/laid"
    layout.write_laid_out(frame, path, group_bytes=100_000)
    box = (100.0, -5.0, 106.0, -1.0)
    got = layout.in_box(spark, path, box)
    want = {k for k, x, y, _ in rows if x is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert {r.id for r in got.collect()} == want and got.columns == frame.columns
    groups = [pq.ParquetFile(f).metadata for f in tmp_path.glob("laid/*.parquet")]
    spans = [(s.min, s.max) for m in groups for g in range(m.num_row_groups) for s in [next(m.row_group(g).column(c).statistics for c in range(m.num_columns) if m.row_group(g).column(c).path_in_schema == layout.KEY)]]
    runs = layout.key_runs(box)
    met = sum(any(a <= high and b >= low for a, b in runs) for low, high in spans)
    assert len(spans) >= 16 and met < len(spans) / 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PushedFilters: .*{layout.KEY}", plan)
    read = got.selectExpr("count(*)")
    read.collect()
    scanned = sum(int(x) for x in re.findall(r"number of output rows: (\d+)", str(_metrics(read))))
    assert 0 < scanned < len(rows) / 2


def _metrics(df):
    """The scan's metrics of a query that has run."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec":
                out.append(f"number of output rows: {node.metrics().apply('numOutputRows').value()}")
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    return out


def test_equal_buckets_join_without_a_shuffle(spark, tmp_path):
    edges = [(k % 97, k, 1.0, 0.0) for k in range(2000)]
    stored = [(s, d, 1.0, 2.0, 3.0, d % 2 == 0, 8.0, 1) for s, d, _, _ in edges if d % 3]
    a = stores.write_bucketed(spark.createDataFrame(edges, "src long, dst long, weight double, bearing double"), "edges_in_buckets", f"file://{tmp_path}/e", 4, "src", "dst")
    b = stores.write_bucketed(spark.createDataFrame(stored, "src long, dst long, roll double, heave double, pitch double, blocked boolean, ship_speed double, condition int"), "stored_in_buckets", f"file://{tmp_path}/s", 4, "src", "dst")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = motion.with_predictions(a, b)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        rows = joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE edges_in_buckets")
        spark.sql("DROP TABLE stored_in_buckets")
    assert len(rows) == 2000 and all(r.missed == (r.dst % 3 == 0) and r.blocked == (r.dst % 3 > 0 and r.dst % 2 == 0) for r in rows)


def test_counts_come_from_the_writing_job(spark, tmp_path):
    rows = spark.range(1000).withColumn("missed", F.col("id") % 4 == 0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "one job")
    try:
        got = stores.written(rows, f"file://{tmp_path}/out", n=F.count(F.lit(1)), misses=F.count_if("missed"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"n": 1000, "misses": 250} and len(tracker.getJobIdsForGroup("counted")) == 1
    assert stores.written(rows.limit(0), f"file://{tmp_path}/none", n=F.count(F.lit(1))) == {"n": 0}


def test_fit_against_least_squares(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3)) * [1, 100, 0.01] + [5, 1e6, 0]
    y = np.stack([2 * x[:, 0] - 0.03 * x[:, 1] + rng.normal(size=500), x[:, 2] * 7 + 1], axis=1)
    names = "a double, b double, c double, t double, u double"
    rows = [tuple(map(float, r)) for r in np.hstack([x, y])] + [(None, 1.0, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, names)
    parameters = fitted.fit(frame, ["a", "b", "c"], ["t", "u"])
    found = fitted.predictions(parameters)
    got = np.array([tuple(r) for r in frame.limit(500).select(found["t"], found["u"]).collect()])
    m = np.hstack([x, np.ones((500, 1))])
    want = m @ np.linalg.lstsq(m, y, rcond=None)[0]
    assert np.allclose(got, want, rtol=1e-6, atol=1e-5)
    f = spark.createDataFrame([(1, 2, 1.0, 0.0, 8.0, 90.0, 2.0, 5.0, 1)], "src long, dst long, weight double, bearing double, ship_speed double, wave_heading double, wave_height double, wave_period double, condition int")
    made = spark.createDataFrame([(t, c, 1.0, 0.0, 1.0, 0.5, 1.0) for t in ("roll", "heave", "pitch") for c in motion.FEATURES], fitted.PARAMETERS)
    assert motion.scored(f, fitted.scorer(made, motion.FEATURES)).first().roll == 8 + 90 + 2 + 5 + 1 + 0.5


def test_fit_of_odd_columns(spark):
    same = spark.createDataFrame([(1.0, float(k), float(2 * k), float(k)) for k in range(9)], "one double, a double, twice double, t double")
    found = fitted.predictions(fitted.fit(same, ["one", "a", "twice"], ["t"]))
    assert all(abs(r[0] - r[1]) < 1e-9 for r in same.select(found["t"], "t").collect())
    none = fitted.fit(same.limit(0), ["a"], ["t"])
    assert none.first().coefficient is None and same.select(fitted.predictions(none)["t"]).first()[0] is None
