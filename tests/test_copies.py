"""Tables whose rows repeat a few places, and extents of very many cells."""

import random

import pytest
from pyspark.sql import functions as F

from tidelane.functions import geo
from tidelane.operators import lattice
from tidelane.operators import nearest as near


@pytest.mark.parametrize("few", [0, 2000])
@pytest.mark.parametrize("k", [1, 3])
def test_copies_of_places_are_looked_at_once(spark, monkeypatch, k, few):
    seen, plain = [], near._nearest_to_places
    monkeypatch.setattr(near, "_nearest_to_places", lambda asked, targets, *more: seen.append((asked.count(), targets.count())) or plain(asked, targets, *more))
    probes = spark.range(900).select(F.col("id").alias("probe_id"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    targets = spark.range(4000).select(F.col("id").alias("target_id"), (F.col("id") % 4 + 0.25).alias("tx"), F.lit(-0.0).alias("ty"))
    got = {}
    for r in near.nearest(probes, targets, k, few=few).collect():
        got.setdefault(r.probe_id, {})[r.rank] = (r.d2, r.target_id)
    assert got == {p: {n + 1: (0.0625, 4 * n + p % 3) for n in range(k)} for p in range(900)}
    assert seen == [(3, 4 * k)]


@pytest.mark.parametrize("across, along", [(50.0, 24_000.0), (1000.0, 1000.0), (0.0, 5000.0), (0.0, 0.0)])
def test_cells_hold_few_places_in_any_box(across, along):
    width = near.spread(1_000_000, across, along, 8)
    assert width > 0
    assert not across or 1_000_000 * width * width / (across * along) <= 8.01
    assert across or 1_000_000 * width / max(along, 1e-9) <= 8.01 or along == 0


def test_polygons_of_any_width_and_their_copies(spark):
    """Small squares, copies of them, and one wide frame with a hole: in no strip is a polygon missed or counted twice."""
    rng = random.Random(5)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    squares = [(rng.randint(-40, 40) / 4, rng.randint(-40, 40) / 4, rng.choice([0.125, 0.5, 1.0, 3.0])) for _ in range(40)]
    rings = [(f"s{k}-{c}", box(x, y, w, w)) for k, (x, y, w) in enumerate(squares) for c in range(20)] + [("frame", box(-100.0, -100.0, 200.0, 200.0)), ("frame", box(-90.0, -90.0, 180.0, 180.0))]
    points = [(k, rng.randint(-1000, 1000) / 16, rng.randint(-1000, 1000) / 16) for k in range(400)] + [(400 + k, rng.randint(-160, 160) / 16, rng.randint(-160, 160) / 16) for k in range(1500)] + [(2000, 95.0, 0.0), (2001, -95.0, 99.0)]
    got = {r.point_id for r in lattice.in_polygons(spark.createDataFrame(points, "point_id long, lon double, lat double"), spark.createDataFrame(rings, "polygon_id string, ring array<struct<lon: double, lat: double>>")).collect()}
    inside = lambda px, py: any(x <= px <= x + w and y <= py <= y + w for x, y, w in squares) or not max(abs(px), abs(py)) < 90 and max(abs(px), abs(py)) <= 100
    assert got == {k for k, x, y in points if inside(x, y)}


def test_the_first_cells_of_a_very_large_grid(spark):
    got = lattice.numbered(lattice.grid(spark, 0.0, 0.0, 100.0, 40.0, 1e-4, most=400_003), 400_003).agg(F.count("*"), F.max("col_i"), F.max("node_id")).first()
    assert tuple(got) == (400_003, 1, 1_000_002)
    whole = lattice.numbered(lattice.grid(spark, 0.0, 0.0, 10.0, 4.0, 0.5), 13)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, lattice.grid(spark, 0.0, 0.0, 10.0, 4.0, 0.5, most=13).transform(lattice.numbered).collect()))


def test_the_inverse_projection_is_one_compiled_expression(spark):
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"))
    plan = spark.range(9).select(F.col("id").cast("double").alias("e"), F.col("id").cast("double").alias("n")).select(lon, lat)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
