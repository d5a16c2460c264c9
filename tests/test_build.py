"""The build of a lattice over a whole extent."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidelane.functions import geo
from tidelane.operators import lattice
from tidelane.operators.materialise import saved
from tidelane.plans import routes


def test_a_build_covers_the_whole_extent(spark, tmp_path):
    """Cells of all columns, from the westernmost part to the easternmost, as point by point; each is some edge's source or target."""
    spark.range(300).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    lon, lat = [92 + (k * 37 % 490) / 10 for k in range(300)], [-15 + (k * 53 % 250) / 10 for k in range(300)]
    basins = [(k, 92 + (k * 91 % 490) / 10, -15 + (k * 29 % 250) / 10) for k in range(40)]

    def wet(x, y):
        near = ((k, abs(x - a), abs(y - b)) for k, a, b in basins)
        return any(dx <= 0.453125 and dy <= 0.453125 and not (k % 2 == 0 and dx < 0.140625 and dy < 0.140625) for k, dx, dy in near)

    columns, rows = range(math.ceil(max(lon) - min(lon))), range(math.ceil(max(lat) - min(lat)))
    want = {i * 1_000_000 + j for i in columns for j in rows if wet(round(min(lon) + i, 6), round(min(lat) + j, 6))}
    edges = routes.lattice_build(spark, str(tmp_path)).collect()
    assert {e.src for e in edges} | {e.dst for e in edges} == want
    assert min(e.lon for e in edges) < 94 and max(e.lon for e in edges) > 138


def test_tiles_from_polygons_are_those_of_their_cells(spark):
    """Rays, repairs and cells by tiles that their tasks make from slanted rings with holes and islands apart: as by the cells themselves, in large and small tiles."""
    rings = spark.createDataFrame([
        ("a", [(0.5, 0.0), (9.0, 1.0), (7.25, 6.5), (0.5, 0.0)]), ("a", [(6.5, 1.5), (7.0, 1.5), (7.0, 2.5), (6.5, 2.5), (6.5, 1.5)]), ("b", [(8.0, 3.0), (30.0, 3.0), (30.0, 30.0), (8.0, 30.0), (8.0, 3.0)]),
        ("c", [(0.1, 7.1), (0.3, 7.1), (0.3, 7.3), (0.1, 7.3), (0.1, 7.1)]), ("d", [(3.1, 4.6), (3.13, 4.6), (3.13, 6.7), (3.1, 6.7), (3.1, 4.6)]),
    ], "polygon_id string, ring array<struct<lon: double, lat: double>>")
    extent, columns = (0.0, 0.0, 10.0, 8.0), ["src", "dst", "weight", "bearing", "lon", "lat"]
    nodes = saved(lattice.numbered(lattice.grid_in_polygons(spark, rings, extent, 0.123457, west=0.0)))
    want = sorted(map(tuple, lattice.built(nodes, placed=True).select(columns).collect()))
    for stretch in (11, 256):
        waters = lattice.Waters(spark, rings, extent, 0.123457, stretch, 0.0)
        assert sorted(map(tuple, waters.cells().collect())) == sorted(map(tuple, nodes.drop("node_id").collect()))
        assert sorted(map(tuple, lattice.built(waters, placed=True).select(columns).collect())) == want != []


@pytest.mark.parametrize("apart", [0.0, 1e-4])
def test_edges_are_measured_as_columns_are(spark, apart):
    """Weights and bearings, once for each row and distance of columns, or by the edge where nodes lie off their rows: as Spark's expressions."""
    rng = random.Random(3)
    cells = [(j, i, round(95 + i / 37 + apart * rng.random(), 6), round(-9 + j / 41 + apart * rng.random(), 6)) for j in range(60) for i in range(60) if rng.random() < 0.8]
    nodes = lattice.numbered(spark.createDataFrame(cells, "row_j int, col_i int, lon double, lat double"))
    a, b = (nodes.select(F.col("node_id").alias(n), F.col("lon").alias(f"lon_{n}"), F.col("lat").alias(f"lat_{n}")) for n in ("src", "dst"))
    ends = [F.col(c) for c in ("lon_src", "lat_src", "lon_dst", "lat_dst")]
    edges = saved(lattice.ray_edges(nodes)).join(a, "src").join(b, "dst")
    assert edges.count() > 15_000
    assert edges.filter((F.col("weight") != geo.haversine_km(*ends)) | (F.col("bearing") != geo.bearing_deg(*ends))).count() == 0


def test_a_build_shuffles_no_cells(spark, tmp_path):
    """Of some 500,000 cells none is shuffled, and their tiles have tasks of their own, however few bytes their polygons have."""
    spark.range(20_000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(500).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    executors = spark.sparkContext._jsc.sc().statusStore().executorList

    def shuffled():
        time.sleep(1)
        found = executors(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = shuffled()
    edges = routes.lattice_build(spark, str(tmp_path)).count()
    wrote = shuffled() - before
    assert edges > 4_000_000 and wrote < 2 * edges, (edges, wrote)
