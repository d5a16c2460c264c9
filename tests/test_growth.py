"""Operators that go in rounds, on inputs where one task or a driver's loop would show."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import lattice, motion, route
from tidelane.operators.materialise import saved
from tidelane.operators.nearest import nearest
from tidelane.operators.numbering import numbered_in_order
from tidelane.sources import poi


def test_numbers_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "d int, i long").repartition(7)
    got = sorted((r.n, r.d, r.i) for r in numbered_in_order(df, ["d", "i"], "n").collect())
    assert got == [(k, d, i) for k, (d, i) in enumerate(sorted(rows), 1)]
    assert numbered_in_order(df.limit(0), ["d"], "n").count() == 0


def test_ten_thousand_components(spark):
    """Clusters of two nodes at uneven places: each but the first joined to the closest node of a smaller component."""
    rng = np.random.default_rng(3)
    at = rng.choice(400 * 400, 10_000, replace=False)
    nodes = [(2 * k + e, int(a // 400) * 4 + e, int(a % 400) * 4) for k, a in enumerate(at.tolist()) for e in (0, 1)]
    frame = spark.createDataFrame([(i, y, x, float(x), float(y)) for i, x, y in nodes], "node_id long, row_j int, col_i int, lon double, lat double")
    edges = spark.createDataFrame([(2 * k, 2 * k + 1, 1.0, 0.0) for k in range(10_000)], "src long, dst long, weight double, bearing double")
    got = {r.src // 2: (r.src, r.dst) for r in lattice.connect_components(frame, edges).select("src", "dst").collect()}
    assert len(got) == 9_999
    place = np.array([(x, y) for _, x, y in nodes], dtype=np.int64)
    for k in range(1, 10_000, 7):
        best = min((int(d), 2 * k + e, int(j)) for e in (0, 1) for d, j in [min(zip(((place[: 2 * k] - place[2 * k + e]) ** 2).sum(axis=1).tolist(), range(2 * k)))])
        assert got[k] == best[1:], k
    whole = edges.unionByName(lattice.connect_components(frame, edges))
    assert lattice.component_of(frame, whole).select("component").distinct().count() == 1


def test_explored_paths_by_walking_up(spark):
    rng = random.Random(8)
    edges = [(i, j, float(rng.randint(1, 4))) for i in range(60) for j in (i + 1, i + 7) if rng.random() < 0.9]
    graph = spark.createDataFrame(edges, "src long, dst long, weight double")
    dist = route.distances(graph, 0, 50)
    parents = route.parents(dist, graph)
    up = {r.v: r.parent for r in parents.collect()}
    order = {r.explore_order: r.v for r in route.explored(dist, 50).collect()}
    want = []
    for k, v in order.items():
        path = [v]
        while path[-1] != 0:
            path.append(up[path[-1]])
        want += [(k, step, node) for step, node in enumerate(reversed(path))]
    assert sorted(map(tuple, route.explored_paths(dist, parents, 0, 50).collect())) == sorted(want)


def _shuffled(spark) -> int:
    """Bytes written to shuffles in this session so far, once the last tasks' figures are in."""
    time.sleep(1)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


@pytest.mark.parametrize("length", [2, 4, None])
def test_paths_in_stretches_are_whole(spark, length):
    """A chain with side arms at all depths: every step of every path, whatever the stretches' length."""
    chain = [(i, i + 1, 1.0) for i in range(90)] + [(i, 1000 + i, 0.5) for i in range(0, 90, 3)]
    graph = spark.createDataFrame(chain, "src long, dst long, weight double")
    dist = route.distances(graph, 0, 90, tile=lambda c: F.floor(c / 1_000_000))
    order = {r.v: r.explore_order for r in route.explored(dist, 90).collect()}
    want = [(k, step, node) for v, k in order.items() for step, node in enumerate([*range(v % 1000 + 1), *([v] if v >= 1000 else [])])]
    assert sorted(map(tuple, route.explored_paths(dist, route.parents(dist, graph), 0, 90, length).collect())) == sorted(want)


def test_parents_at_no_distance_make_no_ring(spark):
    """5 and 6 lie at one place with 9, and would be each other's least neighbour."""
    graph = spark.createDataFrame([(0, 9, 1.0), (9, 5, 0.0), (9, 6, 0.0), (5, 6, 0.0), (6, 7, 2.0)], "src long, dst long, weight double")
    dist = route.distances(graph, 0)
    up = {r.v: r.parent for r in route.parents(dist, graph, 0).collect()}
    assert up == {9: 0, 5: 9, 6: 9, 7: 6}


def test_paths_are_not_shuffled_by_the_node(spark):
    """Of 801 paths with 321,201 nodes in all, rows for their stretches are shuffled and saved."""
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(800)], "src long, dst long, weight double")
    dist = route.distances(graph, 0, 800, tile=lambda c: F.floor(c / 1_000_000))
    up = saved(route.parents(dist, graph))
    before = _shuffled(spark)
    assert route.explored_paths(dist, up, 0, 800).groupBy().count().first()[0] == 801 * 802 // 2
    assert _shuffled(spark) - before < 1_000_000


def test_near_places_are_not_shuffled_by_the_pair(spark):
    grid = saved(spark.range(40_000).select("id", (F.col("id") % 200).cast("double").alias("x"), F.floor(F.col("id") / 200).cast("double").alias("y")))
    before = _shuffled(spark)
    got = saved(nearest(grid.withColumnRenamed("id", "probe_id"), grid.select(F.col("id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), 13))
    moved = _shuffled(spark) - before
    assert got.count() == 13 * 40_000
    assert {(r.target_id, r.d2) for r in got.filter("probe_id = 20100 AND rank <= 5").collect()} == {(20100, 0.0), (19900, 1.0), (20099, 1.0), (20101, 1.0), (20300, 1.0)}
    assert moved < 400 * 40_000


def test_a_round_reads_its_own_folders(spark):
    """A long chain in small tiles: the search reads folders by their numbers, and finds what a straight sum gives."""
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "src long, dst long, weight double")
    got = {r.v: r.dist for r in route.distances(graph, 0, tile=lambda c: F.floor(c / 16)).collect()}
    assert got == {i: float(i) for i in range(61)}


@pytest.mark.parametrize("band", [0.5, 1.0, 50.0])
def test_rings_of_many_points(spark, band):
    """A circle of many points and a hole in it, in bands of any height."""
    angle = np.linspace(0, 2 * np.pi, 5001)
    rings = [("c", [(float(r * np.cos(a)), float(r * np.sin(a))) for a in angle[:-1]] + [(float(r), 0.0)]) for r in (10.0, 3.0)]
    points = [(k, x / 2, y / 2) for k, (x, y) in enumerate((x, y) for x in range(-24, 25) for y in range(-24, 25))]
    inside = lattice.in_polygons(spark.createDataFrame(points, "point_id long, lon double, lat double"), spark.createDataFrame(rings, "polygon_id string, ring array<struct<lon: double, lat: double>>"), band)
    want = {k for k, x, y in points if 9.01 < x * x + y * y < 99.99}
    got = {r.point_id for r in inside.collect()}
    assert want <= got and all(8.99 < x * x + y * y < 100.01 for k, x, y in points if k in got)


def test_places_by_category(spark):
    sites = {"a": [("one", 1.0, 2.0), ("two", 3.0, 4.0)], "b": [("three", 5.0, 6.0)]}
    rows = poi.from_lists(spark, sites)
    assert sorted(map(tuple, rows.collect())) == [("a", "one", 1.0, 2.0), ("a", "two", 3.0, 4.0), ("b", "three", 5.0, 6.0)]
    assert {r.category: len(r.places) for r in poi.by_category(rows).collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize("stretch", [10, 16, 4096])
def test_rays_over_stretches(spark, stretch):
    """The next node on each of a cell's lines, wherever the lines are cut, also where rows and columns are below 0."""
    rng = random.Random(stretch)
    at = {(j, i): k for k, (j, i) in enumerate((j, i) for j in range(-30, 30) for i in range(-5, 25) if rng.random() < 0.15)}
    nodes = spark.createDataFrame([(k, j, i, i / 64, j / 64) for (j, i), k in at.items()], "node_id long, row_j int, col_i int, lon double, lat double")
    want = set()
    for (j, i), k in at.items():
        for dj, di in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            ends = [at[j + s * dj, i + s * di] for s in range(1, 10) if (j + s * dj, i + s * di) in at]
            want |= {(k, ends[0])} if ends else set()
    got = [(r.src, r.dst) for r in lattice.ray_edges(nodes, stretch=stretch).collect()]
    assert len(got) == len(want) and set(got) == want


def test_edges_are_not_broadcast(spark):
    """Spark takes a lattice's edges for as few as its nodes; joins of both must not send them to the driver."""
    nodes = spark.range(2000).select(F.col("id").alias("node_id"), (F.col("id") % 100).cast("int").alias("row_j"), F.floor(F.col("id") / 100).cast("int").alias("col_i"), (F.col("id") / 64).alias("lon"), (F.col("id") / 64).alias("lat"))
    edges = lattice.ray_edges(nodes)
    waves = spark.range(50).select((F.col("id") % 25).cast("int").alias("row_i"), F.col("id").cast("int").alias("col_j"), *(F.lit(1.0).alias(c) for c in ("height", "period", "direction")))
    moved = motion.scored(motion.features(edges, nodes, waves))
    view = motion.edges_in_view(moved.withColumn("edge_id", F.col("src")), nodes, (0.0, 0.0, 1.0, 1.0))
    for df, most in ((edges, 0), (lattice.isolated(nodes, edges), 0), (lattice.component_of(nodes, edges), 0), (motion.with_predictions(edges, moved), 1), (view, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") <= most, plan  # the waves' cells alone, which the lattice repeats


def test_tiles_follow_the_lattice(spark):
    """A long, narrow lattice has tiles of all its columns; a wide one has square tiles. Bounded by the cells of a tile; the same distances."""
    def lattice_edges(rows, columns):
        ids = spark.range(rows * columns).select((F.col("id") % columns * 1_000_000 + F.floor(F.col("id") / columns)).alias("src"), (F.col("id") % columns).alias("c"), F.floor(F.col("id") / columns).alias("r"))
        ways = ids.select("src", F.explode(F.array(F.when(F.col("c") < columns - 1, F.lit(1_000_000)), F.when(F.col("r") < rows - 1, F.lit(1)))).alias("d")).dropna()
        return ways.select("src", (F.col("src") + F.col("d")).alias("dst"), (1 + F.pmod(F.hash("src", "d"), F.lit(9)).cast("double")).alias("weight"))

    for rows, columns, held, most in ((400, 5, 500, 4), (5, 400, 500, 4), (60, 60, 400, 9), (1, 50, 10, 5)):
        edges = lattice_edges(rows, columns)
        tile = route.tiles_of(edges, held)
        sizes = [r[0] for r in edges.select("src").distinct().groupBy(tile(F.col("src"))).count().select("count").collect()]
        assert max(sizes) <= held and len(sizes) <= most
    edges = lattice_edges(60, 60)
    plain = {r.v: r.dist for r in route.distances(edges, 0).collect()}
    assert plain == {r.v: r.dist for r in route.distances(edges, 0, tile=route.tiles_of(edges, 400)).collect()} and len(plain) == 3600


def test_a_search_goes_in_few_rounds(spark, tmp_path, monkeypatch):
    """The lattice's routes cross a tile of all columns in a round, where small square tiles need one for every 64 rows."""
    from tidelane.plans import routes

    spark.range(50 * 640).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    rounds, improving = [], route._improving
    monkeypatch.setattr(route, "_improving", lambda *a: rounds.append(1) or improving(*a))
    assert routes.route_duration(spark, str(tmp_path)).count() == 1 and len(rounds) <= 2


def _lattice(spark, rows, columns, share, seed):
    """Random nodes, with a few that no ray meets and a part that lies apart."""
    rng = random.Random(seed)
    cells = {(j, i) for j in range(rows) for i in range(columns) if rng.random() < share} | {(j + rows + 12, i) for j in range(9) for i in range(9)} | {(-40, k * 17 - 60) for k in range(4)}
    return lattice.numbered(spark.createDataFrame([(j, i, 100 + i / 64, j / 64) for j, i in cells], "row_j int, col_i int, lon double, lat double")).withColumn("node_id", F.expr("(col_i + 100) * 1000000L + row_j + 100"))


@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
@pytest.mark.parametrize("stretch", [11, 256])
def test_repairs_by_the_rims_are_those_by_all_nodes(spark, share, stretch):
    nodes = saved(_lattice(spark, 50, 40, share, 7))
    rays = saved(lattice.ray_edges(nodes))
    linked = saved(lattice.connect_isolated(nodes, rays))
    want = linked.unionByName(lattice.connect_components(nodes, saved(rays.unionByName(linked))))
    got = lattice.repairs(nodes, stretch=stretch)
    columns = ["src", "dst", "weight", "bearing"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
    own = {r.node_id: (r.lon, r.lat) for r in nodes.collect()}
    assert all((r.lon, r.lat) == own[r.src] for r in got.collect())


def test_grid_cells_in_polygons_by_tiles(spark):
    """Rings with slanted sides, holes, sides that run through cells, and parts beyond the grid: as point by point."""
    rings = spark.createDataFrame([
        ("a", [(5.5, 0.0), (9.0, 1.0), (7.25, 6.5), (5.5, 0.0)]), ("a", [(6.5, 1.5), (7.0, 1.5), (7.0, 2.5), (6.5, 2.5), (6.5, 1.5)]), ("b", [(8.0, 3.0), (30.0, 3.0), (30.0, 30.0), (8.0, 30.0), (8.0, 3.0)]),
        ("c", [(-9.0, -9.0), (-8.0, -9.0), (-8.0, 20.0), (-9.0, -9.0)]), ("d", [(-5.0, 4.1), (5.2, 4.1), (5.2, 4.9), (-5.0, 4.9), (-5.0, 4.1)]),
    ], "polygon_id string, ring array<struct<lon: double, lat: double>>")
    extent = (0.0, 0.0, 10.0, 8.0)
    points = saved(lattice.numbered(lattice.grid(spark, *extent, 0.125)))
    inside = {r.point_id for r in lattice.in_polygons(points.withColumnRenamed("node_id", "point_id"), rings).collect()}
    want = sorted(map(tuple, points.filter(F.col("node_id").isin(list(inside))).collect()))
    for stretch in (7, 256):
        assert sorted(map(tuple, lattice.numbered(lattice.grid_in_polygons(spark, rings, extent, 0.125, stretch)).collect())) == want != []
    assert lattice.grid_in_polygons(spark, rings.filter("polygon_id = 'c'"), extent, 0.125).count() == 0


def test_a_build_shuffles_little_beside_its_cells(spark, tmp_path):
    """Of 250,000 cells in the waters, each goes to its tile and to those around it; their two million edges are shuffled nowhere."""
    from tidelane.plans import routes

    spark.range(10_000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    before = _shuffled(spark)
    edges = routes.lattice_build(spark, str(tmp_path)).count()
    assert edges > 1_400_000 and _shuffled(spark) - before < 12 * edges
