"""Queries against DuckDB, hand-made cases, and properties."""

import heapq
import json
import math
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from tidelane.functions import display, geo
from tidelane.operators import build, charts, lattice, motion, raster, route
from tidelane.operators.components import connected_components
from tidelane.operators.nearest import nearest
from tidelane.plans.registry import QUERIES, SQL
from tidelane.sources import requests, stores

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(map(tuple, df.select(*[F.col(f"`{c}`") for c in columns]).collect()))
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == plain([tuple(r[k] for k in order) for r in rows.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_geodesy_by_hand(spark):
    lit = [F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]
    assert value(spark, geo.haversine_km(*lit)) == 111.194927
    assert value(spark, geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == 90.0
    assert value(spark, geo.relative_heading(F.lit(0.0), F.lit(100.0))) == 350.0
    east, north = geo.utm(F.lit(111.0), F.lit(0.0))
    assert abs(value(spark, east) - 500_000) < 1e-6 and abs(value(spark, north) - 10_000_000) < 1e-6


def test_utm_comes_back_over_the_whole_extent(spark):
    grid = spark.range(50 * 99).select((92 + (F.col("id") % 99) / 2.0).alias("lon"), (-15 + F.floor(F.col("id") / 99) / 2.0).alias("lat"))
    east, north = geo.utm(F.col("lon"), F.col("lat"))
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"))
    worst = grid.select("lon", "lat", east.alias("e"), north.alias("n")).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-9


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.tuples(st.floats(-180, 180), st.floats(-89, 89), st.floats(-180, 180), st.floats(-89, 89)))
def test_haversine_and_bearing_properties(spark, p):
    a, b, c, d = map(F.lit, p)
    assert value(spark, geo.haversine_km(a, b, c, d)) == pytest.approx(value(spark, geo.haversine_km(c, d, a, b)), abs=1e-6)
    assert 0 <= value(spark, geo.bearing_deg(a, b, c, d)) < 360


@pytest.mark.parametrize("few", [0, 2000])
@pytest.mark.parametrize("k", [1, 5])
def test_nearest_is_exact(spark, few, k):
    rng = random.Random(k)
    targets = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(200)] + [(900, 500.0, 500.0), (901, None, 1.0)]
    probes = [(i, rng.uniform(-20, 60), rng.uniform(-20, 60)) for i in range(60)] + [(99, 480.0, 490.0)]
    got = {}
    rows = nearest(spark.createDataFrame(probes, "probe_id long, x double, y double"), spark.createDataFrame(targets, "target_id long, tx double, ty double"), k, few=few, cell=None if k == 1 else 2.0).collect()
    for r in rows:
        got.setdefault(r.probe_id, []).append((r.rank, r.target_id))
    for i, x, y in probes:
        want = sorted(((x - tx) * (x - tx) + (y - ty) * (y - ty), t) for t, tx, ty in targets if tx is not None)[:k]
        assert sorted(got[i]) == [(n + 1, t) for n, (_, t) in enumerate(want)]


def cells(spark, values):
    return spark.createDataFrame([(k // 3, k % 3, v) for k, v in enumerate(values)], "row_i int, col_j int, v double")


def test_idw_gap_lies_between_its_neighbours(spark):
    rows = {(r.row_i, r.col_j): r for r in raster.idw_filled(cells(spark, [1.0, 2.0, 1.0, 2.0, None, 2.0, 1.0, 2.0, 1.0]), "v").collect()}
    assert rows[1, 1].filled and rows[1, 1].value == pytest.approx((4 * 2 / 1 + 4 * 1 / 2) / (4 / 1 + 4 / 2), abs=1e-6) and not rows[0, 0].filled
    few = {(r.row_i, r.col_j): r for r in raster.idw_filled(cells(spark, [1.0, None, None, None, None, None, None, None, 3.0]), "v").collect()}
    assert all(1 <= r.value <= 3 for r in few.values())
    assert all(r.value is None for r in raster.idw_filled(cells(spark, [None] * 9), "v").collect())


def test_cleaning_and_fallback(spark):
    rows = spark.createDataFrame([(0.0,), (1.5,), (float("nan"),), (2e10,), (-9.0,), (None,)], "value double")
    assert [r.v for r in rows.select(raster.cleaned(F.col("value"), fill=-9.0).alias("v")).collect()] == [None, 1.5, None, None, None, None]
    none = rows.filter("value IS NULL")
    assert raster.with_fallback(none, rows).count() == 6 and raster.with_fallback(rows, none).count() == 6
    with pytest.raises(Exception, match="no valid values"):
        raster.with_fallback(none, none).collect()


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(200)] + [(5000, 5000)]
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for n in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def best_first(edges, start, end):
    ways = {}
    for a, b, w in edges:
        for u, v in ((a, b), (b, a)):
            ways.setdefault(u, {})[v] = min(w, ways.get(u, {}).get(v, math.inf))
    dist, up, done, heap = {start: 0.0}, {}, [], [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done or d > dist[u]:
            continue
        done.append(u)
        if u == end:
            break
        for v, w in ways.get(u, {}).items():
            if d + w < dist.get(v, math.inf):
                dist[v], up[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    path = []
    if end in done:
        path = [end]
        while path[-1] != start:
            path.append(up[path[-1]])
    return done, path[::-1], dist.get(end)


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_match_a_heap_with_ties(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25), float(rng.randint(1, 3))) for _ in range(45)]
    edges = [e for e in edges if e[0] != e[1]]
    graph = spark.createDataFrame(edges, "src long, dst long, weight double")
    for end in (7, 0):
        done, path, _ = best_first(edges, 0, end)
        dist = route.distances(graph, 0, end)
        assert [r.v for r in route.explored(dist, end).orderBy("explore_order").collect()] == done
        assert [r.node_id for r in route.path(route.parents(dist, graph), dist, 0, end).orderBy("step").collect()] == path
    alone = spark.createDataFrame(edges + [(90, 91, 1.0)], "src long, dst long, weight double")
    dist = route.distances(alone, 0, 91)
    assert route.path(route.parents(dist, alone), dist, 0, 91).count() == 0 and route.explored(dist, 91).count() == dist.count()


def test_blocked_routes_and_rule(spark):
    edges = spark.createDataFrame([(1, 2, 1.0, 0.0, True), (2, 3, 1.0, 0.0, True)], "src long, dst long, weight double, bearing double, blocked boolean")
    open_ = edges.filter("NOT blocked")
    dist = route.distances(open_, 1, 3)
    assert [tuple(r) for r in route.explored(dist, 3).select("v").collect()] == [(1,)]
    f = spark.createDataFrame([(1, 2, 1.0, 0.0, 8.0, 90.0, h, 5.0, 1) for h in (0.0, 4.9, None)], "src long, dst long, weight double, bearing double, ship_speed double, wave_heading double, wave_height double, wave_period double, condition int")
    assert [r.blocked for r in motion.scored(f, lambda *a: (a[2] * 2, a[2] * 0, a[2] * 0)).collect()] == [False, True, False]


def test_lattice_repair(spark):
    ids = [(0, 0), (0, 1), (1, 0), (15, 0), (15, 1), (30, 30)]
    nodes = lattice.numbered(spark.createDataFrame([(j, i, 100.0 + i, -5.0 + j) for j, i in ids], "row_j int, col_i int, lon double, lat double"))
    rays = lattice.ray_edges(nodes)
    pairs = {(r.src, r.dst) for r in rays.collect()}
    assert pairs and all((b, a) in pairs for a, b in pairs)
    assert lattice.isolated(nodes, rays).count() == 1
    whole = lattice.built(nodes)
    assert {r.component for r in lattice.component_of(nodes, whole).collect()} == {0}
    assert lattice.connect_components(nodes, whole).count() == 0
    key = nodes.select(lattice.node_key(F.col("lon"), F.col("lat")).alias("k")).orderBy("k").first().k
    assert key == "100.0_-4.0"


def test_view_box_takes_ends_on_its_edge(spark):
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 6.0, 6.0)], "node_id long, lon double, lat double")
    edges = spark.createDataFrame([(0, 1, 2, True), (1, 2, 3, True), (2, 1, 3, False)], "edge_id long, src long, dst long, blocked boolean")
    assert [r.edge_id for r in motion.edges_in_view(edges, nodes, (0.0, 0.0, 1.0, 1.0)).collect()] == [0]
    assert motion.edges_in_view(edges, nodes, (0.0, 0.0, 9.0, 9.0), blocked_only=False, max_edges=2).count() == 2


def test_charts_by_hand(spark):
    flat = spark.createDataFrame([(2.0,), (2.0,)], "height double")
    assert [(r["from"], r["to"], r.colour) for r in charts.legend(flat, "height", "htsgwsfc").collect()] == [(2.0, 2.0, display.GREY)]
    points = spark.range(41).select(F.col("id").alias("step"))
    for n in (0, 1, 2, 5, 19, 20, 21, 39, 41, 100):
        want = ["arrival", *(f"{5 * i}%" for i in range(1, 20) if n >= 2 and i * (n // 20) < n - 1), "Departure"]
        got = charts.percent_labels(points.limit(0) if not n else spark.range(n)).orderBy("position").collect()
        assert [(r.position, r.label) for r in got] == list(enumerate(want)), n
    ends = F.lit(0.0), F.lit(10.0)
    for name, at, want in (("htsgwsfc", 0.0, "rgba(120,180,100,0.8)"), ("htsgwsfc", 10.0, "rgba(220,80,50,0.8)"), ("perpwsfc", 7.5, "rgba(8,190,145,0.8)"), ("dirpwsfc", 10.0, "rgba(200,50,200,0.8)"), ("other", 0.0, "rgba(100,100,150,0.8)"), ("none", 1.0, display.GREY)):
        assert value(spark, display.colour(name, F.lit(at), *ends)) == want, name
    assert value(spark, display.fixed(F.lit(1234567.0))) == "1234567.000000"
    assert value(spark, F.concat_ws(",", charts.sub_arcs([0.5, 1.0], F.lit(4.0)))) == "2.0,4.0"
    delays = spark.range(100).select(display.start_delay(F.lit("calm"), 3).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert 2 <= delays[0] and delays[1] < 5.5


def test_stores_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("htsgwsfc", "20240101", "06z", 0, 0, 1.0, 2.0, None), ("perpwsfc", "20240101", "06z", 0, 0, 1.0, 2.0, 3.5)], stores.RASTER)
    stores.write_raster(rows, f"{tmp_path}/rasters")
    assert [r.value for r in stores.read_raster(spark, f"{tmp_path}/rasters", "perpwsfc", "20240101", "06z").collect()] == [3.5]
    with pytest.raises(ValueError):
        stores.write_raster(rows.withColumn("variable", F.lit("x")), f"{tmp_path}/rasters")
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"1_2": [1.0, 2.0]}, "edges": [{"source": "1_2", "target": "3_4", "weight": 1.5, "bearing": 90.0}]}))
    nodes, edges = stores.read_graph_json(spark, f"{tmp_path}/g.json")
    assert tuple(nodes.first()) == ("1_2", 1.0, 2.0) and edges.first().weight == 1.5
    stores.write_graph(nodes, edges, f"{tmp_path}/graph")
    assert stores.read_graph(spark, f"{tmp_path}/graph")[1].count() == 1
    stores.write_edges_json(edges, f"{tmp_path}/edges")
    assert spark.read.json(f"{tmp_path}/edges").count() == 1
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    shapes = [("Polygon", [square]), ("MultiPolygon", [[square], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]), ("Point", [1, 2])]
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [{"geometry": {"type": t, "coordinates": c}} for t, c in shapes]}))
    rings = stores.read_geojson(spark, f"{tmp_path}/p.geojson")
    assert rings.count() == 3
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 3.0, 1.0), (4, 5.9, 5.5), (5, 5.1, 5.9)], "point_id long, lon double, lat double")
    assert sorted(r.point_id for r in lattice.in_polygons(points, rings).collect()) == [1, 2, 4]
    (tmp_path / "e.geojson").write_text(json.dumps({"features": []}))
    with pytest.raises(ValueError):
        stores.read_geojson(spark, f"{tmp_path}/e.geojson")
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "only.json").write_text("{}")
    assert stores.newest_file(spark, f"{tmp_path}/cache").first().path.endswith("only.json")


def test_columns_of_ones_own(spark):
    """Rows may have columns of any name; where a result would hide one it is an error."""
    rows = spark.createDataFrame([(0, 0, 1.0, 1.0, 2.0, "mine"), (0, 1, None, 1.0, 3.0, "mine"), (1, 0, 3.0, 2.0, 2.0, "mine")], "row_i int, col_j int, v double, lat double, lon double, id string")
    wide = rows.withColumns({c: F.lit("mine") for c in ("mean", "value", "_x", "along", "_now", "_from", "own", "use")})
    for fill in (raster.idw_filled, raster.linear_filled, raster.griddata_filled):
        assert sorted(map(tuple, fill(wide, "v").collect())) == sorted(map(tuple, fill(rows, "v").collect()))
    assert raster.with_fallback(wide.select("v", "_now", "_from", "own", "use"), wide, "v").columns == ["v", "_now", "_from", "own", "use"]
    with pytest.raises(ValueError):
        raster.visible(rows.withColumn("X", F.lit(1)), (0.0, 0.0, 1.0, 1.0), 0.1)
    assert "x" in raster.visible(rows.withColumn("x", F.lit("mine")), (0.0, 0.0, 9.0, 9.0), 0.1, "east", "north").columns


def test_requests(spark):
    assert requests.build_problems(spark, {"GRID_SPACING": 1}) == ["GEOJSON_FILE", "EXTENT", "OUTPUT_FILE"]
    with pytest.raises(ValueError, match="no file /nowhere"):
        build.build_lattice(spark, {"GEOJSON_FILE": "/nowhere", "GRID_SPACING": 1.0, "EXTENT": (0, 0, 1, 1), "OUTPUT_FILE": "x"})
    places = spark.createDataFrame([("to", 1), ("from", 2), ("via", 3)], "type string, position int")
    assert [r.type for r in requests.ordered_locations(places).collect()] == ["from", "to", "via"]
    cache = spark.createDataFrame([("k", True, 2, "b"), ("k", True, 1, "a"), ("k", False, 0, "c")], "key string, fixed boolean, stored_at int, path string")
    assert stores.cached(cache, F.lit("k")).first().path == "a"


def test_snapshot_problems(spark):
    rows = [("a", 0, 0, 1.0, 2.0, 1.0), ("a", 0, 1, 1.0, 3.0, 1.0), ("b", 0, 0, 1.5, 2.0, None)]
    found = raster.snapshot_problems(spark.createDataFrame(rows, "variable string, row_i int, col_j int, lat double, lon double, value double")).collect()
    assert sorted((r.variable or "", r.problem) for r in found) == [("", "coordinates"), ("b", "cells"), ("b", "values")]


def test_projection_by_arc_lengths_and_angles(spark):
    """Along the central meridian the northing is the ellipsoid's arc, and the projection keeps angles: together they fix it everywhere."""
    a, f, k0 = 6378137.0, geo.FLATTENING, 0.9996
    e2 = f * (2 - f)

    def arc(lat, steps=20_000):
        h = math.radians(lat) / steps
        return sum(a * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * h) ** 2) ** 1.5 for k in range(steps)) * h

    def projected(rows):
        df = spark.createDataFrame(rows, "lon double, lat double")
        return [tuple(r) for r in df.coalesce(1).select(*geo.utm(F.col("lon"), F.col("lat"))).collect()]

    for lat, (east, north) in zip((-15.0, -7.25, 0.0, 9.5), projected([(111.0, x) for x in (-15.0, -7.25, 0.0, 9.5)])):
        assert abs(east - 500_000) < 1e-6 and abs(north - 10_000_000 - k0 * arc(lat)) < 1e-3
    d = 1e-5
    for lon, lat in ((113.0, -8.0), (105.0, 3.0), (120.0, -14.0)):
        (x0, y0), (x1, y1), (x2, y2) = projected([(lon, lat), (lon + d, lat), (lon, lat + d)])
        s = math.sin(math.radians(lat))
        along, up = a * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * s * s), a * (1 - e2) / (1 - e2 * s * s) ** 1.5
        assert abs((x1 - x0) / along - (y2 - y0) / up) < 1e-7 and abs((y1 - y0) / along + (x2 - x0) / up) < 1e-7


def test_routes_cross_tiles(spark):
    """Small tiles, so that routes and labels pass through many; against a search in plain Python."""
    import heapq
    import random

    rng = random.Random(5)
    edges = [(i * 1_000_000 + j, (i + di) * 1_000_000 + j + dj, rng.random() + 0.1) for i in range(12) for j in range(12) for di, dj in ((0, 1), (1, 0), (1, 1)) if rng.random() < 0.8]
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w)), near.setdefault(v, []).append((u, w))
    start = 0
    dist, todo, seen = {start: 0.0}, [(0.0, start)], set()
    while todo:
        d, u = heapq.heappop(todo)
        if u in seen:
            continue
        seen.add(u)
        for v, w in near.get(u, ()):
            if d + w < dist.get(v, math.inf):
                dist[v] = d + w
                heapq.heappush(todo, (d + w, v))
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    def tile(c):
        return F.floor(c / 4_000_000) * 1000 + F.floor(c % 1_000_000 / 4)

    got = {r.v: r.dist for r in route.distances(df, start, tile=tile).collect()}
    assert got == dist
    end = max(dist)
    found = route.distances(df, start, end, tile=tile)
    steps = [r.node_id for r in route.path(route.parents(found, df), found, start, end, tile=tile).orderBy("step").collect()]
    weights = {(u, v): w for u, v, w in edges} | {(v, u): w for u, v, w in edges}
    assert steps[0] == start and steps[-1] == end and sum(weights[x] for x in zip(steps, steps[1:])) == pytest.approx(dist[end])
    assert route.path(route.parents(found, df), found, start, 999, tile=tile).count() == 0
