"""Queries over the lattice: its edges, components, blocked edges and routes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelane.operators import build, charts, lattice, motion, route
from tidelane.operators.materialise import saved, work_dir
from tidelane.operators.nearest import nearest
from tidelane.plans.derived import ALONE, CELLS, IN_RING, LINKED, MOVED, PARTS, RAYS, SUPPLIERS, WATER, bearing, cells, in_cells, km, parts, rings, water
from tidelane.plans.registry import query
from tidelane.sources import stores

#: A node in the west, the last one of another of its columns, and one in an eastern basin.
START = 1_000_003
END, FAR = ("SELECT max(node_id) FROM water WHERE col_i = 15", "SELECT min(node_id) FROM water WHERE col_i = 40")
BOX = (92.1, -14.9, 92.6, -14.4)


def _end(nodes):
    """The number of END, one value."""
    return nodes.filter("col_i = 15").agg(F.max("node_id")).first()[0]


def _far(nodes):
    return nodes.filter("col_i = 40").agg(F.min("node_id")).first()[0]


@query(f"WITH {WATER} SELECT node_id, row_j, col_i, lon, lat FROM water")
def lattice_nodes(spark, sf_dir):
    return water(spark, sf_dir)


def _extent_sql(first: str) -> str:
    """The cells of the parts' extent from the longitude `first` to the east."""
    return f"""ends AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1, 1e0 / greatest(1, count(*) // 500) AS d FROM parts),
lines AS (SELECT *, unnest(range(CAST(ceil((y1 - y0) / d) AS BIGINT))) AS j FROM ends), places AS (SELECT *, unnest(range(CAST(ceil((x1 - ({first})) / d) AS BIGINT))) AS i FROM lines),
grid AS (SELECT CAST(j AS INTEGER) AS row_j, CAST(i AS INTEGER) AS col_i, round({first} + i * d, 6) AS lon, round(y0 + j * d, 6) AS lat FROM places)"""


_EXTENT = _extent_sql("x0 + (x1 - x0) * 5e-1")


def _extent(spark, sf_dir):
    """The extent of the parts' places, and a spacing that narrows as they get more."""
    ends = parts(spark, sf_dir).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat"), F.count("*")).first()
    return *ends[:4], 1.0 / max(1, ends[4] // 500)


@query(f"WITH {PARTS}, {_EXTENT} SELECT CAST(col_i AS BIGINT) * 1000000 + row_j AS node_id, row_j, col_i, lon, lat FROM grid ORDER BY 1 LIMIT 100000")
def lattice_grid(spark, sf_dir):
    """The node cap is the feature: the first hundred thousand cells, column by column."""
    return lattice.numbered(lattice.grid(spark, *_extent(spark, sf_dir), most=100_000), 100_000)


@query(f"""WITH {PARTS}, {SUPPLIERS}, near AS (SELECT p.id AS point_id, s.id, abs(p.lon - s.lon) AS abs_x, abs(p.lat - s.lat) AS abs_y FROM parts p, suppliers s)
SELECT DISTINCT point_id FROM near s WHERE {IN_RING}""")
def point_in_polygon(spark, sf_dir):
    """The parts in the suppliers' waters."""
    return lattice.in_polygons(parts(spark, sf_dir).withColumnRenamed("id", "point_id"), rings(spark, sf_dir))


@query(f"WITH {WATER}, {RAYS} SELECT src, dst, weight, bearing FROM rays")
def ray_edges(spark, sf_dir):
    return lattice.ray_edges(water(spark, sf_dir))


@query(f"WITH {WATER}, {RAYS}, {ALONE} SELECT node_id, row_j, col_i, lon, lat FROM alone")
def isolated_nodes(spark, sf_dir):
    nodes = water(spark, sf_dir)
    return lattice.isolated(nodes, lattice.ray_edges(nodes))


@query(f"WITH {WATER}, {RAYS}, {ALONE}, {LINKED} SELECT src, dst, weight, bearing FROM linked")
def connect_isolated(spark, sf_dir):
    nodes = water(spark, sf_dir)
    return lattice.connect_isolated(nodes, saved(lattice.ray_edges(nodes)))


_LABELS = f"""WITH RECURSIVE {WATER}, {RAYS}, both_ways AS (SELECT src, dst FROM rays UNION SELECT dst, src FROM rays),
reached AS (SELECT node_id AS node, node_id AS label FROM water UNION SELECT r.node, b.dst FROM reached r JOIN both_ways b ON b.src = r.label WHERE b.dst <> r.node)
"""


@query(_LABELS + "SELECT node AS node_id, min(label) AS component FROM reached GROUP BY node")
def component_labels(spark, sf_dir):
    nodes = water(spark, sf_dir)
    return lattice.component_of(nodes, lattice.ray_edges(nodes))


@query(_LABELS + "SELECT count(*) AS components, max(n) AS largest, count(*) = 1 AS connected FROM (SELECT component, count(*) AS n FROM (SELECT node, min(label) AS component FROM reached GROUP BY node) GROUP BY component)")
def component_count(spark, sf_dir):
    nodes = water(spark, sf_dir)
    sizes = lattice.component_of(nodes, lattice.ray_edges(nodes)).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), (F.count("*") == 1).alias("connected"))


#: All edges of a lattice `water`: rays, connectors of isolated nodes, and for each component but the first the closest pair with what precedes it.
_BUILT = f"""{RAYS}, {ALONE}, {LINKED},
first_edges AS (SELECT * FROM rays UNION ALL SELECT * FROM linked), both_ways AS (SELECT src, dst FROM first_edges UNION SELECT dst, src FROM first_edges),
reached AS (SELECT node_id AS node, node_id AS label FROM water UNION SELECT r.node, b.dst FROM reached r JOIN both_ways b ON b.src = r.label WHERE b.dst <> r.node),
placed AS (SELECT w.*, component FROM water w JOIN (SELECT node AS node_id, min(label) AS component FROM reached GROUP BY node) USING (node_id)),
closest AS (SELECT a.component, a.node_id AS src, b.node_id AS dst, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2,
    row_number() OVER (PARTITION BY a.component ORDER BY (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat), a.node_id, b.node_id) AS nth FROM placed a JOIN placed b ON b.component < a.component),
built AS (SELECT * FROM first_edges UNION ALL SELECT src, dst, {km('lon1', 'lat1', 'lon2', 'lat2')}, {bearing('lon1', 'lat1', 'lon2', 'lat2')} FROM closest WHERE nth = 1)"""


@query(f"WITH RECURSIVE {WATER}, {_BUILT} SELECT src, dst, weight, bearing, true AS connected FROM built")
def component_repair(spark, sf_dir):
    """All edges of the repaired lattice, and that it is connected."""
    nodes = water(spark, sf_dir)
    edges = saved(lattice.built(nodes))
    one = lattice.component_of(nodes, edges).agg((F.count_distinct("component") == 1).alias("connected"))
    return edges.join(F.broadcast(one))


_BASIN_WATER = f"""{PARTS}, {SUPPLIERS}, {_extent_sql("x0")}, cells_of AS (SELECT CAST(col_i AS BIGINT) * 1000000 + row_j AS node_id, * FROM grid),
met AS (SELECT g.node_id, s.id, abs(g.lon - s.lon) AS abs_x, abs(g.lat - s.lat) AS abs_y FROM cells_of g, suppliers s),
water AS (SELECT node_id, row_j, col_i, lon, lat FROM cells_of WHERE node_id IN (SELECT node_id FROM met s WHERE {IN_RING}))"""


@query(f"WITH RECURSIVE {_BASIN_WATER}, {_BUILT} SELECT src, dst, round(weight, 6) AS weight, round(bearing, 6) AS bearing, a.lon, a.lat FROM built JOIN water a ON a.node_id = src")
def lattice_build(spark, sf_dir):
    """The whole build from settings: polygons from a file of features, a lattice over the parts' whole extent, its cells within them, rays, repairs, written as a graph and read again."""
    path = f"{work_dir(spark).rstrip('/')}/lattice-{uuid.uuid4().hex}"
    stores.write_geojson_lines(rings(spark, sf_dir), f"{path}/polygons")
    *extent, spacing = _extent(spark, sf_dir)
    build.build_lattice(spark, {"GEOJSON_FILE": f"{path}/polygons", "LINES": True, "GRID_SPACING": spacing, "EXTENT": extent, "OUTPUT_FILE": path})
    return stores.read_graph(spark, path)[1].select("src", "dst", "weight", "bearing", "lon", "lat")  # rounded by the build


def _moved(spark, sf_dir):
    nodes = water(spark, sf_dir)
    return motion.scored(motion.features(lattice.ray_edges(nodes), in_cells(nodes), cells(spark, sf_dir)))


@query(f"WITH {WATER}, {RAYS}, {CELLS}, {MOVED} SELECT src, dst, roll, heave, pitch, blocked FROM moved")
def motion_blocked_edges(spark, sf_dir):
    return _moved(spark, sf_dir).select("src", "dst", "roll", "heave", "pitch", "blocked")


@query(f"""WITH {WATER}, {RAYS}, {CELLS}, {MOVED}, kept AS (SELECT * FROM moved WHERE (src + dst) % 3 <> 0)
SELECT r.src, r.dst, r.weight, r.bearing, coalesce(k.roll, 0) AS roll, coalesce(k.heave, 0) AS heave, coalesce(k.pitch, 0) AS pitch, coalesce(k.blocked, false) AS blocked, k.src IS NULL AS missed
FROM rays r LEFT JOIN kept k ON k.src = r.src AND k.dst = r.dst""")
def edge_prediction_join(spark, sf_dir):
    """Predictions stored for two thirds of the edges; the others miss."""
    stored = _moved(spark, sf_dir).filter((F.col("src") + F.col("dst")) % 3 != 0)
    return motion.with_predictions(lattice.ray_edges(water(spark, sf_dir)), stored)


@query(f"""WITH {WATER}, {RAYS}, {CELLS}, {MOVED} SELECT edge_id, a.lon AS src_lon, a.lat AS src_lat, b.lon AS dst_lon, b.lat AS dst_lat, blocked
FROM moved m JOIN water a ON a.node_id = src JOIN water b ON b.node_id = dst
WHERE blocked AND ((a.lon BETWEEN 921e-1 AND 926e-1 AND a.lat BETWEEN -149e-1 AND -144e-1) OR (b.lon BETWEEN 921e-1 AND 926e-1 AND b.lat BETWEEN -149e-1 AND -144e-1)) ORDER BY edge_id LIMIT 300000""")
def blocked_edges_in_view(spark, sf_dir):
    """The limit is the feature: the first edges, by number, that a map shows."""
    return motion.edges_in_view(_moved(spark, sf_dir).withColumn("edge_id", F.col("src") * 100_000_000 + F.col("dst")), water(spark, sf_dir), BOX)


@query(f"""WITH {WATER}, {RAYS}, {CELLS}, {MOVED}, kept AS (SELECT * FROM moved WHERE (src + dst) % 3 <> 0)
SELECT r.src, r.dst, r.weight, coalesce(k.roll, 0) AS roll, coalesce(k.blocked, false) AS blocked, k.src IS NULL AS missed FROM rays r LEFT JOIN kept k ON k.src = r.src AND k.dst = r.dst""")
def prediction_store(spark, sf_dir):
    """Predictions and edges kept in equal buckets, joined without a shuffle."""
    name = uuid.uuid4().hex
    kept = lambda rows, what: stores.write_bucketed(rows, f"{what}_{name}", f"{work_dir(spark).rstrip('/')}/{what}-{name}", 8, "src", "dst")
    edges = kept(lattice.ray_edges(water(spark, sf_dir)), "edges")
    stored = kept(_moved(spark, sf_dir).filter((F.col("src") + F.col("dst")) % 3 != 0), "predictions")
    return motion.with_predictions(edges, stored).select("src", "dst", "weight", "roll", "blocked", "missed")


@query(f"""WITH {WATER}, {RAYS} SELECT (SELECT count(*) FROM water) AS nodes, (SELECT count(*) FROM rays) AS edges, (SELECT count(*) FROM rays WHERE (src + dst) % 3 = 0) AS misses""")
def build_counters(spark, sf_dir):
    """Nodes, edges and missed predictions, counted by the jobs that write them."""
    nodes, path = water(spark, sf_dir), f"{work_dir(spark).rstrip('/')}/counted-{uuid.uuid4().hex}"
    counts = stores.write_graph(nodes, lattice.ray_edges(nodes), path)
    edges = stores.read_graph(spark, path)[1]
    stored = _moved(spark, sf_dir).filter((F.col("src") + F.col("dst")) % 3 != 0)
    counts |= stores.written(motion.with_predictions(edges, stored), f"{path}/predicted", misses=F.count_if("missed"))
    return spark.createDataFrame([(counts["nodes"], counts["edges"], counts["misses"])], "nodes long, edges long, misses long")


_SEARCH = """ways AS (SELECT u, v, min(w) AS w FROM (SELECT src AS u, dst AS v, weight AS w FROM graph UNION ALL SELECT dst, src, weight FROM graph) GROUP BY u, v),
found(v, d) USING KEY (v) AS (SELECT CAST({start} AS BIGINT), 0e0 UNION SELECT e.v, min(f.d + e.w) FROM found f JOIN ways e ON e.u = f.v LEFT JOIN recurring.found k ON k.v = e.v WHERE k.d IS NULL OR f.d + e.w < k.d GROUP BY e.v)"""
_PARENTS = """parents AS (SELECT v, u AS parent FROM (SELECT e.v, e.u, row_number() OVER (PARTITION BY e.v ORDER BY a.d, e.u) AS k FROM ways e JOIN found a ON a.v = e.u JOIN found b ON b.v = e.v WHERE a.d + e.w = b.d) WHERE k = 1)"""
_PATH = """walk(node_id, back) AS (SELECT CAST({end} AS BIGINT), 0 WHERE EXISTS (SELECT 1 FROM found WHERE v = {end}) UNION ALL SELECT p.parent, w.back + 1 FROM walk w JOIN parents p ON p.v = w.node_id WHERE w.node_id <> {start})"""


def _route_sql(graph: str, end: str = END) -> str:
    search = ", ".join((_SEARCH, _PARENTS, _PATH)).format(start=START, end="(SELECT b FROM ends)")
    return f"WITH RECURSIVE {WATER}, {RAYS}, {CELLS}, {MOVED}, graph AS ({graph}), ends AS (SELECT ({end}) AS b), {search}\n"


_STEPS = "SELECT CAST((SELECT max(back) FROM walk) - back AS BIGINT) AS step, node_id, round(d, 6) AS dist FROM walk JOIN found ON v = node_id"


def _route(graph, start, end):
    tile = route.tiles_of(graph)
    dist = route.distances(graph, start, end, tile=tile)
    return route.path(saved(route.parents(dist, graph)), dist, start, end, tile)


@query(_route_sql("SELECT * FROM rays") + _STEPS)
def shortest_route(spark, sf_dir):
    nodes = water(spark, sf_dir)
    return _route(saved(lattice.ray_edges(nodes)), START, _end(nodes)).withColumn("dist", F.round("dist", 6))


@query(_route_sql("SELECT * FROM moved WHERE NOT blocked") + _STEPS)
def safest_route(spark, sf_dir):
    return _route(saved(_moved(spark, sf_dir).filter("NOT blocked")), START, _end(water(spark, sf_dir))).withColumn("dist", F.round("dist", 6))


#: A request's coordinates, start and end.
ASKED = ((92.02, -14.97), (92.23, -14.5))
_NEAREST = "(SELECT node_id FROM water ORDER BY (lon - {0!r}) * (lon - {0!r}) + (lat - {1!r}) * (lat - {1!r}), node_id LIMIT 1)"


def _asked_sql() -> str:
    start, end = (_NEAREST.format(*at) for at in ASKED)
    search = ", ".join((_SEARCH, _PARENTS, _PATH)).format(start="(SELECT a FROM ends)", end="(SELECT b FROM ends)")
    return f"WITH RECURSIVE {WATER}, {RAYS}, {CELLS}, {MOVED}, graph AS (SELECT * FROM moved WHERE NOT blocked), ends AS (SELECT {start} AS a, {end} AS b), {search}\n"


@query(_asked_sql() + _STEPS)
def requested_route(spark, sf_dir):
    """The safest route between the water nodes nearest to a request's coordinates."""
    nodes = water(spark, sf_dir)
    places = spark.createDataFrame([(k, *at) for k, at in enumerate(ASKED)], "probe_id long, x double, y double")
    near = nearest(places, nodes.select(F.col("node_id").alias("target_id"), F.col("lon").alias("tx"), F.col("lat").alias("ty")))
    start, end = (r.target_id for r in near.orderBy("probe_id").collect())  # two rows
    graph = saved(_moved(spark, sf_dir).filter("NOT blocked"))
    return _route(graph, start, end).withColumn("dist", F.round("dist", 6))


@query(_route_sql("SELECT * FROM rays", FAR) + _STEPS)
def unreachable_route(spark, sf_dir):
    nodes = water(spark, sf_dir)
    return _route(saved(lattice.ray_edges(nodes)), START, _far(nodes)).withColumn("dist", F.round("dist", 6))


_EXPLORED = """, explored AS (SELECT row_number() OVER (ORDER BY d, v) AS explore_order, v, d FROM found
WHERE NOT EXISTS (SELECT 1 FROM found WHERE v = (SELECT b FROM ends)) OR (d, v) <= (SELECT (d, v) FROM found WHERE v = (SELECT b FROM ends)))"""


@query(_route_sql("SELECT * FROM rays").rstrip() + _EXPLORED + " SELECT explore_order, v, round(d, 6) AS dist FROM explored")
def explored_set(spark, sf_dir):
    nodes = water(spark, sf_dir)
    edges, end = saved(lattice.ray_edges(nodes)), _end(nodes)
    return route.explored(route.distances(edges, START, end, tile=route.tiles_of(edges)), end).select("explore_order", "v", F.round("dist", 6).alias("dist"))


@query(_route_sql("SELECT * FROM rays").rstrip() + _EXPLORED + f""", ups(explore_order, back, node_id) AS (SELECT explore_order, CAST(0 AS BIGINT), v FROM explored UNION ALL SELECT u.explore_order, back + 1, parent FROM ups u JOIN parents p ON p.v = u.node_id WHERE u.node_id <> {START})
SELECT explore_order, max(back) OVER (PARTITION BY explore_order) - back AS step, node_id FROM ups""")
def explored_paths(spark, sf_dir):
    """The path to each node that the search settles, in the order in which it does."""
    nodes = water(spark, sf_dir)
    edges, end = saved(lattice.ray_edges(nodes)), _end(nodes)
    dist = route.distances(edges, START, end, tile=route.tiles_of(edges))
    return route.explored_paths(dist, route.parents(dist, edges, START), START, end)


_POINTS = f"""steps AS ({_STEPS}), before AS (SELECT *, lag(node_id) OVER (ORDER BY step) AS src FROM steps),
points AS (SELECT step, b.node_id, n.lon, n.lat, coalesce(c.height, 0) AS htsgwsfc, coalesce(c.period, 0) AS perpwsfc, coalesce(c.direction, 0) AS dirpwsfc, coalesce(m.roll, 0) AS roll, coalesce(m.heave, 0) AS heave, coalesce(m.pitch, 0) AS pitch, 0e0 AS rel_heading
FROM before b JOIN water n ON n.node_id = b.node_id LEFT JOIN cells c ON c.row_i = n.row_j % 25 AND c.col_j = n.col_i % 49 LEFT JOIN moved m ON m.src = b.src AND m.dst = b.node_id)
"""
_POINTS_SQL = _route_sql("SELECT * FROM rays").rstrip() + ", " + _POINTS


def _profile(spark, sf_dir):
    edges, nodes = saved(_moved(spark, sf_dir)), water(spark, sf_dir)
    return route.enriched(_route(edges, START, _end(nodes)), in_cells(nodes), cells(spark, sf_dir), edges)


@query(_POINTS_SQL + "SELECT * FROM points")
def route_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(_POINTS_SQL + """SELECT step, CASE WHEN series IN ('roll', 'heave', 'pitch') THEN 'motion' ELSE 'environment' END AS family, series, value
FROM (UNPIVOT (SELECT step, htsgwsfc, perpwsfc, dirpwsfc, roll, heave, pitch FROM points) ON htsgwsfc, perpwsfc, dirpwsfc, roll, heave, pitch INTO NAME series VALUE value)""")
def series_unpivot(spark, sf_dir):
    return charts.unpivoted(_profile(spark, sf_dir), ["step"]).select("step", "family", "series", "value")


@query(_POINTS_SQL + "SELECT step, node_id, round(100 * percent_rank() OVER (ORDER BY step), 6) AS percent FROM points")
def route_progress(spark, sf_dir):
    return charts.progress(_profile(spark, sf_dir).withColumn("route", F.lit("shortest")), ["route"], "step").select("step", "node_id", "percent")


@query(_POINTS_SQL + "SELECT coalesce(max(CASE WHEN step = 3 THEN htsgwsfc END), 0) AS htsgwsfc, coalesce(max(CASE WHEN step = 3 THEN roll END), 0) AS roll FROM points")
def cursor_values(spark, sf_dir):
    return charts.at_cursor(_profile(spark, sf_dir), 3, ["htsgwsfc", "roll"])


@query(_route_sql("SELECT * FROM rays") + f"SELECT round(d, 6) AS km, round(d / (10 * 1852e-3), 6) AS duration_hr, round(d / 10, 6) AS raw_ratio FROM found WHERE v = (SELECT b FROM ends)")
def route_duration(spark, sf_dir):
    nodes = water(spark, sf_dir)
    edges, end = saved(lattice.ray_edges(nodes)), _end(nodes)
    dist = route.distances(edges, START, end, tile=route.tiles_of(edges)).filter(F.col("v") == end)
    hours, bare = route.duration(F.col("dist"), 10.0)
    return dist.select(F.round("dist", 6).alias("km"), F.round(hours, 6).alias("duration_hr"), F.round(bare, 6).alias("raw_ratio"))


@query(_route_sql("SELECT * FROM rays") + f"""SELECT e.step, e.node_id, bearing FROM (
SELECT s.step, s.node_id, fmod(fmod(degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360, 360) - 90 + 360, 360) AS raw,
round(raw, 6) AS bearing
FROM ({_STEPS}) s JOIN water a ON a.node_id = s.node_id LEFT JOIN ({_STEPS}) t ON t.step = s.step + 1 LEFT JOIN water b ON b.node_id = t.node_id) e""")
def ship_icon_bearing(spark, sf_dir):
    """The way ahead from each step, turned by a quarter for the icon; null at the end."""
    from pyspark.sql import Window

    from tidelane.functions.geo import raw_bearing_deg

    points = _profile(spark, sf_dir)
    ahead = Window.orderBy("step")
    ends = [F.col("lon"), F.col("lat"), F.lead("lon").over(ahead), F.lead("lat").over(ahead)]
    return points.select("step", "node_id", F.round(F.pmod(raw_bearing_deg(*ends) - 90, F.lit(360.0)), 6).alias("bearing"))


@query(_POINTS_SQL + """, marks AS (SELECT i, n FROM (SELECT count(*) AS n FROM points), range(21) r(i)), kept AS (SELECT * FROM marks WHERE i = 0 OR i = 20 OR (n >= 2 AND i * (n // 20) < n - 1))
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS position, CASE i WHEN 0 THEN 'arrival' WHEN 20 THEN 'Departure' ELSE (i * 5) || '%' END AS label FROM kept""")
def percent_labels(spark, sf_dir):
    return charts.percent_labels(_profile(spark, sf_dir))
