"""Geographic inputs derived from the driver's tables: the same rules as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators.lattice import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat: a place for each part; several may share one."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (92 + (k * 37 % 490) / 10.0).alias("lon"), (-15 + (k * 53 % 250) / 10.0).alias("lat"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (92 + (k * 91 % 490) / 10.0).alias("lon"), (-15 + (k * 29 % 250) / 10.0).alias("lat"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_i, col_j, lon, lat, height, direction, period of each wave cell."""
    q, n = F.sum(F.col("l_quantity").cast("long")), F.count("*")
    place = [(F.col("l_suppkey") % 25).cast("int").alias("row_i"), (F.col("l_partkey") % 49).cast("int").alias("col_j")]
    sums = table(spark, sf_dir, "lineitem").groupBy(*place).agg(q.alias("q"), n.alias("n"))
    return sums.select("row_i", "col_j", (F.col("col_j") + 92.0).alias("lon"), (F.col("row_i") - 15.0).alias("lat"), (F.col("q") % 97 / 20.0).alias("height"), (F.col("q") * 37 % 360 / 1.0).alias("direction"), (2 + (F.col("q") + F.col("n") * 7) % 11 / 1.0).alias("period"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells with gaps: height is null in a fixed seventh of them."""
    return cells(spark, sf_dir).withColumn("height", F.when((F.col("row_i") * 3 + F.col("col_j")) % 7 != 0, F.col("height")))


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_i, col_j, lon, lat, height, period: a cell for each part that was sold, 50 columns wide and as long as the table; a quarter or so have no height."""
    k, q = F.col("l_partkey"), F.sum(F.col("l_quantity").cast("long"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.floor(k / 50).cast("int").alias("row_i"), (k % 50).cast("int").alias("col_j")).agg(q.alias("q"))
    place = [(F.col("col_j") / 64.0 + 92.0).alias("lon"), (F.col("row_i") / 64.0 - 15.0).alias("lat")]
    return sums.select("row_i", "col_j", *place, F.when(F.col("q") % 4 != 0, F.col("q") % 97 / 20.0).alias("height"), (2 + F.col("q") % 11 / 1.0).alias("period"))


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice's nodes: a cell for each part, 50 columns wide and as long as the table, without those on land.

    A basin in the west runs along all rows, basins in the east end every hundred rows, and between them lie cells alone.
    """
    k = F.col("p_partkey")
    r, c = F.floor(k / 50).cast("int"), (k % 50).cast("int")
    at = table(spark, sf_dir, "part").select(r.alias("row_j"), c.alias("col_i"), (c / 64.0 + 92.0).alias("lon"), (r / 64.0 - 15.0).alias("lat"))
    open_ = (F.col("row_j") * 7 + F.col("col_i") * 11) % 5 != 0
    basins = (F.col("col_i") <= 16) | ((F.col("col_i") >= 37) & (F.col("row_j") % 100 < 88))
    return numbered(at.filter(basins & open_ | ((F.col("col_i") == 26) & (F.col("row_j") % 30 == 10))))


def in_cells(nodes: DataFrame) -> DataFrame:
    """The nodes with the row and column of the wave cell that covers them: the cells repeat over the lattice."""
    return nodes.withColumn("row_j", F.col("row_j") % 25).withColumn("col_i", F.col("col_i") % 49)


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """polygon_id, ring, hole: a square of water around each supplier, every other one with a square island."""
    def square(half: float) -> Column:
        corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
        return F.array(*[F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in corners])

    own = suppliers(spark, sf_dir)
    outer = own.select(F.col("id").alias("polygon_id"), square(0.453125).alias("ring"), F.lit(False).alias("hole"))
    return outer.unionByName(own.filter("id % 2 = 0").select(F.col("id").alias("polygon_id"), square(0.140625).alias("ring"), F.lit(True).alias("hole")))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot (6-hourly), variable, event_id, ts: which variable's file an event stands for."""
    ts = F.col("ts")
    snapshot = F.to_timestamp_ntz(F.concat(F.date_format(ts, "yyyy-MM-dd "), F.lpad((F.floor(F.hour(ts) / 6) * 6).cast("string"), 2, "0"), F.lit(":00:00")))
    variable = F.element_at(F.array(*map(F.lit, ("htsgwsfc", "dirpwsfc", "perpwsfc"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(snapshot.alias("snapshot"), variable.alias("variable"), "event_id", "ts")


PARTS = "parts AS (SELECT p_partkey AS id, 92 + (p_partkey * 37 % 490) / 1e1 AS lon, -15 + (p_partkey * 53 % 250) / 1e1 AS lat FROM part)"
SUPPLIERS = "suppliers AS (SELECT s_suppkey AS id, 92 + (s_suppkey * 91 % 490) / 1e1 AS lon, -15 + (s_suppkey * 29 % 250) / 1e1 AS lat FROM supplier)"
CELLS = """sums AS (SELECT CAST(l_suppkey % 25 AS INTEGER) AS row_i, CAST(l_partkey % 49 AS INTEGER) AS col_j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
cells AS (SELECT row_i, col_j, col_j + 92e0 AS lon, row_i - 15e0 AS lat, (q % 97) / 2e1 AS height, (q * 37 % 360) / 1e0 AS direction, 2 + ((q + n * 7) % 11) / 1e0 AS period FROM sums)"""
MESH = """mesh_sums AS (SELECT CAST(l_partkey // 50 AS INTEGER) AS row_i, CAST(l_partkey % 50 AS INTEGER) AS col_j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
mesh AS (SELECT row_i, col_j, col_j / 64e0 + 92e0 AS lon, row_i / 64e0 - 15e0 AS lat, CASE WHEN q % 4 <> 0 THEN (q % 97) / 2e1 END AS height, 2 + (q % 11) / 1e0 AS period FROM mesh_sums)"""
GAPPY = CELLS + ",\ngappy AS (SELECT * REPLACE (CASE WHEN (row_i * 3 + col_j) % 7 <> 0 THEN height END AS height) FROM cells)"
WATER = """lattice AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS r, CAST(p_partkey % 50 AS INTEGER) AS c FROM part),
water AS (SELECT CAST(c AS BIGINT) * 1000000 + r AS node_id, r AS row_j, c AS col_i, c / 64e0 + 92e0 AS lon, r / 64e0 - 15e0 AS lat FROM lattice
    WHERE ((c <= 16 OR (c >= 37 AND r % 100 < 88)) AND (r * 7 + c * 11) % 5 <> 0) OR (c = 26 AND r % 30 = 10))"""
#: A point (x, y) is in a supplier's ring and not on its island.
IN_RING = """(abs_x <= 453125e-6 AND abs_y <= 453125e-6 AND NOT (s.id % 2 = 0 AND abs_x < 140625e-6 AND abs_y < 140625e-6))"""
SLOTS = "slots AS (SELECT date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 AS INTEGER)) AS snapshot, ['htsgwsfc', 'dirpwsfc', 'perpwsfc'][event_id % 3 + 1] AS variable, event_id, ts FROM events)"


def km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))), 6)"


def bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    d = f"radians({lon2} - {lon1})"
    raw = f"degrees(atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})))"
    return f"fmod(round(fmod({raw} + 360, 360), 6), 360)"


#: Ray edges of the lattice.
RAYS = f"""hits AS (SELECT a.node_id AS src, b.node_id AS dst, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2,
    row_number() OVER (PARTITION BY a.node_id, dj, di ORDER BY s) AS nth
    FROM water a, (SELECT dj, di, s FROM range(-1, 2) x(dj), range(-1, 2) y(di), range(1, 10) z(s) WHERE dj <> 0 OR di <> 0) w, water b
    WHERE b.row_j = a.row_j + dj * s AND b.col_i = a.col_i + di * s),
rays AS (SELECT src, dst, {km('lon1', 'lat1', 'lon2', 'lat2')} AS weight, {bearing('lon1', 'lat1', 'lon2', 'lat2')} AS bearing FROM hits WHERE nth = 1)"""
ALONE = """alone AS (SELECT * FROM water WHERE node_id NOT IN (SELECT src FROM rays UNION SELECT dst FROM rays))"""
LINKED = f"""pairs AS (SELECT a.node_id AS src, b.node_id AS dst, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2,
    row_number() OVER (PARTITION BY a.node_id ORDER BY (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat), b.node_id) AS nth
    FROM alone a, water b WHERE b.node_id NOT IN (SELECT node_id FROM alone)),
linked AS (SELECT src, dst, {km('lon1', 'lat1', 'lon2', 'lat2')} AS weight, {bearing('lon1', 'lat1', 'lon2', 'lat2')} AS bearing FROM pairs WHERE nth = 1)"""
#: Rays with motions and blocks by the default scorer; edge_id is made of source and target.
MOVED = """featured AS (SELECT r.src, r.dst, r.weight, r.bearing, c.height, c.period, fmod(fmod(r.bearing - c.direction + 90, 360) + 360, 360) AS heading
    FROM rays r JOIN water n ON n.node_id = r.src LEFT JOIN cells c ON c.row_i = n.row_j % 25 AND c.col_j = n.col_i % 49),
motions AS (SELECT src, dst, weight, bearing,
    round(coalesce(8e-1 * height + 22e-1 * abs(sin(radians(heading))) + 1e-1 * period, 0), 6) AS roll,
    round(coalesce(12e-2 * height + 1e-2 * period + 1e-2 * 1, 0), 6) AS heave,
    round(coalesce(4e-1 * height + 11e-1 * abs(cos(radians(heading))) + 1e-2 * 8, 0), 6) AS pitch FROM featured),
moved AS (SELECT src * 100000000 + dst AS edge_id, *, roll >= 6 OR heave >= 7e-1 OR pitch >= 3 AS blocked FROM motions)"""
