"""Queries over snapshots, requests, places, caches and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelane.functions import display
from tidelane.operators import charts, fitted
from tidelane.operators.asof import newest_at
from tidelane.operators.materialise import work_dir
from tidelane.operators.nearest import nearest_poi, resolved_clicks
from tidelane.plans.derived import PARTS, SLOTS, SUPPLIERS, parts, slots, suppliers, table
from tidelane.plans.registry import query
from tidelane.sources import layout, poi, requests, stores
from tidelane.streaming import progress, snapshots, sweep

_MANIFEST = SLOTS + ", manifest AS (SELECT DISTINCT CAST(snapshot AS DATE) AS date, lpad(CAST(hour(snapshot) AS VARCHAR), 2, '0') || 'z' AS slot, CASE WHEN event_id % 40 < 2 OR snapshot < TIMESTAMP '2024-01-05' THEN variable ELSE 'other' END AS variable FROM slots)"
_COMPLETE = _MANIFEST + ", complete AS (SELECT date, slot FROM manifest WHERE variable <> 'other' GROUP BY ALL HAVING count(DISTINCT variable) = 3)"


def _manifest(spark, sf_dir):
    """date, slot, variable of the files that the events stand for; most of the later ones are of another variable, so that snapshots are incomplete."""
    own = (F.col("event_id") % 40 < 2) | (F.col("snapshot") < F.lit("2024-01-05").cast("timestamp_ntz"))
    rows = slots(spark, sf_dir).withColumn("variable", F.when(own, F.col("variable")).otherwise("other"))
    slot = F.concat(F.lpad(F.hour("snapshot").cast("string"), 2, "0"), F.lit("z"))
    return rows.select(F.col("snapshot").cast("date").alias("date"), slot.alias("slot"), "variable").distinct()


def _spelled(rows):
    return rows.withColumn("date", F.col("date").cast("string"))


@query(f"WITH {_COMPLETE} SELECT CAST(date AS VARCHAR) AS date, slot FROM complete")
def dataset_completeness(spark, sf_dir):
    return _spelled(stores.complete(_manifest(spark, sf_dir)))


@query(f"WITH {_COMPLETE} SELECT CAST(date AS VARCHAR) AS date, slot FROM complete WHERE date BETWEEN DATE '2024-01-07' AND DATE '2024-01-10' ORDER BY complete.date DESC, slot DESC LIMIT 1")
def latest_dataset(spark, sf_dir):
    """The limit is the feature: the newest snapshot."""
    return _spelled(stores.latest(_manifest(spark, sf_dir), F.to_date(F.lit("2024-01-10"))))


@query(f"WITH {_COMPLETE} SELECT CAST(date AS VARCHAR) AS date, slot FROM complete WHERE date = DATE '2024-01-03' AND slot = '06z'")
def specific_dataset(spark, sf_dir):
    return _spelled(stores.specific(_manifest(spark, sf_dir), "20240103", "06z"))


@query(f"""WITH {_MANIFEST}, wanted AS (SELECT CAST(DATE '2024-01-12' - CAST(k AS INTEGER) AS DATE) AS date, slot, variable FROM range(7) r(k), (SELECT unnest(['00z', '06z', '12z', '18z']) AS slot), (SELECT unnest(['htsgwsfc', 'dirpwsfc', 'perpwsfc']) AS variable))
SELECT CAST(date AS VARCHAR) AS date, slot, variable FROM wanted ANTI JOIN manifest USING (date, slot, variable)""")
def missing_snapshots(spark, sf_dir):
    return _spelled(snapshots.missing_snapshots(spark, _manifest(spark, sf_dir), "2024-01-12"))


@query("""SELECT o_orderkey AS request_id, list_filter([CASE WHEN o_custkey % 7 = 0 THEN 'start' END, CASE WHEN o_custkey % 11 = 0 THEN 'end' END, CASE WHEN o_orderkey % 5 = 0 THEN 'ship_speed' END, CASE WHEN o_orderkey % 4 > 1 THEN 'condition' END], lambda x: x IS NOT NULL) AS problems, o_orderkey % 3 = 0 AS use_model FROM orders""".replace("list_filter(", "array_to_string(list_filter(").replace("IS NOT NULL)", "IS NOT NULL), ',')"))
def request_validation(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = [F.struct(F.when(c % m != 0, F.lit(100.0)).alias("longitude"), F.lit(-5.0).alias("latitude")).alias(n) for m, n in ((7, "start"), (11, "end"))]
    rows = table(spark, sf_dir, "orders").select(k.alias("request_id"), *place, (k % 5).cast("double").alias("ship_speed"), (k % 4).cast("int").alias("condition"), F.when(k % 3 == 0, True).alias("use_model"))
    return requests.request_problems(rows).withColumn("problems", F.concat_ws(",", "problems"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS condition FROM lineitem")
def load_condition(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "R", "ballast").otherwise("full_load")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", display.load_condition(name).alias("condition"))


@query("SELECT c.c_custkey FROM customer c ANTI JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_custkey < 3) t ON t.s = c.c_mktsegment")
def location_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("type"))
    return requests.addable(rows, rows.filter("c_custkey < 3")).select("c_custkey")


def _sites(spark, sf_dir):
    """poi_id, category, name, lon, lat: the suppliers as places, by their nations' regions."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    region = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("category"))
    named = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey").join(region, "s_nationkey")
    return named.join(suppliers(spark, sf_dir), "id").select(F.col("id").alias("poi_id"), "category", "name", "lon", "lat")


@query(f"""WITH {PARTS}, {SUPPLIERS}, near AS (
SELECT p.id AS probe_id, s_name AS name, (p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat) AS d2, row_number() OVER (PARTITION BY p.id ORDER BY (p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat), s.id) AS k FROM parts p, suppliers s JOIN supplier ON s_suppkey = s.id)
SELECT probe_id, CASE WHEN d2 <= 2.25 THEN name ELSE 'Unknown location' END AS place FROM near WHERE k = 1""")
def nearest_poi_or_default(spark, sf_dir):
    clicks = parts(spark, sf_dir).select(F.col("id").alias("probe_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return nearest_poi(clicks, _sites(spark, sf_dir), 1.5, "Unknown location")


@query(f"WITH {SUPPLIERS} SELECT r_name AS category, s_name AS name, round(s.lon, 6) AS lon, round(s.lat, 6) AS lat FROM suppliers s JOIN supplier ON s_suppkey = s.id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def poi_dimension(spark, sf_dir):
    """The places listed by category, and the lists as rows again."""
    return poi.flat(poi.by_category(_sites(spark, sf_dir))).select("category", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d') AS date_key, strftime(ts, '%B ') || day(ts) || CASE WHEN day(ts) BETWEEN 11 AND 13 THEN 'th' WHEN day(ts) % 10 = 1 THEN 'st' WHEN day(ts) % 10 = 2 THEN 'nd' WHEN day(ts) % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(ts, ', %Y') AS spelled, CAST(CAST(ts AS DATE) - 3 AS VARCHAR) AS before FROM events""")
def date_formats(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", display.date_key(ts).alias("date_key"), display.ordinal_date(ts).alias("spelled"), F.date_sub(ts.cast("date"), 3).cast("string").alias("before"))


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS key FROM events""")
def request_digest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", stores.cache_key(F.col("event_type"), F.col("user_id")).alias("key"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_id % 3 <> 0) WHERE k = 1")
def cache_first_match(spark, sf_dir):
    """The item a look-up finds under each key: the first stored that is fixed, as two thirds of the events are."""
    cache = table(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("key"), (F.col("event_id") % 3 != 0).alias("fixed"), F.struct("ts", "event_id").alias("stored_at"), "event_id")
    return stores.first_stored(cache).select("key.user_id", "key.event_type", "event_id")


@query("""WITH stored AS (SELECT o_custkey % 50 AS place, o_orderkey % 4 AS condition, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 4 ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 1)
SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN stored ON place = c_custkey % 50 AND condition = c_nationkey % 4 AND k = 1""")
def route_cache_lookup(spark, sf_dir):
    """Results written to the store, and the one that each request finds, or -1: the first fixed one with its start and condition, of searches with the model."""
    k = F.col("o_orderkey")
    key = stores.cache_key((F.col("o_custkey") % 50).alias("start"), (k % 4).alias("condition"))
    results = table(spark, sf_dir, "orders").select(F.lit("20240101-06z").alias("wave_data_id"), (k % 2 == 1).alias("use_model"), key.alias("key"), (k % 3 != 0).alias("fixed"), F.struct("o_orderdate", "o_orderkey").alias("stored_at"), "o_orderkey")
    path = f"{work_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    stores.write_results(results, path)
    stored = stores.first_stored(stores.read_results(spark, path, "20240101-06z", True)).select("key", "o_orderkey")
    asked = table(spark, sf_dir, "customer").select("c_custkey", stores.cache_key((F.col("c_custkey") % 50).alias("start"), (F.col("c_nationkey").cast("long") % 4).alias("condition")).alias("key"))
    return asked.join(stored, "key", "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1).cast("long")).alias("o_orderkey"))


@query(f"WITH {SUPPLIERS} SELECT a.id, round(a.lon, 6) AS lon, round(a.lat, 6) AS lat, b.id AS neighbour FROM suppliers a JOIN suppliers b ON b.id = a.id + 1")
def graph_round_trip(spark, sf_dir):
    """Nodes and edges written to the store and read again."""
    path = f"{work_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    own = suppliers(spark, sf_dir)
    following = own.select(F.col("id").alias("dst"))
    stores.write_graph(own, own.select(F.col("id").alias("src")).join(following, F.col("dst") == F.col("src") + 1), path)
    nodes, edges = stores.read_graph(spark, path)
    return nodes.join(edges, nodes["id"] == edges["src"]).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("dst").alias("neighbour"))


@query("SELECT o_orderkey, o_custkey % 4 > 1 AND o_custkey % 5 <> 0 AS valid FROM orders")
def valid_path_points(spark, sf_dir):
    """Points of one, two or three numbers, some null."""
    c = F.col("o_custkey")
    x = c.cast("double")
    point = F.when(c % 4 > 1, F.array(F.when(c % 5 != 0, x), x)).when(c % 4 == 1, F.array(x)).otherwise(F.array(x, x, x))
    return table(spark, sf_dir, "orders").select("o_orderkey", requests.valid_point(point).alias("valid"))


@query("SELECT user_id, count(*) AS n_series, min(n) = max(n) AS same_length, bool_or(filled) AS any_values FROM (SELECT user_id, event_type, count(*) AS n, bool_or(event_id % 7 = 0) AS filled FROM events GROUP BY 1, 2) GROUP BY user_id")
def chart_series_lengths(spark, sf_dir):
    """Each user's events as series by kind, a seventh of them with a value."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_id") % 7 == 0, F.col("event_id")).alias("value"))
    return charts.same_length(rows, "user_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, printf('%.6f', CAST(l_quantity AS DOUBLE)) AS quantity, printf('%.2f', CAST(l_linenumber AS DOUBLE) / 4) AS share FROM lineitem")
def fixed_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", display.fixed(F.col("l_quantity").cast("double")).alias("quantity"), display.fixed(F.col("l_linenumber").cast("double") / 4, 2).alias("share"))


@query("SELECT event_type, max(event_id) AS event_id FROM events e WHERE ts = (SELECT max(ts) FROM events f WHERE f.event_type = e.event_type) GROUP BY event_type")
def stream_latest_snapshot(spark, sf_dir):
    return snapshots.run_once(snapshots.latest_per_variable(_stream(spark, sf_dir)), "latest")


def _stream(spark, sf_dir):
    """The events as a stream of the files there are."""
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")


@query("SELECT date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 AS INTEGER)) AS slot_start, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")
def stream_slot_windows(spark, sf_dir):
    return snapshots.run_once(snapshots.slot_windows(_stream(spark, sf_dir)), "slots")


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def stream_throttle(spark, sf_dir):
    return snapshots.run_once(snapshots.throttled(_stream(spark, sf_dir)), "throttle")


@query("""WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
sessions AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id, s) AS n FROM sessions)
SELECT user_id, ts, event_id, n FROM ranked WHERE k = 1""")
def stream_debounce(spark, sf_dir):
    return snapshots.run_once(snapshots.debounced(_stream(spark, sf_dir)), "debounce")


@query("""WITH m AS (SELECT user_id, ts, event_id, props, CASE WHEN event_id % 97 = 0 THEN 'final' WHEN event_id % 5 = 0 THEN 'partial_path' ELSE 'expansion' END AS kind FROM events),
f AS (SELECT *, min(CASE WHEN kind = 'final' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS fin FROM m)
SELECT user_id AS search_id, count(*) FILTER (kind = 'expansion' AND (fin IS NULL OR (ts, event_id) < fin)) AS expansions,
arg_max(props, (ts, event_id)) FILTER (kind = 'partial_path' AND (fin IS NULL OR (ts, event_id) < fin)) AS last_partial, bool_or(fin IS NOT NULL) AS closed FROM f GROUP BY user_id""")
def stream_search_progress(spark, sf_dir):
    """Search messages by user: each event is an expansion, a partial path or the end."""
    kind = F.when(F.col("event_id") % 97 == 0, "final").when(F.col("event_id") % 5 == 0, "partial_path").otherwise("expansion")
    messages = _stream(spark, sf_dir).select(F.col("user_id").alias("search_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("payload"))
    return snapshots.run_once(progress.search_progress(messages), "progress", "update", ("search_id",), progress.STORE)


_EACH_DAY = "SELECT CAST(a + CAST(k AS INTEGER) AS DATE) AS date FROM (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), range(10000) r(k) WHERE a + CAST(k AS INTEGER) <= b"


@query(f"""WITH {_MANIFEST}, wanted AS (SELECT date, slot, variable FROM ({_EACH_DAY}), (SELECT unnest(['00z', '06z', '12z', '18z']) AS slot), (SELECT unnest(['htsgwsfc', 'dirpwsfc', 'perpwsfc']) AS variable))
SELECT CAST(date AS VARCHAR) AS date, slot, variable, CASE WHEN slot = '06z' AND day(date) % 5 = 0 THEN 'failed' ELSE 'stored' END AS status, CASE WHEN NOT (slot = '06z' AND day(date) % 5 = 0) THEN day(date) * 100e0 + len(variable) END AS value
FROM wanted ANTI JOIN (SELECT * FROM manifest WHERE day(date) % 2 = 0) USING (date, slot, variable)""")
def sweep_log(spark, sf_dir):
    """A sweep over the events' days: what the manifest of the even ones lacks is fetched item by item, and some fetches fail."""
    days = table(spark, sf_dir, "events").agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()

    def fetch(day, slot, variable):
        if slot == "06z" and day.day % 5 == 0:
            raise TimeoutError("no answer")
        return day.day * 100 + len(variable)

    items = sweep.wanted(spark, str(days[0]), str(days[1]), ("00z", "06z", "12z", "18z"), stores.VARIABLES)
    rows = sweep.swept(items, _manifest(spark, sf_dir).filter(F.day("date") % 2 == 0), fetch, f"{work_dir(spark).rstrip('/')}/sweep-{uuid.uuid4().hex}")
    return _spelled(rows.select("date", "slot", "variable", "status", "value"))


@query("""WITH snapshots AS (SELECT ts, arg_max(event_id, event_id) AS snapshot_id, arg_max(value, event_id) AS wave FROM events WHERE event_id % 50 = 0 GROUP BY ts)
SELECT e.event_id, s.snapshot_id, s.wave FROM events e ASOF LEFT JOIN snapshots s ON e.ts >= s.ts""")
def event_wave(spark, sf_dir):
    """The wave of the newest snapshot at each event's time: every fiftieth event stands for a snapshot."""
    events = table(spark, sf_dir, "events")
    snapshots_ = events.filter("event_id % 50 = 0").select("ts", F.col("event_id").alias("snapshot_id"), F.col("value").alias("wave"))
    return newest_at(events.select("event_id", "ts"), snapshots_, "ts", "snapshot_id", ["snapshot_id", "wave"]).select("event_id", "snapshot_id", "wave")


_FIT = """sums AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_discount, l_discount) AS s22, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
targets AS (SELECT 'price' AS target, covar_pop(l_quantity, l_extendedprice) AS s1t, covar_pop(l_discount, l_extendedprice) AS s2t, avg(l_extendedprice) AS mt, covar_pop(l_extendedprice, l_extendedprice) AS stt FROM lineitem
    UNION ALL SELECT 'tax', covar_pop(l_quantity, l_tax), covar_pop(l_discount, l_tax), avg(l_tax), covar_pop(l_tax, l_tax) FROM lineitem),
solved AS (SELECT *, (s22 * s1t - s12 * s2t) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2t - s12 * s1t) / (s11 * s22 - s12 * s12) AS b2 FROM sums, targets)"""


def _fitted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"price": F.col("l_extendedprice"), "tax": F.col("l_tax")})
    return rows, fitted.fit(rows, ["l_quantity", "l_discount"], ["price", "tax"])


@query(f"""WITH {_FIT} SELECT target, 'l_quantity' AS feature, round(b1 * sqrt(s11) / sqrt(stt), 6) AS coefficient, round(m1, 6) AS mean, round(sqrt(s11), 6) AS scale, round(mt, 4) AS target_mean, round(sqrt(stt), 4) AS target_scale FROM solved
UNION ALL SELECT target, 'l_discount', round(b2 * sqrt(s22) / sqrt(stt), 6), round(m2, 6), round(sqrt(s22), 6), round(mt, 4), round(sqrt(stt), 4) FROM solved""")
def fitted_scorer(spark, sf_dir):
    """A scorer's parameters by least squares on standardised columns."""
    rounded = [F.round(c, 4 if c.startswith("target") else 6).alias(c) for c in ("coefficient", "mean", "scale", "target_mean", "target_scale")]
    return _fitted(spark, sf_dir)[1].select("target", "feature", *rounded)


@query(f"""WITH {_FIT} SELECT l_orderkey, l_linenumber, l_partkey, round(max(CASE WHEN target = 'price' THEN mt + b1 * (l_quantity - m1) + b2 * (l_discount - m2) END), 4) AS price, round(max(CASE WHEN target = 'tax' THEN mt + b1 * (l_quantity - m1) + b2 * (l_discount - m2) END), 6) AS tax
FROM (SELECT row_number() OVER () AS k, * FROM lineitem) l, solved GROUP BY k, l_orderkey, l_linenumber, l_partkey""")
def fitted_predictions(spark, sf_dir):
    """What the fitted scorer says of every row: scaled, predicted, unscaled."""
    rows, parameters = _fitted(spark, sf_dir)
    found = fitted.predictions(parameters)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(found["price"], 4).alias("price"), F.round(found["tax"], 6).alias("tax"))


@query(f"WITH {PARTS} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM parts WHERE lon BETWEEN 9505e-2 AND 1103e-1 AND lat BETWEEN -121e-1 AND -415e-2")
def places_in_box(spark, sf_dir):
    """The parts' places laid out along a curve, and a box read by runs of it."""
    path = f"{work_dir(spark).rstrip('/')}/laid-out-{uuid.uuid4().hex}"
    layout.write_laid_out(parts(spark, sf_dir), path)
    return layout.in_box(spark, path, (95.05, -12.1, 110.3, -4.15)).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""WITH {PARTS}, {SUPPLIERS}, near AS (
SELECT p.id AS probe_id, s_name AS name, (p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat) AS d2, row_number() OVER (PARTITION BY p.id ORDER BY (p.lon - s.lon) * (p.lon - s.lon) + (p.lat - s.lat) * (p.lat - s.lat), s.id) AS k FROM parts p, suppliers s JOIN supplier ON s_suppkey = s.id)
SELECT probe_id, CASE WHEN probe_id % 4 = 0 THEN p_name WHEN d2 <= 2.25 THEN name ELSE 'Unknown location' END AS place FROM near JOIN part ON p_partkey = probe_id WHERE k = 1""")
def click_resolution(spark, sf_dir):
    """Clicks at the parts' places: a quarter of them hit a feature."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("feature"))
    clicks = parts(spark, sf_dir).join(names, "id").select(F.col("id").alias("probe_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "feature")
    return resolved_clicks(clicks, _sites(spark, sf_dir), 1.5, "Unknown location")


_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN type = 'from' THEN 0 ELSE 1 END, o_orderkey) - 1 AS index FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'from' WHEN o_orderkey % 5 = 1 THEN 'to' ELSE 'via' END AS type FROM orders))"


def _locations(spark, sf_dir):
    """Each customer's orders as a list of locations."""
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 0, "from").when(k % 5 == 1, "to").otherwise("via")
    return requests.placed_locations(table(spark, sf_dir, "orders").select("o_custkey", k.alias("position"), kind.alias("type")), "o_custkey")


@query(f"WITH {_PLACED} SELECT o_custkey, type, o_orderkey AS position, CAST(CASE WHEN index > 1 THEN index - 1 ELSE index END AS INTEGER) AS index FROM placed WHERE index <> 1")
def location_lists(spark, sf_dir):
    """The lists in their order, without what was second."""
    return requests.removed(_locations(spark, sf_dir), 1).select("o_custkey", "type", "position", "index")


@query(f"WITH {_PLACED} SELECT o_custkey, type, arg_min(o_orderkey, index) AS position FROM placed GROUP BY o_custkey, type")
def first_locations(spark, sf_dir):
    return requests.first_of_type(_locations(spark, sf_dir), "o_custkey")


@query("SELECT o_orderkey, to_json(list_transform(list_filter([o_totalprice, CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END, 5e-1], lambda x: x IS NOT NULL), lambda x: CAST(floor(x) AS BIGINT))) AS points FROM orders")
def path_projection(spark, sf_dir):
    """Lists of numbers, some missing: what is there, as whole numbers, encoded and decoded and encoded again."""
    c = F.col("o_custkey").cast("double")
    there = F.filter(F.array(F.col("o_totalprice"), F.when(F.col("o_custkey") % 3 > 0, c), F.lit(0.5)), lambda x: x.isNotNull())
    encoded = F.to_json(F.transform(there, lambda x: F.floor(x).cast("long")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.from_json(encoded, "array<long>")).alias("points"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def decoded_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string")["k"].alias("k"))
