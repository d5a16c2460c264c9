"""Gridded variables as long or wide rows: row_i counts latitudes, col_j longitudes, null is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.geo import mercator_x, mercator_y, utm, utm_inverse
from tidelane.operators.griddata import griddata
from tidelane.operators.materialise import saved
from tidelane.operators.nearest import nearest

EXTENT = {"min_lat": -15.0, "max_lat": 10.0, "min_lon": 92.0, "max_lon": 141.0}
LIMIT = 1e10


def within(lon: Column, lat: Column, *, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Inclusive box; the ends of each side may come in either order."""
    return lat.between(min(min_lat, max_lat), max(min_lat, max_lat)) & lon.between(min(min_lon, max_lon), max(min_lon, max_lon))


def cleaned(value: Column, fill: float | None = None, zero_is_missing: bool = True) -> Column:
    """The value, or null for NaN, the fill value, values beyond the limit and, by default, zero."""
    bad = F.isnan(value) | (F.abs(value) > LIMIT)
    if zero_is_missing:
        bad |= value == 0
    if fill is not None:
        bad |= value == fill
    return F.when(~bad, value)


def with_fallback(now: DataFrame, before: DataFrame, value: str = "value") -> DataFrame:
    """now, or before if now has no value at all; an error if that has none either."""
    def packed(df: DataFrame, own: bool) -> DataFrame:
        return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.lit(own).alias("own"))

    counts = now.agg(F.count(value).alias("now")).join(before.agg(F.count(value).alias("before")))
    use = counts.select(F.when((F.col("now") == 0) & (F.col("before") == 0), F.raise_error(F.lit("no valid values")).cast("boolean")).otherwise(F.col("now") > 0).alias("use"))
    both = packed(now, True).unionByName(packed(before.select(*now.columns), False))
    return both.join(F.broadcast(use), F.col("own") == F.col("use")).select("row.*")


def aligned(long: DataFrame, variables: list[str]) -> DataFrame:
    """One row per cell with a column per variable."""
    return long.groupBy("row_i", "col_j").pivot("variable", variables).agg(F.first("value", ignorenulls=True))


def column_profile(wide: DataFrame, measures: list[str]) -> DataFrame:
    """Means over the latitudes of each longitude column."""
    return wide.groupBy("col_j").agg(*[F.round(F.avg(m), 6).alias(m) for m in measures])


def wave_at(points: DataFrame, cells: DataFrame, measures: list[str], mode: str = "cell") -> DataFrame:
    """Measures at each point: of the nearest cell, or (mode column_profile) of the nearest longitude's mean.

    points: probe_id, x (lon), y (lat); cells: row_i, col_j, lon, lat and the measures.
    """
    if mode == "column_profile":
        profile = column_profile(cells, measures)
        homes = cells.groupBy("col_j").agg(F.min("lon").alias("tx"))
        near = nearest(points.withColumn("y", F.lit(0.0)), homes.select(F.col("col_j").cast("long").alias("target_id"), "tx", F.lit(0.0).alias("ty")))
        return near.select("probe_id", F.col("target_id").cast("int").alias("col_j")).join(profile, "col_j")
    numbered = cells.withColumn("target_id", F.col("row_i").cast("long") * 100_000 + F.col("col_j"))
    near = nearest(points, numbered.select("target_id", F.col("lon").alias("tx"), F.col("lat").alias("ty")))
    return near.select("probe_id", "target_id").join(numbered.select("target_id", "col_j", *measures), "target_id").drop("target_id")


def idw_filled(cells: DataFrame, value: str, k: int = 8, power: int = 2, x: str = "col_j", y: str = "row_i") -> DataFrame:
    """row_i, col_j, value, filled: missing cells get the inverse-distance mean of their k nearest valid ones."""
    numbered = cells.select("row_i", "col_j", F.col(value).alias("value"), F.col(x).alias("px"), F.col(y).alias("py"), (F.col("row_i").cast("long") * 100_000 + F.col("col_j")).alias("id"))
    value, x, y = "value", "px", "py"
    gaps = numbered.filter(F.col(value).isNull()).select(F.col("id").alias("probe_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    known = numbered.filter(F.col(value).isNotNull())
    near = nearest(gaps, known.select(F.col("id").alias("target_id"), F.col(x).cast("double").alias("tx"), F.col(y).cast("double").alias("ty")), k)
    weight = F.when(F.col("d2") > 0, 1 / F.pow(F.sqrt(F.nullif("d2", F.lit(0.0))), F.lit(power)))
    exact = F.max(F.when(F.col("d2") == 0, F.col(value)))
    mean = near.join(known.select(F.col("id").alias("target_id"), value), "target_id").groupBy("probe_id").agg(F.coalesce(exact, F.sum(F.col(value) * weight) / F.sum(weight)).alias("mean"))
    joined = numbered.join(mean.withColumnRenamed("probe_id", "id"), "id", "left")
    return joined.select("row_i", "col_j", F.round(F.coalesce(value, "mean"), 6).alias("value"), (F.col(value).isNull() & F.col("mean").isNotNull()).alias("filled"))


def processed(cells: DataFrame, value: str, k: int = 8) -> DataFrame:
    """row_i, col_j, lon, lat, value, filled: the values cleaned, projected, their gaps filled from the k nearest by metres, and projected back.

    Places are taken to the millimetre, so that equal distances are equal.
    """
    east, north = utm(F.col("lon"), F.col("lat"))
    # Written, as the projection is long and used twice.
    flat = saved(cells.select("row_i", "col_j", cleaned(F.col(value)).alias(value), F.round(east, 3).alias("east"), F.round(north, 3).alias("north")))
    filled = idw_filled(flat, value, k, x="east", y="north")
    lon, lat = utm_inverse(F.col("east"), F.col("north"))
    return filled.join(flat.select("row_i", "col_j", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat")), ["row_i", "col_j"]).select("row_i", "col_j", "lon", "lat", "value", "filled")


def linear_filled(cells: DataFrame, value: str) -> DataFrame:
    """row_i, col_j, value: missing cells get the mean of what lies between their neighbours along the row and the column; else the nearest value."""
    def between(line: str, at: str) -> Column:
        order = Window.partitionBy(line).orderBy(at)
        known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
        a = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        b = F.first(known, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
        return a["v"] + (b["v"] - a["v"]) * (F.col(at) - a["at"]) / (b["at"] - a["at"])

    crossed = cells.select("row_i", "col_j", F.col(value).alias("own"), between("row_i", "col_j").alias("along"), between("col_j", "row_i").alias("across"))
    mean = F.when(F.col("along").isNotNull() & F.col("across").isNotNull(), (F.col("along") + F.col("across")) / 2).otherwise(F.coalesce("along", "across"))
    linear = crossed.select("row_i", "col_j", F.coalesce("own", mean).alias("value"))
    nearest_ = idw_filled(cells, value, k=1).select("row_i", "col_j", F.col("value").alias("near"))
    return linear.join(nearest_, ["row_i", "col_j"]).select("row_i", "col_j", F.round(F.coalesce("value", "near"), 6).alias("value"))


def griddata_filled(cells: DataFrame, value: str, method: str = "cubic", x: str = "col_j", y: str = "row_i", **options) -> DataFrame:
    """row_i, col_j, value, how: missing cells get what griddata() finds between or near the valid ones, which stay 'known'.

    The cascade of methods is one step: within the valid cells' hull the cubic or the linear value is always there, outside it is the nearest.
    """
    cells = saved(cells.select(*dict.fromkeys(("row_i", "col_j", x, y, value))))  # read by known cells, gaps and those that stay missing
    at = {"x": F.col(x), "y": F.col(y)}
    gaps = cells.filter(F.col(value).isNull()).select((F.col("row_i").cast("long") * 100_000 + F.col("col_j")).alias("target_id"), *(c.alias(n) for n, c in at.items()))
    known = cells.filter(F.col(value).isNotNull())
    found = griddata(known.select(*(c.alias(n) for n, c in at.items()), F.col(value).alias("value")), gaps, method, **options)
    filled = found.select(F.floor(F.col("target_id") / 100_000).cast("int").alias("row_i"), (F.col("target_id") % 100_000).cast("int").alias("col_j"), F.round("value", 6).alias("value"), "how")
    lost = cells.filter(F.col(value).isNull()).join(filled.select("row_i", "col_j"), ["row_i", "col_j"], "left_anti").select("row_i", "col_j", F.lit(None).cast("double").alias("value"), F.lit("missing").alias("how"))
    return known.select("row_i", "col_j", F.round(F.col(value).cast("double"), 6).alias("value"), F.lit("known").alias("how")).unionByName(filled).unionByName(lost)


def corners(cells: DataFrame, value: str) -> DataFrame:
    """Each cell that has its three neighbours to the south and east, with all four values."""
    def moved(di, dj, name):
        return cells.select((F.col("row_i") - di).alias("row_i"), (F.col("col_j") - dj).alias("col_j"), F.col(value).alias(name))

    out = cells.select("row_i", "col_j", F.col(value).alias("v00"))
    for di, dj, name in ((1, 0, "v10"), (1, 1, "v11"), (0, 1, "v01")):
        out = out.join(moved(di, dj, name), ["row_i", "col_j"])
    return out


def visible(cells: DataFrame, box: tuple[float, float, float, float], margin: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with lon, lat inside the box (min lon, min lat, max lon, max lat) in Web Mercator, grown by margin of its size on every side.

    Their places there are the columns x and y; a row's own column of such a name is an error.
    """
    if clash := {c.lower() for c in cells.columns} & {x.lower(), y.lower()}:
        raise ValueError(f"the rows have columns {sorted(clash)}; name others")
    one = cells.sparkSession.range(1)
    ends = one.select(*[f(F.lit(v)).alias(n) for n, f, v in zip(("x0", "y0", "x1", "y1"), (mercator_x, mercator_y) * 2, box)]).first()
    x0, y0, x1, y1 = ends
    dx, dy = (x1 - x0) * margin, (y1 - y0) * margin
    return cells.withColumn(x, mercator_x(F.col("lon"))).withColumn(y, mercator_y(F.col("lat"))).filter(F.col(x).between(x0 - dx, x1 + dx) & F.col(y).between(y0 - dy, y1 + dy))


def snapshot_problems(values: DataFrame) -> DataFrame:
    """variable, problem of a snapshot's long rows: coordinates that differ between variables, counts that differ, values that are missing as a whole."""
    sizes = values.groupBy("variable").agg(F.count("*").alias("n"), F.count("value").alias("valid"))
    expected = sizes.agg(F.max("n").alias("most"))
    uneven = sizes.join(F.broadcast(expected)).filter("n < most").select("variable", F.lit("cells").alias("problem"))
    empty = sizes.filter("valid = 0").select("variable", F.lit("values").alias("problem"))
    place = values.groupBy("row_i", "col_j").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    apart = place.filter((F.col("b") - F.col("a") > 1e-6 + 1e-5 * F.abs("b")) | (F.col("d") - F.col("c") > 1e-6 + 1e-5 * F.abs("d")))
    moved = apart.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("variable"), F.lit("coordinates").alias("problem"))
    return uneven.unionByName(empty).unionByName(moved)
