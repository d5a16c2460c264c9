"""Exact nearest neighbours by distance in the plane of the coordinates.

Probes at one place have one answer, and of the targets at one place the first k are enough, so places
are compared, each once. A few targets are broadcast after their number is checked. Otherwise targets
and probes meet in grid cells: a probe looks at its cell and the eight around it, and is settled once its k-th
distance is within a cell's width, as nothing outside can be nearer. The rest try again with
cells twice as wide. Where several targets are wanted, targets go to the nine cells that look at them, so that a
probe meets them all in its own; they lie there in blocks, of which a probe takes the first k each, and no pair
is shuffled. Ties go to the smaller target id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.materialise import saved

#: Targets up to which each probe is compared with all of them.
FEW_TARGETS = 2_000
#: Targets that a probe looks at in a row of its own.
BLOCK = 256
#: The cells around one, itself included.
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def nearest(probes: DataFrame, targets: DataFrame, k: int = 1, *, cell: float | None = None, few: int = FEW_TARGETS) -> DataFrame:
    """probe_id, target_id, d2 (squared distance), rank of the k nearest targets of each probe.

    probes: probe_id, x, y; targets: target_id, tx, ty. Rows with a null coordinate take no part.
    """
    probes, targets = probes.select("probe_id", "x", "y").dropna(), targets.select("target_id", "tx", "ty").dropna()
    if k == 1:
        homes = targets.groupBy("tx", "ty").agg(F.min("target_id").alias("target_id"))
    else:  # more than k targets at a place are never all among the nearest
        homes = targets.withColumn("nth", F.row_number().over(Window.partitionBy("tx", "ty").orderBy("target_id"))).filter(F.col("nth") <= k)
    homes = saved(homes.select("target_id", "tx", "ty"))
    found = saved(_nearest_to_places(saved(probes.select("x", "y").distinct()), homes, k, cell, few))
    return probes.join(found.hint("merge"), ["x", "y"]).select("probe_id", "target_id", "d2", "rank")


def nearest_with(places: DataFrame, targets: DataFrame, k: int, carried: list[str]) -> DataFrame:
    """x, y, target_id, d2, rank and the targets' columns `carried` of the k nearest targets of each place x, y. Places are distinct, and so are the targets'; no coordinate is null."""
    return saved(_nearest_to_places(places, targets, k, None, FEW_TARGETS, carried))


def spread(n: int, across: float, along: float, held: float) -> float:
    """The width of square cells that have about `held` of n places, were these spread evenly over a box, however narrow."""
    return max((across * along * held / max(1, n)) ** 0.5, max(across, along) * held / max(1, n), 1e-9)


def _square(tx: Column, ty: Column) -> Column:
    return (F.col("x") - tx) * (F.col("x") - tx) + (F.col("y") - ty) * (F.col("y") - ty)


def _pairs(held: str, carried: list[str]) -> Column:
    """An array of targets as (d2, target_id, what is carried)."""
    return F.transform(held, lambda t: F.struct(_square(t["tx"], t["ty"]).alias("d2"), *(t[c].alias(c) for c in ["target_id", *carried])))


def _first_k(left: DataFrame, targets: DataFrame, width: float, k: int, least: int, carried: list[str]) -> DataFrame:
    """x, y, target_id, d2, rank, what is carried, sure: the first k of the targets in the nine cells around each place x, y; it is settled if there are `least` and none is farther than a cell's width."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND]))
    here = left.select("x", "y", F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy"))
    cells = here.select("cx", "cy").distinct()
    seen = cells.withColumn("o", around).select((F.col("cx") + F.col("o.i")).alias("hx"), (F.col("cy") + F.col("o.j")).alias("hy")).distinct()
    homes = targets.withColumn("hx", F.floor(F.col("tx") / width)).withColumn("hy", F.floor(F.col("ty") / width)).join(seen.hint("merge"), ["hx", "hy"], "left_semi")
    shown = homes.withColumn("o", around).select("target_id", "tx", "ty", *carried, (F.col("hx") + F.col("o.i")).alias("cx"), (F.col("hy") + F.col("o.j")).alias("cy"))
    nth = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("target_id"))
    blocks = shown.withColumn("block", F.floor((nth - 1) / BLOCK)).groupBy("cx", "cy", "block").agg(F.collect_list(F.struct("tx", "ty", "target_id", *carried)).alias("held"))  # BLOCK at most
    met = blocks.join(here.hint("merge"), ["cx", "cy"]).select("cx", "cy", "x", "y", F.explode(F.slice(F.sort_array(_pairs("held", carried)), 1, k)).alias("m"))
    # A place has one cell, so that its rows lie together already.
    own = Window.partitionBy("cx", "cy", "x", "y")
    first = met.select("cx", "cy", "x", "y", "m.*").withColumn("rank", F.row_number().over(own.orderBy("d2", "target_id"))).filter(F.col("rank") <= k)
    sure = (F.count("*").over(own) >= least) & (F.max("d2").over(own) <= width * width)
    return first.select("x", "y", "target_id", "d2", "rank", *carried, sure.alias("sure"))


def _nearest_to_places(asked: DataFrame, targets: DataFrame, k: int, cell: float | None, few: int, carried: list[str] = []) -> DataFrame:
    """x, y, target_id, d2, rank and what is carried for the places x, y, each there once."""
    bounds = targets.agg(F.count("*"), F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    n = bounds[0]

    if n <= few:  # a place looks at all in its own row, so that no pairs are made
        all_ = targets.agg(F.collect_list(F.struct("tx", "ty", "target_id", *carried)).alias("all"))
        pairs = _pairs("all", carried)
        first = F.array_compact(F.array(F.array_min(pairs))) if k == 1 else F.slice(F.sort_array(pairs), 1, k)
        return asked.join(F.broadcast(all_)).select("x", "y", F.posexplode(first).alias("at", "m")).select("x", "y", "m.target_id", "m.d2", (F.col("at") + 1).alias("rank"), *(f"m.{c}" for c in carried))

    def best(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("d2", _square(F.col("tx"), F.col("ty")))
        return pairs.groupBy("x", "y").agg(F.min(F.struct("d2", "target_id", *carried)).alias("m")).select("x", "y", "m.target_id", "m.d2", F.lit(1).alias("rank"), *(f"m.{c}" for c in carried))

    def looked_at(left: DataFrame, width: float) -> DataFrame:
        if k > 1:
            return _first_k(left, targets, width, k, min(k, n), carried)
        cx, cy = F.floor(F.col("x") / width), F.floor(F.col("y") / width)
        looked = left.withColumn("o", around).select("x", "y", (cx + F.col("o.i")).alias("cx"), (cy + F.col("o.j")).alias("cy"))
        homes = targets.select("target_id", "tx", "ty", *carried, F.floor(F.col("tx") / width).alias("cx"), F.floor(F.col("ty") / width).alias("cy"))
        return best(looked.join(homes.hint("merge"), ["cx", "cy"])).withColumn("sure", F.col("d2") <= width * width)

    across, along = bounds[2] - bounds[1], bounds[4] - bounds[3]
    width = cell or spread(n, across, along, k if k > 1 else 2)
    reach = asked.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if reach[0] is None:
        return best(asked.join(targets.limit(0)))
    far = max(abs(bounds[2] - reach[0]), abs(reach[1] - bounds[1]), abs(bounds[4] - reach[2]), abs(reach[3] - bounds[3]), across, along, 1e-9)
    found, left = None, asked
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND]))
    while True:
        got = saved(looked_at(left, width))
        if width > far:  # every target was looked at
            got = got.drop("sure")
            return got if found is None else found.unionByName(got)
        settled = got.filter("sure").drop("sure")
        found = settled if found is None else found.unionByName(settled)
        left = saved(left.join(settled.filter("rank = 1").select("x", "y").hint("merge"), ["x", "y"], "left_anti"))
        if left.isEmpty():
            return found
        width *= 2


def nearest_poi(clicks: DataFrame, poi: DataFrame, max_degrees: float, default: str) -> DataFrame:
    """probe_id and the name of the nearest point of interest within max_degrees, or the default."""
    near = nearest(clicks, poi.select(F.col("poi_id").alias("target_id"), F.col("lon").alias("tx"), F.col("lat").alias("ty")))
    near = near.filter(F.col("d2") <= max_degrees * max_degrees).join(poi.select(F.col("poi_id").alias("target_id"), "name"), "target_id")
    return clicks.select("probe_id").join(near.select("probe_id", "name"), "probe_id", "left").select("probe_id", F.coalesce("name", F.lit(default)).alias("place"))


def resolved_clicks(clicks: DataFrame, poi: DataFrame, max_degrees: float, default: str) -> DataFrame:
    """probe_id and place: the feature that was clicked (column feature), else the nearest point of interest within max_degrees, else the default."""
    near = nearest_poi(clicks.filter("feature IS NULL").select("probe_id", "x", "y"), poi, max_degrees, default)
    return clicks.filter("feature IS NOT NULL").select("probe_id", F.col("feature").alias("place")).unionByName(near)
