"""Ship motion on edges, and which edges it blocks.

The scorer is a parameter: a function of the five features that gives roll, heave and pitch as
Columns. The default's coefficients are synthetic; the thresholds are the rule's own. Edges meet
nodes and predictions in merges, for the reason that lattice.py states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.geo import relative_heading

FEATURES = ("ship_speed", "wave_heading", "wave_height", "wave_period", "condition")
#: Motions from which an edge is blocked.
ROLL, HEAVE, PITCH = 6.0, 0.7, 3.0
SPEED, CONDITION = 8, 1


def linear_scorer(ship_speed: Column, wave_heading: Column, wave_height: Column, wave_period: Column, condition: Column) -> tuple[Column, Column, Column]:
    beam, head = F.abs(F.sin(F.radians(wave_heading))), F.abs(F.cos(F.radians(wave_heading)))
    return 0.8 * wave_height + 2.2 * beam + 0.1 * wave_period, 0.12 * wave_height + 0.01 * wave_period + 0.01 * condition, 0.4 * wave_height + 1.1 * head + 0.01 * ship_speed


def features(edges: DataFrame, nodes: DataFrame, cells: DataFrame, speed: float = SPEED, condition: int = CONDITION) -> DataFrame:
    """Edges with the features: waves of the cell where an edge begins, and their angle against its bearing."""
    at = nodes.select(F.col("node_id").alias("src"), F.col("row_j").alias("row_i"), F.col("col_i").alias("col_j")).join(cells, ["row_i", "col_j"])
    waves = at.select("src", F.col("height").alias("wave_height"), F.col("period").alias("wave_period"), "direction")
    joined = edges.join(waves.hint("merge"), "src", "left")
    return joined.select("src", "dst", "weight", "bearing", F.lit(float(speed)).alias("ship_speed"), relative_heading(F.col("bearing"), F.col("direction")).alias("wave_heading"), "wave_height", "wave_period", F.lit(condition).alias("condition"))


def scored(featured: DataFrame, scorer: Callable = linear_scorer) -> DataFrame:
    """Edges with roll, heave, pitch and blocked. An edge without waves moves not and is not blocked."""
    roll, heave, pitch = (F.round(F.coalesce(c, F.lit(0.0)), 6) for c in scorer(*map(F.col, FEATURES)))
    out = featured.withColumn("roll", roll).withColumn("heave", heave).withColumn("pitch", pitch)
    return out.withColumn("blocked", (F.col("roll") >= ROLL) | (F.col("heave") >= HEAVE) | (F.col("pitch") >= PITCH))


def with_predictions(edges: DataFrame, predictions: DataFrame, speed: float = SPEED, condition: int = CONDITION) -> DataFrame:
    """Edges with their stored prediction for a speed and condition; 0 and false, and missed, where there is none."""
    found = F.struct("roll", "heave", "pitch", "blocked").alias("found")
    own = predictions.filter((F.col("ship_speed") == speed) & (F.col("condition") == condition)).select("src", "dst", found)
    joined = edges.select("src", "dst", "weight", "bearing").join(own.hint("merge"), ["src", "dst"], "left")
    zero = [F.coalesce(f"found.{c}", F.lit(0.0)).alias(c) for c in ("roll", "heave", "pitch")]
    return joined.select("src", "dst", "weight", "bearing", *zero, F.coalesce("found.blocked", F.lit(False)).alias("blocked"), F.col("found").isNull().alias("missed"))


def edges_in_view(edges: DataFrame, nodes: DataFrame, box: tuple[float, float, float, float], *, blocked_only: bool = True, max_edges: int = 300_000) -> DataFrame:
    """edge_id, both ends' coordinates and blocked of the first edges, by id, with an end in the box (min lon, min lat, max lon, max lat)."""
    shown = edges.filter("blocked") if blocked_only else edges
    a = nodes.select(F.col("node_id").alias("src"), F.col("lon").alias("src_lon"), F.col("lat").alias("src_lat"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("lon").alias("dst_lon"), F.col("lat").alias("dst_lat"))
    joined = shown.select("edge_id", "src", "dst", "blocked").join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    inside = [F.col(f"{e}_lon").between(box[0], box[2]) & F.col(f"{e}_lat").between(box[1], box[3]) for e in ("src", "dst")]
    return joined.filter(inside[0] | inside[1]).orderBy("edge_id").limit(max_edges).select("edge_id", "src_lon", "src_lat", "dst_lon", "dst_lat", "blocked")
