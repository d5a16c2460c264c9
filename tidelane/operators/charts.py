"""Summaries that charts, gauges and legends show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.display import GAUGE_FLOORS, colour

SERIES = {"environment": ("htsgwsfc", "perpwsfc", "dirpwsfc"), "motion": ("roll", "heave", "pitch")}


def extremes(rows: DataFrame, measure: str, zero_for_missing: bool = True) -> DataFrame:
    value = F.coalesce(measure, F.lit(0.0)) if zero_for_missing else F.col(measure)
    return rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))


def gauge_max(rows: DataFrame) -> DataFrame:
    """The gauges' ends: the largest value, or a floor below which none ends; a full circle for the heading."""
    tops = [F.greatest(F.max(F.col(c).cast("double")), F.lit(floor)).alias(c) for c, floor in GAUGE_FLOORS.items()]
    return rows.agg(*tops).withColumn("heading", F.lit(360.0))


def sub_arcs(fractions: list[float], top):
    """Ends of a gauge's coloured arcs."""
    return F.transform(F.array(*map(F.lit, fractions)), lambda f: f * top)


def axis_range(series: DataFrame) -> DataFrame:
    return series.groupBy("series").agg((F.min("value") - 1).alias("low"), (F.max("value") + 1).alias("high"))


def unpivoted(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, family, series, value of path points."""
    long = points.select(*keys, *[F.col(c).cast("double").alias(c) for f in SERIES.values() for c in f]).unpivot(keys, [c for f in SERIES.values() for c in f], "series", "value")
    family = F.when(F.col("series").isin(*SERIES["environment"]), "environment").otherwise("motion")
    return long.withColumn("family", family)


def progress(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each point's share of the way, in percent."""
    return points.withColumn("percent", F.round(100 * F.percent_rank().over(Window.partitionBy(*by).orderBy(order)), 6))


def percent_labels(points: DataFrame, every: int = 5) -> DataFrame:
    """position and label of an axis over the points: arrival, a label every `every` percent as long as its point comes before the last, Departure."""
    steps = 100 // every
    n, i = F.col("n"), F.col("i")
    at = i * F.floor(n / steps)
    marks = points.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    kept = marks.filter((i == 0) | (i == steps) | ((n >= 2) & (at < n - 1)))
    label = F.when(i == 0, "arrival").when(i == steps, "Departure").otherwise(F.concat((i * every).cast("string"), F.lit("%")))
    # The labels between the ends are a beginning of the series, so only the last one moves up.
    before = F.when(n < 2, 0).when(n < steps, steps - 1).otherwise(F.least(F.lit(steps - 1), F.ceil((n - 1) / F.floor(n / steps)) - 1))
    return kept.select(F.when(i == steps, before + 1).otherwise(i).cast("int").alias("position"), label.alias("label"))


def same_length(series: DataFrame, chart: str, name: str) -> DataFrame:
    """chart, n_series, same_length, any_values: whether all of a chart's series have as many points, and whether any has a value."""
    sizes = series.groupBy(chart, name).agg(F.count("*").alias("n"), F.bool_or(F.col("value").isNotNull()).alias("filled"))
    return sizes.groupBy(chart).agg(F.count("*").alias("n_series"), (F.min("n") == F.max("n")).alias("same_length"), F.bool_or("filled").alias("any_values"))


def legend(rows: DataFrame, measure: str, variable: str, steps: int = 4) -> DataFrame:
    """step, low, high, colour of equal intervals over the measure's range; one grey interval if it has none."""
    ends = extremes(rows, measure)
    n = F.when(F.col("high") > F.col("low"), steps).otherwise(1)
    cut = ends.select("low", "high", F.explode(F.sequence(F.lit(0), n - 1)).alias("step"), n.alias("n"))
    width = (F.col("high") - F.col("low")) / F.col("n")
    a = F.col("low") + F.col("step") * width
    return cut.select("step", F.round(a, 6).alias("from"), F.round(a + width, 6).alias("to"), colour(variable, a + width / 2, F.col("low"), F.col("high")).alias("colour"))


def at_cursor(points: DataFrame, step: int, measures: list[str]) -> DataFrame:
    """The measures at a step, 0 where there is none."""
    return points.agg(*[F.coalesce(F.max(F.when(F.col("step") == step, F.col(m))), F.lit(0.0)).alias(m) for m in measures])
