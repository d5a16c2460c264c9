"""Points of interest by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "struct<name: string, lon: double, lat: double>"


def from_lists(spark: SparkSession, sites: dict[str, list[tuple[str, float, float]]]) -> DataFrame:
    """category, name, lon, lat of the places listed by category."""
    one = spark.createDataFrame([(sites,)], f"sites map<string, array<{PLACE}>>")
    return flat(one.select(F.explode("sites").alias("category", "places")))


def flat(lists: DataFrame) -> DataFrame:
    """category, name, lon, lat: a row for each place of rows (category, places), as a file of categories has them."""
    return lists.select("category", F.inline("places"))


def by_category(places: DataFrame) -> DataFrame:
    """category, places: each category's list, in the order of the names."""
    return places.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("name", "lon", "lat"))).alias("places"))
