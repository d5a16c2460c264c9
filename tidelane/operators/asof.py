"""The newest row at each time: an as-of join over time ranges.

Both sides' rows go into one order of time, cut into ranges. In a range every row takes the last
newer thing before it; rows before a range's first take what the ranges before end with. So tasks
follow the ranges, not the keys: one key, or none, may have all rows.

Defined results: a row at the very time of a thing has it; of several things at one time the one with
the largest order column counts; rows before all things, and rows without a time, get nulls; things
without a time are left out; repeated rows each come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.materialise import saved


def newest_at(rows: DataFrame, things: DataFrame, at: str, order: str, values: list[str]) -> DataFrame:
    """The rows with the `values` of the newest thing at their time `at`. things: at, order and the values; no value's name is a row's column."""
    clash = {c.lower() for c in rows.columns} & {c.lower() for c in values}
    if clash:
        raise ValueError(f"rows have columns {sorted(clash)}")
    a = rows.select(F.col(at).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(things.schema[order].dataType).alias("order"), F.lit(None).cast(things.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("thing"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"))
    b = things.select(F.col(at).alias("at"), F.lit(0).alias("kind"), F.col(order).alias("order"), F.struct(*values).alias("thing"), F.lit(None).cast(a.schema["row"].dataType).alias("row")).filter("at IS NOT NULL")
    # Rows of a time are spread over ranges, too, by a number of their own; things come first.
    both = a.unionByName(b).withColumn("n", F.monotonically_increasing_id())
    ranged = saved(both.repartitionByRange("at", "kind", "order", "n").withColumn("range", F.spark_partition_id()))
    last = ranged.filter("kind = 0").groupBy("range").agg(F.max_by("thing", F.struct("at", "order", "n")).alias("thing")).collect()  # a row a range at most
    n_ranges = ranged.agg(F.max("range")).first()[0]
    by_range, now, carried = {r["range"]: r["thing"] for r in last}, None, []
    for k in range(0 if n_ranges is None else n_ranges + 1):
        carried.append((k, now))
        now = by_range.get(k, now)
    before = rows.sparkSession.createDataFrame(carried, ranged.select("range", F.col("thing").alias("carried")).schema)
    inside = Window.partitionBy("range").orderBy("at", "kind", "order", "n")
    filled = ranged.withColumn("own", F.last("thing", ignorenulls=True).over(inside)).filter("kind = 1").join(F.broadcast(before), "range")
    newest = filled.select("row", F.when(F.col("at").isNotNull(), F.coalesce("own", "carried")).alias("thing"))
    return newest.select(*(F.col("row").getField(c).alias(c) for c in rows.columns), *(F.col("thing").getField(c).alias(c) for c in values))
