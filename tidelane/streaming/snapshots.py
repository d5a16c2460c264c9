"""Streams over snapshot events. Event times are session-zone timestamps: a watermark takes no others."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators.materialise import work_dir

SLOT = "6 hours"


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def slot_windows(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each kind in each 6-hour slot."""
    grouped = stamped(events).withWatermark("ts", late).groupBy(F.window("ts", SLOT).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.col("w.start").cast("timestamp_ntz").alias("slot_start"), "event_type", "n", "ids")


def throttled(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Each user's first event in each interval."""
    first = stamped(events).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("user_id", F.col("f.ts").cast("timestamp_ntz").alias("ts"), F.col("f.event_id").alias("event_id"))


def debounced(events: DataFrame, quiet: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Each user's last event before a quiet time."""
    last = stamped(events).withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "user_id").agg(F.max(F.struct("ts", "event_id")).alias("l"), F.count("*").alias("n"))
    return last.select("user_id", F.col("l.ts").cast("timestamp_ntz").alias("ts"), F.col("l.event_id").alias("event_id"), "n")


def latest_per_variable(events: DataFrame) -> DataFrame:
    """The freshest event of each kind."""
    return events.groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("event_type", F.col("m.event_id").alias("event_id"))


def missing_snapshots(spark: SparkSession, manifest: DataFrame, day: str, days: int = 7) -> DataFrame:
    """date, slot, variable still to fetch of the last days: what a sweep does, item by item."""
    from tidelane.sources.stores import SLOTS, VARIABLES

    wanted = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(day)), days - 1), F.to_date(F.lit(day)))).alias("date"))
    wanted = wanted.withColumn("slot", F.explode(F.array(*map(F.lit, SLOTS)))).withColumn("variable", F.explode(F.array(*map(F.lit, VARIABLES))))
    return wanted.join(manifest, ["date", "slot", "variable"], "left_anti")


def run_once(stream: DataFrame, name: str, mode: str = "complete", keys: tuple[str, ...] = (), settings: Mapping[str, str] | None = None) -> DataFrame:
    """What a stream over the files there are gives in the end, as a table in the shared folder.

    The session has the settings while the stream runs, and what it had before afterwards.

    Each micro-batch is kept under its number; the rows are those of the batches that count for
    the mode: the last in complete mode, all in append mode, each key's last in update mode.
    """
    import uuid

    spark = stream.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(f"{path}/rows")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch long").parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("_batch").alias("_batch"))), "_batch", "left_semi")
    if mode == "update":
        others = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("last")).select(*keys, "last.*")
    return rows.drop("_batch")
