"""The sweep: every wanted item is fetched once, one failure leaves the others alone, and a restart neither loses nor repeats any.

Wanted items are a stream: each variable of each slot of each day, numbered in the order of time. Its
offset is the number of the first item that is not handed out, so a query goes on from its
checkpoint wherever it stopped. A batch leaves out what the manifest has, fetches the rest in tasks,
item by item, and writes what came of each under the batch's number; a batch that is run again writes
the same items over its own.

Defined results: an item whose fetch raises an error is 'failed', with the error's text, and is not
tried again by the same sweep; others are 'stored'; no days, or none before `until`, give no items;
rows of the manifest with nulls match nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FORMAT = "wanteditems"
SCHEMA = "item long, date date, slot string, variable string"
LOG = "item long, date date, slot string, variable string, status string, value double, error string"
DONE = pa.schema([("item", pa.int64()), ("date", pa.date32()), ("slot", pa.string()), ("variable", pa.string()), ("status", pa.string()), ("value", pa.float64()), ("error", pa.string())])

Item = tuple[int, datetime.date, str, str]


class WantedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.first = datetime.date.fromisoformat(options["first"])
        self.until = datetime.date.fromisoformat(options["until"])
        self.slots, self.variables = options["slots"].split(","), options["variables"].split(",")
        self.at_once = int(options.get("at_once", "100"))

    def item(self, n: int) -> Item:
        a_day = len(self.slots) * len(self.variables)
        day, k = divmod(n, a_day)
        return n, self.first + datetime.timedelta(days=day), self.slots[k // len(self.variables)], self.variables[k % len(self.variables)]

    def total(self) -> int:
        return max(0, (self.until - self.first).days + 1) * len(self.slots) * len(self.variables)

    def initialOffset(self) -> dict:
        return {"item": 0}

    def read(self, start: dict) -> tuple[Iterator[Item], dict]:
        end = {"item": max(start["item"], min(self.total(), start["item"] + self.at_once))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Item]:
        return iter([self.item(n) for n in range(start["item"], end["item"])])


class WantedItems(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):
        return WantedReader(self.options)


def wanted(spark: SparkSession, first: str, until: str, slots: tuple[str, ...], variables: tuple[str, ...], at_once: int = 100) -> DataFrame:
    """The items of the days from first to until as a stream, `at_once` in a batch."""
    spark.dataSource.register(WantedItems)
    options = {"first": first, "until": until, "slots": ",".join(slots), "variables": ",".join(variables), "at_once": str(at_once)}
    return spark.readStream.format(FORMAT).options(**options).load()


def fetched(items: DataFrame, fetch: Callable[[datetime.date, str, str], float]) -> DataFrame:
    """The items with what came of each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    out.append(row | {"status": "stored", "value": float(fetch(row["date"], row["slot"], row["variable"])), "error": None})
                except Exception as e:  # an item's failure is its own
                    out.append(row | {"status": "failed", "value": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=DONE)

    return items.select("item", "date", "slot", "variable").mapInArrow(each, LOG)


def swept(items: DataFrame, manifest: DataFrame, fetch: Callable[[datetime.date, str, str], float], path: str, parallel: int = 8, after: Callable[[int], None] | None = None) -> DataFrame:
    """Runs the stream of items until there are no more; what came of all, this run's and those before.

    manifest: date, slot, variable of what is there. path: a shared folder with the sweep's log and
    checkpoint, by which a sweep goes on. A batch is fetched by `parallel` tasks. after is called with each batch's number.
    """
    spark = items.sparkSession

    def run(rows: DataFrame, batch_id: int) -> None:
        todo = rows.join(manifest.select("date", "slot", "variable"), ["date", "slot", "variable"], "left_anti")
        fetched(todo.repartition(parallel, "item"), fetch).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        if after:
            after(batch_id)

    query = items.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return log(spark, path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG}, batch long").parquet(f"{path}/log")
