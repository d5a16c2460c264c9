"""Rasters as binary bands: a Python data source that reads the bands and columns that a query asks for.

A band is a file with some rows of one variable's grid: a header with the grid's coordinates and its
fill value, then the values, row by row. A scan has a partition for each band; filters on `variable`,
`lat`, `lon`, `row_i` and `col_j` reach it and leave out bands, and of a band's rows only the run of
columns asked for is read. Filters on coordinates are also left to Spark, which takes them exactly.

Bands are written by tasks under names of their own and get their final names when all are done, so
that a failed job leaves nothing. Paths are local or on a file system that Arrow opens; tasks and the
driver must all reach them.

Defined results: values equal to the fill value, and NaN, are read as null, and null is written as
the fill value; a cell that a band's grid has and no row had is null, too; of several rows for one
cell the last counts; an empty table writes no band; a folder without bands has no rows.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "variable string, row_i int, col_j int, lat double, lon double, value double"
ARROW = pa.schema([("variable", pa.string()), ("row_i", pa.int32()), ("col_j", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64())])
FORMAT, ENDING, MAGIC = "rasterbands", ".band", b"BAND1\n"
FILL = 9.999e20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def encoded(rows: np.ndarray, cols: np.ndarray, lats: np.ndarray, lons: np.ndarray, values: np.ndarray, fill: float = FILL) -> bytes:
    """A band's file: rows and lats, cols and lons are its grid's; values are NaN where missing."""
    head = json.dumps({"rows": len(rows), "cols": len(cols), "fill": fill}).encode()
    grid = b"".join(x.astype("<f8").tobytes() for x in (rows, cols, lats, lons))
    return MAGIC + struct.pack("<I", len(head)) + head + grid + np.where(np.isnan(values), fill, values).astype("<f8").tobytes()


@dataclass
class Band(InputPartition):
    """One file, and the bounds of what is asked of it: [least, most] by column."""

    path: str
    variable: str
    bounds: dict[str, tuple[float, float]]

    def __init__(self, path: str, variable: str, bounds: dict[str, tuple[float, float]]):
        self.path, self.variable, self.bounds = path, variable, bounds

    def _within(self, name: str, values: np.ndarray) -> np.ndarray:
        low, high = self.bounds.get(name, (-np.inf, np.inf))
        return (values >= low) & (values <= high)

    def read(self) -> Iterator[pa.RecordBatch]:
        fs, path = _opened(self.path)
        with fs.open_input_file(path) as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{self.path} is not a band")
            (n,) = struct.unpack("<I", f.read(4))
            head = json.loads(f.read(n))
            rows, cols = head["rows"], head["cols"]
            grid = np.frombuffer(f.read(16 * (rows + cols)), "<f8")
            at = f.tell()
            row, col, lat, lon = np.split(grid, np.cumsum([rows, cols, rows]))
            own_rows = np.flatnonzero(self._within("row_i", row) & self._within("lat", lat))
            own_cols = np.flatnonzero(self._within("col_j", col) & self._within("lon", lon))
            if not len(own_cols):
                return
            first, last = int(own_cols[0]), int(own_cols[-1]) + 1
            for k in own_rows.tolist():
                f.seek(at + 8 * (k * cols + first))
                values = np.frombuffer(f.read(8 * (last - first)), "<f8")
                m = len(values)
                missing = np.isnan(values) | (values == head["fill"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([self.variable] * m, pa.string()), pa.array(np.full(m, int(row[k])), pa.int32()), pa.array(col[first:last].astype(np.int32), pa.int32()), pa.array(np.full(m, lat[k])), pa.array(lon[first:last]), pa.array(values, pa.float64(), mask=missing)],
                    schema=ARROW,
                )


def listed(path: str) -> list[tuple[str, str, dict]]:
    """Path, variable and bounds of each band in a folder; the bounds are in its name."""
    fs, root = _opened(path)
    scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
    found = []
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
        if info.path.endswith(ENDING):
            name = posixpath.basename(info.path)[: -len(ENDING)]
            first, last, south, north = name.split("_")[:4]
            variable = posixpath.basename(posixpath.dirname(info.path))
            found.append((scheme + info.path, variable, {"row_i": (float(first), float(last)), "lat": (float(south), float(north))}))
    return sorted(found)


class BandReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.variables: set[str] | None = None
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "variable" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.variables = wanted if self.variables is None else self.variables & wanted
                continue  # taken exactly here
            if name in ("row_i", "col_j", "lat", "lon") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low, high = self.bounds.get(name, (-np.inf, np.inf))
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, float(f.value))
                self.bounds[name] = (low, high)
            yield f

    def partitions(self):
        bands = []
        for path, variable, own in listed(self.path):
            apart = any(own[c][1] < low or own[c][0] > high for c, (low, high) in self.bounds.items() if c in own)
            if not apart and (self.variables is None or variable in self.variables):
                bands.append(Band(path, variable, self.bounds))
        return bands or [Band("", "", {})]

    def read(self, partition):
        return iter(()) if not partition.path else partition.read()


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class BandWriter(DataSourceArrowWriter):
    """Writes the bands that a task has: its rows come sorted by variable and band."""

    def __init__(self, path: str, band_rows: int, replace: bool):
        self.path, self.band_rows, self.replace = path, band_rows, replace
        self.before = [p for p, _, _ in listed(path)] if replace else []

    def write(self, iterator):
        fs, root = _opened(self.path)
        names: list[tuple[str, str]] = []
        held: list[pa.RecordBatch] = []
        now = None

        def close():
            if not held:
                return
            t = pa.Table.from_batches(held)
            row, col = t["row_i"].to_numpy(), t["col_j"].to_numpy()
            rows, r = np.unique(row, return_inverse=True)
            cols, c = np.unique(col, return_inverse=True)
            lats, lons = np.full(len(rows), np.nan), np.full(len(cols), np.nan)
            lats[r], lons[c] = t["lat"].to_numpy(), t["lon"].to_numpy()
            values = np.full((len(rows), len(cols)), np.nan)
            values[r, c] = t["value"].to_numpy(zero_copy_only=False)
            folder = posixpath.join(root, now[0])
            fs.create_dir(folder, recursive=True)
            final = posixpath.join(folder, f"{rows[0]}_{rows[-1]}_{float(lats.min())!r}_{float(lats.max())!r}_{uuid.uuid4().hex}{ENDING}")
            with fs.open_output_stream(f"{final}.part") as out:
                out.write(encoded(rows, cols, lats, lons, values))
            names.append((f"{final}.part", final))
            held.clear()

        for b in iterator:
            variables, bands = b.column("variable").to_pylist(), (b.column("row_i").to_numpy() // self.band_rows).tolist()
            start = 0
            for k in range(b.num_rows + 1):
                key = (variables[k], bands[k]) if k < b.num_rows else None
                if k == b.num_rows or (k > start and key != (variables[start], bands[start])):
                    mine = (variables[start], bands[start]) if b.num_rows else None
                    if mine != now:
                        close()
                        now = mine
                    if k > start:
                        held.append(b.slice(start, k - start))
                    start = k
        close()
        return Written(names)

    def commit(self, messages):
        fs, _ = _opened(self.path)
        for m in messages:
            for part, final in m.names if m else ():
                fs.move(part, final)
        for old in self.before:
            fs.delete_file(_opened(old)[1])

    def abort(self, messages):
        fs, _ = _opened(self.path)
        for m in messages:
            for part, _ in m.names if m else ():
                fs.delete_file(part)


class RasterBands(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BandReader(self.options["path"])

    def writer(self, schema, overwrite):
        return BandWriter(self.options["path"], int(self.options.get("band_rows", "64")), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format and gives its scans their filters from now on."""
    spark.dataSource.register(RasterBands)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_bands(values: DataFrame, path: str, band_rows: int = 64) -> None:
    """Long rows (SCHEMA) as bands of `band_rows` rows of the grid each. A task holds one band."""
    band = F.floor(F.col("row_i") / band_rows)
    rows = values.select(*(F.col(c).cast(t).alias(c) for c, t in (part.split() for part in SCHEMA.split(", "))))
    dealt = rows.repartition("variable", band).sortWithinPartitions("variable", band, "row_i", "col_j")
    registered(values.sparkSession)
    dealt.write.format(FORMAT).mode("append").option("path", path).option("band_rows", str(band_rows)).save()


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).read.format(FORMAT).option("path", path).load()
