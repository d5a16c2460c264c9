"""The raster source: what was written comes back, and a scan opens only the bands that its filters leave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.sources import bands


def grid(n_rows=20, n_cols=7):
    return [(v, r, c, -15.0 + r / 4, 92.0 + c / 2, None if (r + c) % 5 == 0 else float(v == "a") + r * 10 + c) for v in ("a", "b") for r in range(n_rows) for c in range(n_cols)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bands"))
    bands.write_bands(spark.createDataFrame(grid(), bands.SCHEMA), f"file://{path}", 6)
    return f"file://{path}"


def scanned(df):
    """Rows, and the number of partitions that the scan has."""
    return sorted(map(tuple, df.collect())), df.rdd.getNumPartitions()


def test_round_trip_and_bands(spark, stored):
    rows, n = scanned(bands.read_bands(spark, stored))
    assert rows == sorted(grid()) and n == 8  # four bands of two variables
    assert len(bands.listed(stored)) == 8


@pytest.mark.parametrize(
    ("condition", "most"),
    [("variable = 'a'", 4), ("variable IN ('a', 'x') AND lat > -13.5 AND lat <= -12.25", 1), ("row_i = 13", 2), ("lat BETWEEN -11 AND -10.5 AND lon >= 94 AND variable = 'b'", 2), ("variable = 'x'", 1), ("lon < 93 OR row_i = 2", 8), ("value > 100", 8)],
)
def test_filters_reach_the_scan(spark, stored, condition, most):
    whole = spark.createDataFrame(grid(), bands.SCHEMA)
    rows, n = scanned(bands.read_bands(spark, stored).filter(condition))
    assert rows == sorted(map(tuple, whole.filter(condition).collect())) and n <= most
    assert bands.read_bands(spark, stored).filter(condition).count() == len(rows)


def test_only_the_columns_asked_for_are_read(stored):
    path, variable, _ = bands.listed(stored)[0]
    part = bands.Band(path, variable, {"lon": (93.0, 93.5), "row_i": (2.0, 3.0)})
    assert [(b["row_i"][0].as_py(), b["col_j"].to_pylist()) for b in part.read()] == [(2, [2, 3]), (3, [2, 3])]


def test_fill_values_and_failures(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    one = np.array([0.0])
    (folder / "0_0_1.0_1.0_x.band").write_bytes(bands.encoded(one, np.arange(3.0), one + 1, np.arange(3.0), np.array([[1.0, np.nan, -5.0]]), fill=-5.0))
    assert [r.value for r in bands.read_bands(spark, str(tmp_path)).orderBy("col_j").collect()] == [1.0, None, None]
    (folder / "1_1_2.0_2.0_x.band").write_bytes(b"something else")
    with pytest.raises(Exception, match="is not a band"):
        bands.read_bands(spark, str(tmp_path)).collect()
    assert bands.read_bands(spark, str(tmp_path / "none")).count() == 0
    broken = spark.createDataFrame(grid(), bands.SCHEMA).withColumn("value", F.when(F.col("row_i") == 19, F.raise_error(F.lit("no value"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no value"):
        bands.write_bands(broken, str(tmp_path / "failed"), 6)
    assert bands.listed(str(tmp_path / "failed")) == []
    bands.write_bands(spark.createDataFrame([], bands.SCHEMA), str(tmp_path / "empty"))
    assert bands.read_bands(spark, str(tmp_path / "empty")).count() == 0
