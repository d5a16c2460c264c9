"""Results written to the cluster's shared folder and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where that is unset and Spark runs in this process alone, a folder of this process, which goes
    at its end; on a cluster that is an error, as executors and driver share no local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidelane-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def saved(df: DataFrame, *folders: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and survives lost executors. Rows lie in folders by the columns named."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/tidelane-{uuid.uuid4().hex}"
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
