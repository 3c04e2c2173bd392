"""Session defaults of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 4 << 20
CLUSTERS = 256


def session(name: str = "verdancy", **config: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword options use `__` for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in config.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset: a temporary folder if driver and executors are one process, else one in the warehouse, which executors share."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        alone = sc.master == "local" or sc.master.startswith("local[")
        named = tempfile.mkdtemp(prefix="verdancy-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_verdancy"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of a key in one of CLUSTERS tasks, which adaptive execution doesn't gather into fewer: what groups by these keys and more needs no other shuffle, and its hash tables stay small in each task."""
    return df.repartition(CLUSTERS, *keys)


def large_rows(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES at most from now on in this session: packed rows of some MB go to Python a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, rows_in_file: int = 0) -> DataFrame:
    """df written once to the shared folder and read back: what is used several times neither fills memory nor is lost with an executor. Large rows are few in a file (rows_in_file), as a reader holds many rows at once."""
    path = f"{shared_folder(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_in_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
