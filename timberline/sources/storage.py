"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or set by setCheckpointDir.

    There is no other: a folder of the driver's machine alone would not be seen by executors on others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


#: Bytes of a batch on its way to or from Python. Each task holds a few of them twice, in the JVM's direct memory and in Python.
BATCH_BYTES = 4 << 20
MAX_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that start here exchange batches of about BATCH_BYTES with Python; batches of rows alone grow with the texts."""
    before = spark.conf.get(MAX_BYTES, None)
    spark.conf.set(MAX_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(MAX_BYTES) if before is None else spark.conf.set(MAX_BYTES, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that later steps compute nothing twice."""
    path = f"{shared_dir(df.sparkSession)}/timberline/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
