"""Logs that still grow: recognition over a stream of lines, and counts by severity with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.parse import recognize_lines
from timberline.options import ParseOptions


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the text files of a folder, as (path, line)."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("line"))


def recognized_stream(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Lines that start a record, with their fields. It keeps no state: continuation lines are grouped in batch."""
    r = recognize_lines(lines, options).where(F.col("r.ms").isNotNull())
    return r.select(*lines.columns, F.timestamp_millis("r.ms").alias("ts"), F.col("r.ms").alias("timestamp_ms"), F.col("r.severity").alias("severity"), F.col("r.message").alias("message"))


def severity_counts(records: DataFrame, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Records by severity and window; those later than the watermark are left out."""
    w = records.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), F.coalesce("severity", F.lit("")).alias("severity"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "severity", "n")
