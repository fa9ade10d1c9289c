"""How much of a log was recognised, and other counts. Taken before any filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# When a file is worth a warning.
MIN_LINES, LOW_RATIO, MIN_RUN = 10, 0.5, 10
TIMESTAMP_LIKE = r"^(?:\[|\()?(?:(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})[T ]|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日\s+)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:\s|$)"


def distinct_severities(entries: DataFrame) -> DataFrame:
    """(severity, first_file, first_line) in order of first appearance; unrecognised is the empty string."""
    at = F.min(F.struct("file_index", "start_line"))
    return entries.groupBy(F.coalesce("severity", F.lit("")).alias("severity")).agg(at.alias("_at")).select("severity", F.col("_at.file_index").alias("first_file"), F.col("_at.start_line").alias("first_line")).orderBy("first_file", "first_line")


def line_counts(entries: DataFrame) -> DataFrame:
    """One row: entries, and the physical lines they hold."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).cast("bigint").alias("lines"))


def hidden_lines(all_entries: DataFrame, shown: DataFrame) -> DataFrame:
    total, visible = line_counts(all_entries).select(F.col("lines").alias("total")), line_counts(shown).select(F.col("lines").alias("visible"))
    both = total.withColumn("visible", F.lit(None).cast("bigint")).unionByName(visible.withColumn("total", F.lit(None).cast("bigint")))
    return both.agg(F.max("total").alias("total_lines"), F.max("visible").alias("visible_lines")).withColumn("hidden_lines", F.col("total_lines") - F.col("visible_lines"))


def recognition(entries: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each file. Blank lines count for nothing and end no run; files without entries have zeros.

    A run is a number of continuation lines of one entry in a row that look as if they began with a timestamp.
    """
    x = entries.select("file_index", "start_line", "matched", F.posexplode("lines").alias("i", "line")).where(F.trim(F.regexp_replace("line", r"[\s ﻿　]+", " ")) != "")
    x = x.withColumn("like", F.col("matched") & (F.col("i") > 0) & F.col("line").rlike(TIMESTAMP_LIKE))
    by_entry = Window.partitionBy("file_index", "start_line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("breaks", F.sum((~F.col("like")).cast("int")).over(by_entry))
    runs = x.groupBy("file_index", "start_line", "breaks").agg(F.sum(F.col("like").cast("int")).alias("run"), F.count("*").alias("n"), F.sum((~F.col("matched")).cast("int")).alias("lost"))
    out = runs.groupBy("file_index").agg(F.sum("n").alias("total_lines"), F.sum("lost").alias("unrecognized_lines"), F.max("run").cast("bigint").alias("suspicious_run"))
    if files is not None:
        out = files.select("file_index").join(out, "file_index", "left")
    out = out.fillna(0, ["total_lines", "unrecognized_lines", "suspicious_run"])
    ratio = F.when(F.col("total_lines") == 0, F.lit(0.0)).otherwise(F.col("unrecognized_lines") / F.col("total_lines"))
    out = out.withColumns({"ratio": ratio, "switch_suspected": F.col("suspicious_run") >= MIN_RUN})
    return out.withColumn("should_warn", ((F.col("total_lines") >= MIN_LINES) & (F.col("ratio") >= LOW_RATIO)) | F.col("switch_suspected"))


def unrecognized_sample(entries: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` non-blank lines outside any recognised entry; n is the report's length."""
    x = entries.where(~F.col("matched")).select("file_index", F.col("start_line"), F.posexplode("lines").alias("i", "line")).where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    return x.select("file_index", (F.col("start_line") + F.col("i")).alias("line_no"), "line").orderBy("file_index", "line_no").limit(n)
