"""From lines to entries: recognition, then grouping of continuation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions.compiled import compilable, with_text_recognized
from timberline.functions.recognize import recognized, recognized_json
from timberline.operators.ordering import BLOCK
from timberline.options import ParseOptions
from timberline.sources.files import kind_of, split_lines

ENTRY = ["file_index", "file_name", "kind", "start_line", "timestamp_ms", "raw_timestamp", "timestamp_format", "severity", "message", "lines", "matched", "prefix_len"]


def recognize_lines(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Lines (file_index, line_no, line, source_offset_min if there is one) with a struct ``r`` of what they start.

    Text lines are recognised on the JVM. Only lines that may be JSON records go to Python, or all of them where the
    options hold own formats.
    """
    offset = F.col("source_offset_min") if "source_offset_min" in lines.columns else F.lit(options.source_offset_min)
    if not compilable(options):
        return lines.withColumn("r", recognized(F.col("line"), offset, options))
    if not options.json_lines:
        return with_text_recognized(lines, "line", offset, options)
    df = with_text_recognized(lines.withColumn("_json", recognized_json(F.col("line"), offset, options)), "line", offset, options)
    return df.withColumn("r", F.when(F.col("_json.ms").isNotNull(), F.col("_json")).otherwise(F.col("r"))).drop("_json")


def with_entry_start(recognized_lines: DataFrame) -> DataFrame:
    """Adds start_line, the line that the entry starts at (its own first line, for those before any start).

    Within blocks of lines by a window; what starts in earlier blocks comes from a table of blocks. Both read the same
    shuffled lines, so that these are recognised once: neither side may let Spark prune a column of the exchange or push
    a filter below it. Hence the keys that cannot be null, and a hash of all columns in the table of blocks. Lines
    without file_index or line_no are left out.
    """
    df = recognized_lines.where(F.col("file_index").isNotNull() & F.col("line_no").isNotNull())
    df = df.withColumns({"file_index": F.coalesce("file_index", F.lit(0)), "line_no": F.coalesce("line_no", F.lit(0))})
    df = df.withColumns({"_block": F.coalesce(F.floor(F.col("line_no") / BLOCK), F.lit(0)), "_start": F.when(F.col("r.ms").isNotNull(), F.col("line_no"))})
    df = df.repartition("file_index", "_block")
    blocks = df.groupBy("file_index", "_block").agg(F.max("_start").alias("_last"), F.min("line_no").alias("_low"), F.max(F.xxhash64(*df.columns)).alias("_all"))
    by_file = Window.partitionBy("file_index").orderBy("_block")
    blocks = blocks.where(F.col("_all").isNotNull()).select(F.col("file_index").alias("_f"), F.col("_block").alias("_b"), F.max("_last").over(by_file.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"), F.min("_low").over(Window.partitionBy("file_index")).alias("_first"))
    within = F.max("_start").over(Window.partitionBy("file_index", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_within", within).join(blocks, (F.col("file_index") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return df.withColumn("start_line", F.coalesce("_within", "_carry", "_first")).drop("_block", "_start", "_within", "_f", "_b", "_carry", "_first")


def group_entries(recognized_lines: DataFrame) -> DataFrame:
    """One row for each entry; lines before the first start of a file are one entry with matched = false."""
    df = with_entry_start(recognized_lines)
    whole = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    head = F.min_by("r", "line_no")
    e = df.groupBy("file_index", "start_line").agg(F.transform(whole, lambda x: x["line"]).alias("lines"), head.alias("r"))
    first = F.coalesce(F.col("r.message"), F.col("lines")[0])
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    return e.select("file_index", "start_line", F.col("r.ms").alias("timestamp_ms"), F.col("r.raw").alias("raw_timestamp"), F.col("r.format").alias("timestamp_format"), F.col("r.severity").alias("severity"), F.array_join(F.concat(F.array(first), rest), "\n").alias("message"), "lines", F.col("r.ms").isNotNull().alias("matched"), F.col("r.prefix").alias("prefix_len"))


def parse_lines(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    return group_entries(recognize_lines(lines, options))


def parse_files(files: DataFrame, options: ParseOptions = ParseOptions(), lines: DataFrame | None = None) -> DataFrame:
    """Entries of files (file_index, file_name, and source_offset_min and skew_ms where set), with provenance.

    The lines come from ``lines`` (file_index, line_no, line), or else from the files' column ``text``. A file's skew is
    added to every recognised time, also one with a written offset; the raw text stays.
    """
    has = set(files.columns)
    facts = files.select("file_index", "file_name", kind_of("file_name").alias("kind"), (F.col("source_offset_min") if "source_offset_min" in has else F.lit(options.source_offset_min)).alias("source_offset_min"), (F.col("skew_ms") if "skew_ms" in has else F.lit(0)).alias("skew_ms"))
    lines = split_lines(files) if lines is None else lines
    e = parse_lines(lines.join(facts.select("file_index", "source_offset_min"), "file_index"), options).join(facts.drop("source_offset_min"), "file_index")
    return e.withColumn("timestamp_ms", apply_skew(F.col("timestamp_ms"), F.col("skew_ms"))).select(*ENTRY)


def apply_skew(ms, skew):
    return (ms + skew).cast("bigint")


def raw_text(lines="lines"):
    """The text of an entry as it stood in its file."""
    return F.array_join(lines, "\n")
