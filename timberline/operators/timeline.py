"""Time gaps and runs of repeated entries, over numbered entries (``seq``, which may have holes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions.masks import mask_hosts, mask_message
from timberline.operators.ordering import block_of, with_previous, with_running_sums
from timberline.options import Mask


def gap_text(ms: Column) -> Column:
    """Seconds to one decimal, without it where it is zero."""
    tenths = F.floor((ms + 50) / 100)
    return F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string"))), F.lit("s gap"))


def with_gaps(entries: DataFrame, threshold_ms: int) -> DataFrame:
    """Adds gap_ms and gap_text where the entry before is at least so long ago; both times must be known."""
    if threshold_ms <= 0:
        return entries.withColumns({"gap_ms": F.lit(None).cast("bigint"), "gap_text": F.lit(None).cast("string")})
    df = entries if "previous_ms" in entries.columns else with_previous(entries, {"previous_ms": F.col("timestamp_ms")})
    gap = F.col("timestamp_ms") - F.col("previous_ms")
    df = df.withColumn("gap_ms", F.when(gap >= threshold_ms, gap)).drop("previous_ms")
    return df.withColumn("gap_text", gap_text(F.col("gap_ms")))


def with_gap_rows(entries: DataFrame, threshold_ms: int) -> DataFrame:
    """Adds gap_ms and gap_text as :func:`with_gaps` does, and _end, the number of the entry's last row where every line
    of its message and every gap is a row; all in one pass over blocks."""
    if "previous_ms" in entries.columns or threshold_ms <= 0:
        df = with_gaps(entries, threshold_ms)
        n = F.size(F.split("message", "\n", -1)) + F.col("gap_ms").isNotNull().cast("int")
        return with_running_sums(df, {"_end": n})
    order = Window.partitionBy("_block").orderBy("seq")
    ms = F.struct(F.col("timestamp_ms").alias("ms"))
    df = entries.withColumn("_block", block_of()).withColumn("_lag", F.lag(ms).over(order))
    large = lambda gap: F.when(gap >= threshold_ms, gap)
    df = df.withColumn("_gap", large(F.col("timestamp_ms") - F.col("_lag.ms")))
    df = df.withColumn("_n", F.size(F.split("message", "\n", -1)) + F.col("_gap").isNotNull().cast("int"))
    df = df.withColumn("_within", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = df.groupBy(F.col("_block").alias("_of")).agg(F.sum("_n").alias("_rows"), F.min_by(ms, "seq").alias("_first"), F.max_by(ms, "seq").alias("_last"))
    along = Window.orderBy("_of")
    blocks = blocks.withColumn("_entry", large(F.col("_first.ms") - F.lag("_last").over(along)["ms"]))
    more = F.col("_entry").isNotNull().cast("int")
    before = F.coalesce(F.sum(F.col("_rows") + more).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(blocks.select("_of", "_entry", (before + more).alias("_before")), F.col("_block") == F.col("_of"))
    df = df.withColumns({"gap_ms": F.when(F.col("_lag").isNull(), F.col("_entry")).otherwise(F.col("_gap")), "_end": F.col("_before") + F.col("_within")})
    return df.withColumn("gap_text", gap_text(F.col("gap_ms"))).drop("_block", "_lag", "_gap", "_n", "_within", "_of", "_entry", "_before")


def repeat_key(mask: Mask = Mask()) -> Column:
    """What must be equal in a run: recognised or not, severity, and the message with hosts masked."""
    message = F.array_join(mask_message(F.col("message"), F.col("timestamp_format"), mask), "\n")
    return F.struct("matched", F.coalesce("severity", F.lit("")).alias("severity"), mask_hosts(message).alias("text"))


def laid_out(entries: DataFrame, mask: Mask = Mask()) -> DataFrame:
    """Numbers without holes, with previous_ms (time of the entry before) and run_id, in one pass over blocks.

    Ranks, previous rows and changes come from one window over each block; the small table of blocks adds the rows and
    runs before it, and tells whether its first row goes on with the run of the block before.
    """
    df = entries.withColumns({"_block": block_of(), "_own": F.struct(repeat_key(mask).alias("key"), F.col("timestamp_ms").alias("ms"))})
    order = Window.partitionBy("_block").orderBy("seq")
    df = df.withColumns({"_rank": F.row_number().over(order), "_lag": F.lag("_own").over(order)})
    changed = F.when(F.col("_lag").isNotNull() & ~F.col("_lag.key").eqNullSafe(F.col("_own.key")), 1).otherwise(0)
    df = df.withColumn("_new", changed)
    df = df.withColumn("_runs", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = df.groupBy(F.col("_block").alias("_of")).agg(F.count("*").alias("_n"), F.sum("_new").alias("_changes"), F.min_by("_own", "seq").alias("_first"), F.max_by("_own", "seq").alias("_last"))
    along = Window.orderBy("_of")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carry", F.lag("_last").over(along))
    starts = F.when(F.col("_carry").isNotNull() & F.col("_carry.key").eqNullSafe(F.col("_first.key")), 0).otherwise(1)
    blocks = blocks.withColumn("_starts", starts)
    rows, runs = (F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("_n", F.col("_changes") + F.col("_starts")))
    blocks = blocks.select("_of", "_carry", rows.alias("_rows_before"), (runs + F.col("_starts")).alias("_runs_before"))
    df = df.join(blocks, F.col("_block") == F.col("_of"))
    df = df.withColumns({
        "seq": (F.col("_rows_before") + F.col("_rank")).cast("bigint"),
        "previous_ms": F.when(F.col("_lag").isNotNull(), F.col("_lag.ms")).otherwise(F.col("_carry.ms")),
        "run_id": (F.col("_runs_before") + F.col("_runs")).cast("bigint"),
    })
    return df.drop("_block", "_own", "_rank", "_lag", "_new", "_runs", "_of", "_carry", "_rows_before", "_runs_before")


def with_runs(entries: DataFrame, threshold: int = 3, mask: Mask = Mask()) -> DataFrame:
    """Adds run_id, run_len and is_group. Runs cross files; those shorter than max(2, threshold) are no groups."""
    df = entries if "run_id" in entries.columns else laid_out(entries, mask)
    size = df.groupBy("run_id").agg(F.count("*").alias("run_len"))
    return df.join(size, "run_id").withColumn("is_group", F.col("run_len") >= max(2, threshold))


def groups(runs: DataFrame, threshold: int = 3) -> DataFrame:
    """One row for each group: its size, first and last entry's times and lines, and its files in order.

    Runs are aggregated, never gathered; of a run's files only the place of their first entry is.
    """
    first = lambda c: F.min_by(c, "seq")
    last = lambda c: F.max_by(c, "seq")
    kinds = (F.min("kind") != F.max("kind")) if "kind" in runs.columns else F.lit(False)
    g = runs.groupBy("run_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), first("timestamp_ms").alias("first_ms"), last("timestamp_ms").alias("last_ms"), first("start_line").alias("first_line"), last(F.col("start_line") + F.size("lines") - 1).alias("last_line"), F.coalesce(kinds, F.lit(False)).alias("many_kinds"))
    files = runs.groupBy("run_id", "file_index").agg(F.min("seq").alias("_at")).groupBy("run_id")
    files = files.agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "file_index"))), lambda x: x["file_index"]).alias("file_indices"))
    return g.where(F.col("n") >= max(2, threshold)).join(files, "run_id")
