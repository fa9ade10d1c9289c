"""Ordered operations without one task for all rows.

Rows are put in order by range partitions, whose sampled bounds split even a single repeated instant, and numbered by
their place in a partition plus the sizes of those before. That is the one step that writes: the sorted table, since
several passes follow, and its input where the bounds are to be sampled from it.

With numbers given, previous rows and running sums work within blocks of BLOCK numbers. A small table of blocks passes
on what a block needs of those before it. Numbers may have holes: what a filter removes need not be numbered anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.sources.storage import staged

BLOCK = 65_536
IN_PARTITION = 33


def numbered(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """``df`` sorted and numbered from 1 in the given order, which must tell all rows apart."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    df = staged(ranges, "timeline").withColumn("_part", F.shiftright("_id", IN_PARTITION))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = df.groupBy(F.col("_part").alias("_of")).agg(F.count("*").alias("_n")).select("_of", before.alias("_before"))
    df = df.join(F.broadcast(parts), F.col("_part") == F.col("_of"))  # a row for each partition
    place = F.col("_id") - F.shiftleft("_part", IN_PARTITION)
    return df.withColumn(name, (F.col("_before") + place + 1).cast("bigint")).drop("_id", "_part", "_of", "_before")


def by_time(df: DataFrame, name: str = "seq") -> DataFrame:
    """Numbers by time, rows without one last, ties by file and line."""
    return numbered(staged(df, "entries"), [F.asc_nulls_last("timestamp_ms"), F.asc("file_index"), F.asc("start_line")], name)


def by_line(df: DataFrame, name: str = "seq") -> DataFrame:
    """Numbers by file and line."""
    return numbered(staged(df, "entries"), [F.asc("file_index"), F.asc("start_line")], name)


def block_of(seq: str = "seq") -> Column:
    return F.floor((F.col(seq) - 1) / BLOCK)


def with_previous(df: DataFrame, columns: dict[str, Column], seq: str = "seq") -> DataFrame:
    """Adds, under the given names, the values that the columns have in the row before."""
    df = df.withColumns({"_block": block_of(seq), "_own": F.struct(*(c.alias(n) for n, c in columns.items()))})
    last = df.groupBy(F.col("_block").alias("_of")).agg(F.max_by("_own", seq).alias("_last"))
    carry = last.select("_of", F.lag("_last").over(Window.orderBy("_of")).alias("_carry"))
    df = df.withColumn("_lag", F.lag("_own").over(Window.partitionBy("_block").orderBy(seq)))
    df = df.join(carry, F.col("_block") == F.col("_of")).withColumn("_prev", F.coalesce("_lag", "_carry"))
    return df.withColumns({n: F.col("_prev")[n] for n in columns}).drop("_block", "_own", "_lag", "_of", "_carry", "_prev")


def with_running_sums(df: DataFrame, values: dict[str, Column], seq: str = "seq") -> DataFrame:
    """Adds, under the given names, the sums of the values over this row and all before it."""
    own = {f"_v_{n}": v.cast("bigint") for n, v in values.items()}
    df = df.withColumns({"_block": block_of(seq), **own})
    totals = df.groupBy(F.col("_block").alias("_of")).agg(*(F.sum(c).alias(f"_t{c}") for c in own))
    earlier = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_of", *(F.coalesce(F.sum(f"_t{c}").over(earlier), F.lit(0)).alias(f"_b{c}") for c in own))
    within = Window.partitionBy("_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_w{c}": F.sum(c).over(within) for c in own}).join(before, F.col("_block") == F.col("_of"))
    df = df.withColumns({n: F.col(f"_b_v_{n}") + F.col(f"_w_v_{n}") for n in values})
    return df.drop("_block", "_of", *own, *(f"_b{c}" for c in own), *(f"_w{c}" for c in own))
