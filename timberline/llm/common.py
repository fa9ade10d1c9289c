"""What the corpus operators share: intermediate tables, word classes, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources.storage import shared_dir, staged

__all__ = ["az_lower", "distinct_by", "distinct_count", "documents", "hash_sample", "hash_share", "join_hot", "row_key", "shared_dir", "shuffle_partitions", "small_side", "staged"]

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
#: A key with more than 1 / HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def az_lower(c: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.translate(c, UPPER, LOWER)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Stands for a row by its content; equal rows share it, and equal rows get equal results."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, name: str, max_rows: int = 1_000_000) -> DataFrame:
    """A narrow table, written once, as the side of a join: broadcast up to ``max_rows`` rows, else left to Spark."""
    df = staged(df, name)
    return F.broadcast(df) if df.count() <= max_rows else df


def hash_share(k: int, n: int) -> int:
    """The part, of 2**32, of the hash space that holds rather more than ``k`` of ``n`` distinct hashes."""
    return int(min(1.0, (1.25 * k + 200) / max(n, 1)) * 2**32)


def distinct_count(df: DataFrame, h: Column) -> int:
    """About how many values ``h`` has; copies share a hash, so a share of the hash space must be one of these, not of rows."""
    return df.agg(F.approx_count_distinct(h)).first()[0]


def distinct_by(df: DataFrame, h: str, label: str) -> DataFrame:
    """One row for each ``h``, with the least label; all other columns must follow from ``h``."""
    return df.groupBy(h).agg(*((F.min(c) if c == label else F.first(c)).alias(c) for c in df.columns if c != h))


def hash_sample(df: DataFrame, h: str, label: str, k: int, n: int) -> DataFrame:
    """At most ``k`` rows of distinct ``h``, dealt by hash, of a table of about ``n`` distinct ones.

    A share of the hash space is cut first, so that what tasks send to the driver depends on ``k``, not on their number.
    """
    at = F.pmod(F.xxhash64(h), F.lit(2**32))
    return distinct_by(df.where(at < hash_share(k, n)), h, label).orderBy(F.xxhash64(h), h).limit(k)


def join_hot(large: DataFrame, small: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``large`` left-joined to ``small``, which has a row for each key and in ``weight`` its number of rows in ``large``.

    Rows with hot keys meet a broadcast of those keys alone, so they are neither shuffled nor gathered in a task.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE > total
    rest = large.join(F.broadcast(small.where(hot).select(*on)), on, "left_anti").join(small.where(~hot), on, "left")
    return large.join(F.broadcast(small.where(hot)), on).unionByName(rest)
