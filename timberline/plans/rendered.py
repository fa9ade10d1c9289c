"""Log lines written from the table ``events``, in every built-in format.

The queries parse these lines back, while their oracles read the columns they were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines kept free for each event, so that line numbers follow from event ids.
STEP = 4
FORMATS = ("iso", "bracketed", "slash", "apache", "epoch", "jsonl")
SEVERITY = {"error": "ERROR", "purchase": "WARN", "signup": "NOTICE", "view": "INFO", "click": "DEBUG"}
#: Spellings that mean the same severities.
SPELLED = {"error": "err", "purchase": "Warning", "signup": "[NOTICE]", "view": "info", "click": "crit"}


def by_type(words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), F.col("event_type"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return e.withColumns({"ms": F.floor(us / 1000), "file_index": (F.col("user_id") % 3).cast("int"), "line_no": F.col("event_id") * STEP + 1, "severity": by_type(SEVERITY), "text": F.col("ts").cast("timestamp_ntz").cast("string")})


def stamp(fmt: str) -> Column:
    """The event's time, to the millisecond where the format has them."""
    day, clock = F.col("text").substr(1, 10), F.col("text").substr(12, 8)
    ms = F.lpad((F.col("ms") % 1000).cast("string"), 3, "0")
    y, mo, d = day.substr(1, 4), day.substr(6, 2), day.substr(9, 2)
    month = F.element_at(F.array(*(F.lit(x) for x in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())), mo.cast("int"))
    iso = F.concat(day, F.lit("T"), clock, F.lit("."), ms)
    return {
        "iso": F.concat(iso, F.lit("Z")),
        "local": iso,
        "bracketed": F.concat(F.lit("["), F.replace(iso, F.lit("T"), F.lit(" ")), F.lit("]")),
        "slash": F.concat(y, F.lit("/"), mo, F.lit("/"), d, F.lit(" "), clock, F.lit(","), ms),
        "apache": F.concat(F.lit("["), d, F.lit("/"), month, F.lit("/"), y, F.lit(":"), clock, F.lit(" +0000]")),
        "epoch": F.col("ms").cast("string"),
        "syslog": F.concat(month, F.lit(" "), F.lpad(d.cast("int").cast("string"), 2, " "), F.lit(" "), clock),
    }[fmt]


def body() -> Column:
    return F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"))


def lines(spark: SparkSession, sf_dir: str, fmt: str = "iso", words: dict[str, str] | None = None, message: Column | None = None) -> DataFrame:
    """(file_index, line_no, line): one line for each event; ``mixed`` takes the formats in turn, some after a field."""
    e, message = events(spark, sf_dir), body() if message is None else message
    level = by_type(words or SEVERITY)
    plain = lambda f: F.concat(stamp(f), F.lit(" "), level, F.lit(" "), message)
    as_json = F.to_json(F.struct(F.concat(stamp("iso")).alias("ts"), level.alias("level"), message.alias("msg"), F.col("user_id")))
    if fmt == "mixed":
        line = F.when(F.col("event_id") % 6 == 5, as_json)
        for i, f in enumerate(FORMATS[:5]):
            line = line.when(F.col("event_id") % 6 == i, F.concat(F.when(F.col("event_id") % 4 == 0, "host=web01 ").otherwise(""), plain(f)))
    else:
        line = as_json if fmt == "jsonl" else plain(fmt)
    return e.select("file_index", "line_no", line.alias("line"))


def with_continuations(first: DataFrame) -> DataFrame:
    """Event k is followed by k % 3 lines of its own."""
    k = ((F.col("line_no") - 1) / STEP).cast("bigint") % 3
    more = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= k), lambda i: F.concat(F.lit("  at frame "), i.cast("string")))
    return first.select("file_index", F.col("line_no"), F.posexplode(F.concat(F.array("line"), more)).alias("i", "x")).select("file_index", (F.col("line_no") + F.col("i")).alias("line_no"), F.col("x").alias("line"))


def with_names(entries: DataFrame) -> DataFrame:
    """Names and kinds for the three files."""
    name = F.element_at(F.array(*(F.lit(x) for x in ("app.log", "web-2024-01-02.log", "db.log"))), F.col("file_index") + 1)
    kind = F.element_at(F.array(*(F.lit(x) for x in ("app", "web", "db"))), F.col("file_index") + 1)
    return entries.withColumns({"file_name": name, "kind": kind})
