"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame operators only).

A sketch is a histogram over logarithmic buckets: value v > 0 falls into bucket ceil(log(v, gamma)), zero into a
bucket of its own, so any quantile is known within a relative error of (gamma - 1) / (gamma + 1). Sketches merge
by adding counts: the (language, source) sketches add up to those of a language and of the whole corpus. Every
group has its fence q75 + max(3 * (q75 - q25), slack), which is shrunk toward that of the level above: with n documents
it counts n, the level above ``weight``. So small groups follow their language, and large ones themselves, without a
size at which anything switches. A document is rejected where a metric lies above its group's fence. A fence, unlike a
fixed quantile, rejects nothing in a group without outliers.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import NOT_WHITE, WHITE, documents, staged

#: Metrics of a document with the least distance of their fence from the upper quartile.
METRICS = {"symbol_ratio": 0.02, "dup_line_ratio": 0.2, "repeat_ratio": 0.2, "chars_per_word": 4.0}
GAMMA, WEIGHT = 1.02, 200
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text counts as empty.

    Five-word windows are compared within their document by a 64-bit hash. Each step is a column of its own, as
    the steps refer several times to the one before.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", F.regexp_extract_all(t, F.lit(f"({NOT_WHITE}+)"), 1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_WHITE))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, f"{WHITE}+", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_l": lines,
        "_s": F.when(F.size("_w") >= 5, F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(F.col("_w"), i + k) for k in range(1, 5))))).otherwise(F.array().cast("array<bigint>")),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_o": F.when(F.size(F.array_distinct("_s")) < F.size("_s"), F.sort_array(F.transform("_s", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    same = lambda x, k: F.coalesce(F.get(F.col("_o"), k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.when(F.col("_o").isNotNull(), F.sort_array(F.transform(F.filter("_o", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_p", lambda i, k: F.least(F.lit(5), F.coalesce(F.get(F.col("_p"), k + 1) - i, F.lit(5)))), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_w", "_l", "_s", "_o", "_p")


def metrics() -> dict[str, Column]:
    w = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / w,
        "chars_per_word": F.col("word_chars") / w,
    }


def sketch(df: DataFrame, keys: list[str], names: list[str], gamma: float = GAMMA) -> DataFrame:
    """One row (keys, metric, bucket, n) for each occupied bucket; summing n over any keys merges sketches."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names))).alias("x")
    bucket = F.when(F.col("x.v") > 1e-9, F.ceil(F.log(F.col("x.v")) / math.log(gamma)).cast("int")).otherwise(F.lit(-(2**30)))
    return df.select(*keys, each).where(F.col("x.v").isNotNull()).groupBy(*keys, F.col("x.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sk: DataFrame, keys: list[str], qs: dict[str, float], gamma: float = GAMMA) -> DataFrame:
    """(keys, metric, rows, one column for each q): the middle of the bucket that holds the q-quantile."""
    merged = sk.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    merged = merged.withColumns({"_c": F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("n").over(by)})
    middle = F.when(F.col("bucket") == -(2**30), F.lit(0.0)).otherwise(F.exp(F.col("bucket") * math.log(gamma)) * (2 / (1 + gamma)))
    return merged.groupBy(*keys, "metric").agg(F.first("_t").alias("rows"), *(F.min(F.when(F.col("_c") >= q * F.col("_t"), F.struct("bucket", middle.alias("v"))))["v"].alias(k) for k, q in qs.items()))


def thresholds(sk: DataFrame, levels: list[list[str]], weight: int = WEIGHT) -> DataFrame:
    """One row for each combination of the finest level's keys with a column ``max_<metric>`` for every metric.

    ``levels`` runs from fine to coarse, each a prefix of the one before; the last may be empty (whole corpus).
    """
    slack = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))
    out = sk.select(*levels[0]).distinct().withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    for k, keys in enumerate(levels):
        q = quantiles(sk, keys, {"q25": 0.25, "q75": 0.75})
        q = q.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("metric").alias("_m"), F.col("rows").alias(f"_n{k}"), (F.col("q75") + F.greatest(3 * (F.col("q75") - F.col("q25")), slack[F.col("metric")])).alias(f"_t{k}"))
        on = [F.col("metric") == F.col("_m"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys)]
        out = out.join(q, reduce(lambda a, b: a & b, on), "left").drop("_m", *(f"_{c}" for c in keys))
    best = F.col(f"_t{len(levels) - 1}")
    for k in reversed(range(len(levels) - 1)):
        best = (F.col(f"_n{k}") * F.col(f"_t{k}") + weight * best) / (F.col(f"_n{k}") + weight)
    return out.groupBy(*levels[0]).agg(*(F.max(F.when(F.col("metric") == m, best)).alias(f"max_{m}") for m in METRICS))


def apply_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",), weight: int = WEIGHT) -> DataFrame:
    """The columns ``keep``, the base counts, base_failed and kept for every row of ``df``.

    Null text: zero counts, so base_failed. Null language or source: a group of its own. Repeated rows each get
    a row. An empty table gives an empty result. Other columns of ``df`` are not looked at.
    """
    ids = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    df = df.select(*ids, F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    df = base_counts(df, "_text").withColumn("n_lines", F.size(F.split(F.coalesce("_text", F.lit("")), "\n", -1))).drop("_text")
    df = staged(df.withColumns(metrics()), "quality-rules")
    limits = thresholds(sketch(df, ["_lang", "_source"], list(METRICS)), [["_lang", "_source"], ["_lang"], []], weight)
    limits = limits.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    df = df.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    outside = reduce(lambda a, b: a | b, (F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False)) for m in METRICS))
    return df.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~outside).alias("kept"), *METRICS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir)).drop(*METRICS)
