"""Benchmark decontamination by a prefix-filtered set join (DataFrame operators only).

An item's text is cut into windows of ``window`` words (a shorter item is one window). A window is the set of its
overlapping shingles; it occurs in a document only if all of them do, so one of them, the rarest in the corpus, is a
sufficient prefix. The steps: match document shingles with benchmark shingles, count how often each one occurs, join
each window to the matches of its rarest shingle, bound start and end by the window's offset and the document's
length, and compare the words themselves over the item-sized window.

The benchmark's shingles are sent to every executor, ``max_broadcast`` of them (16 bytes each) at a time; a larger
benchmark is worked off in several blocks, each over all documents. Documents are never moved: only matches are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import az_lower, documents, row_key, staged

#: Word characters once A-Z are lower-cased, which here includes A-Z as they stand in the text.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 5
SENTINEL = -1


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def _shingles(w: str, size: int) -> Column:
    """64-bit hashes of the word shingles of an array column; folded fully, which only adds candidates."""
    n = F.size(w) - size + 1
    return F.when(n >= 1, F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(F.lit(size), x, *(F.get(F.col(w), i + k) for k in range(1, size))))).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 13) -> DataFrame:
    """(item, size, win: words, s: shingle size, sh: shingles) for every distinct window of every item."""
    b = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    b = b.withColumn("size", F.least(F.size("w"), F.lit(window)))
    b = b.select("item", "size", F.posexplode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("_", "at"), "w")
    b = b.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("raw")).withColumn("low", F.transform("raw", F.lower)).withColumn("win", F.transform("raw", az_lower))
    b = b.withColumn("s", F.least(F.col("size"), F.lit(SHINGLE)))
    sh = reduce(lambda a, k: F.when(F.col("s") == k, _shingles("low", k)).otherwise(a), range(1, SHINGLE), _shingles("low", SHINGLE))
    return b.withColumn("sh", sh).select("item", "size", "win", "s", "sh").distinct()


def matches(docs: DataFrame, shingles: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """One pass over the documents: a row for each occurrence of a benchmark shingle, and a sentinel for each document."""
    d = docs.withColumn("w", words(F.col("_text"))).drop("_text").withColumn("low", F.transform("w", F.lower))
    for k in sizes:
        d = d.withColumn(f"s{k}", _shingles("low", k))
    ends = [sum((F.size(f"s{k}") for k in sizes[: i + 1]), F.lit(0)) for i in range(len(sizes))]
    d = d.select("_id", "_key", "w", F.size("w").alias("n"), *(e.alias(f"e{i}") for i, e in enumerate(ends)), F.posexplode(F.concat(*(F.col(f"s{k}") for k in sizes), F.array(F.lit(SENTINEL).cast("bigint")))).alias("p", "h"))
    at = reduce(lambda a, i: F.when(F.col("p") < F.col(f"e{i}"), F.col("p") - (F.col(f"e{i - 1}") if i else 0)).otherwise(a), range(len(sizes) - 1, -1, -1), F.lit(-1))
    d = d.join(F.broadcast(shingles), "h").withColumn("at", at)
    left = F.greatest(F.col("at") - window + 1, F.lit(0))
    return d.select("_id", "_key", F.col("n").cast("long").alias("n"), "h", "at", left.alias("left"), F.when(F.col("at") >= 0, F.slice("w", left + 1, 2 * window)).alias("near"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, max_broadcast: int = 2_000_000, keys: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated), one row for each row of ``docs``; other columns are ignored.

    Null or wordless text: n_words 0, not contaminated. Null ids are kept; repeated rows each get a row. Items
    without words match nothing; items with equal text each count. ``items`` lists the ids of the items of which a
    window occurs, as sorted strings (a null id as "null"). Empty documents give an empty result, an empty
    benchmark gives no hits. With ``keys`` a last column ``row_key`` tells rows of one id apart by their text.
    """
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), row_key(doc_id, text).alias("_key"))
    win = staged(windows(benchmark, item, item_text, window), "decontaminate-windows")
    shingles = win.select(F.explode("sh").alias("h")).where(F.col("h") != SENTINEL).distinct()
    facts = win.agg(F.sum(F.size("sh")).alias("n"), F.collect_set("s").alias("sizes")).first()
    sizes, blocks = sorted(facts["sizes"]) or [SHINGLE], 1 + (facts["n"] or 0) // max_broadcast
    found = None
    for b in range(blocks):
        own = shingles.where(F.pmod("h", F.lit(blocks)) == b)
        own = own.unionByName(docs.sparkSession.range(1).select(F.lit(SENTINEL).cast("bigint").alias("h"))) if b == 0 else own
        part = matches(d, own, sizes, window)
        found = part if found is None else found.unionByName(part)
    found = staged(found, "decontaminate-matches")
    seen = found.where(F.col("at") >= 0)
    often = seen.groupBy("h").agg(F.count("*").alias("often"))
    each = win.withColumn("id", F.monotonically_increasing_id())
    each = each.select("item", "size", "win", "id", F.size("sh").alias("of"), F.posexplode("sh").alias("offset", "h")).join(often, "h")
    rarest = F.min_by(F.struct("h", "offset"), F.struct("often", "offset")).alias("r")
    each = each.groupBy("item", "size", "win", "id", "of").agg(F.count("*").alias("have"), rarest).where(F.col("have") == F.col("of"))
    each = each.select("item", "size", "win", F.col("r.h").alias("h"), F.col("r.offset").alias("offset"))
    hits = seen.join(each, "h").withColumn("start", F.col("at") - F.col("offset"))
    hits = hits.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    hits = hits.where(F.transform(F.slice("near", F.col("start") - F.col("left") + 1, F.col("size")), az_lower) == F.col("win"))
    hits = hits.groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("null"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    hits = hits.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), F.size(covered).cast("long").alias("hit"), F.array_sort("items").alias("items"))
    out = found.where(F.col("at") < 0).select("_id", "_key", "n")
    out = out.join(hits, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(F.col("_id").alias(doc_id), F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n"))).alias("contaminated"), *([F.col("_key").alias("row_key")] if keys else []))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
