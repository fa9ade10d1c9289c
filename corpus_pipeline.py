"""A corpus pipeline: quality, line dedup, near duplicates, decontamination, then sampled segmentations.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents``. Rows with nulls go through: a null text has
no lines to lose, no shingles and no benchmark words, and its quality is judged like that of an empty text. Empty tables
give empty tables. Further columns of ``documents`` go through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import documents, row_key, staged
from timberline.llm.decontamination import decontaminate
from timberline.llm.line_dedup import dedup_lines, kept_text
from timberline.llm.ngram_join import ngram_groups
from timberline.llm.piece_sampling import digest, sample_segmentations
from timberline.llm.quality_classifier import classify, labelled


def _id(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted to the labelled rows of ``docs``."""
    model, measured = labelled(spark, sf_dir, docs)
    return classify(docs, model, measured).where("accepted").select(*docs.columns)


def _row(docs: DataFrame):
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that line dedup drops; n_chars follows the text."""
    d = dedup_lines(docs.select("doc_id", "text", _row(docs)))
    d = d.withColumn("text", F.when(F.col("text").isNotNull(), kept_text()))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text").cast("bigint"), F.col("row")["n_chars"])}
    return d.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id (then of least row key) of every group of near duplicates; of repeated rows, one.

    Rows are told apart by id and text, so those that share an id are judged each by its own text.
    """
    g = ngram_groups(docs).select(_id().alias("i"), "row_key", "group", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key").alias("rank"))
    first = g.where("group is not null").groupBy("group").agg(F.min("rank").alias("rank")).select(_id("rank.doc_id").alias("i"), F.col("rank.row_key").alias("k"))
    first = first.unionByName(g.where("group is null").select("i", F.col("row_key").alias("k")).distinct())
    d = docs.select(_row(docs), _id().alias("i"), row_key().alias("k"))
    return d.join(first, ["i", "k"], "left_semi").dropDuplicates(["i", "k"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, each judged by its own text."""
    bad = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=True).where("contaminated")
    d = docs.select(_row(docs), _id().alias("i"), row_key().alias("k"))
    return d.join(bad.select(_id().alias("i"), F.col("row_key").alias("k")).distinct(), ["i", "k"], "left_anti").select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, as digests."""
    return digest(sample_segmentations(docs))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pieces", pieces)]

#: SQL can express neither the classifier nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the whole table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
