"""Sources: files, folders, texts in memory and tables become a table of files, then of lines."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.options import Rule
from timberline.sources.storage import staged

FILES = "file_index int, file_name string, path string, text string"
# What rotation adds to a file's name.
DATE_SUFFIX = re.compile(r"[-_.]?[0-9]{4}[-_]?[0-9]{2}[-_]?[0-9]{2}(?:[-_]?[0-9]{2}[-_]?[0-9]{2}(?:[-_]?[0-9]{2})?)?[-_.]?$")
NUMBER_SUFFIX = re.compile(r"[-_.][0-9]+$")
# editors' names of encodings and the codecs that read them.
ENCODINGS = {
    "utf8": "utf-8", "utf8bom": "utf-8", "utf16le": "utf-16-le", "utf16be": "utf-16-be",
    "windows1252": "cp1252", "iso88591": "cp1252", "iso88593": "iso8859_3", "iso885915": "iso8859_15", "macroman": "mac_roman",
    "windows1256": "cp1256", "iso88596": "iso8859_6", "windows1257": "cp1257", "iso88594": "iso8859_4", "iso885914": "iso8859_14",
    "windows1250": "cp1250", "iso88592": "iso8859_2", "windows1251": "cp1251", "cp866": "cp866", "iso88595": "iso8859_5",
    "koi8r": "koi8_r", "koi8u": "koi8_u", "iso885913": "iso8859_13", "windows1253": "cp1253", "iso88597": "iso8859_7",
    "windows1255": "cp1255", "iso88598": "iso8859_8", "windows1254": "cp1254", "iso88599": "cp1254", "windows1258": "cp1258",
    "gbk": "gb18030", "gb18030": "gb18030", "cp950": "big5hkscs", "big5hkscs": "big5hkscs", "shiftjis": "cp932", "eucjp": "euc_jp",
    "iso2022jp": "iso2022_jp", "euckr": "cp949", "windows874": "cp874", "iso885910": "iso8859_10", "iso885916": "iso8859_16",
}
EXTENSION = re.compile(r"(?<=[^.])\.[^./]+$")
LINE_ENDS = r"\r\n|\r|\n"


def _unrotated(name: str) -> str:
    while True:
        shorter = next((s for p in (DATE_SUFFIX, NUMBER_SUFFIX) if (s := p.sub("", name)) and s != name), None)
        if shorter is None:
            return name
        name = shorter


@lru_cache(maxsize=65536)
def file_kind(name: str) -> str:
    """A file's name without dates, rotation numbers and extension; never empty unless the name is."""
    name = _unrotated(name)
    base = EXTENSION.sub("", name) or name
    return _unrotated(base) or base


def _kinds(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else file_kind(n))


def kind_of(name: str) -> Column:
    """The kinds of the files named in a column."""
    return F.pandas_udf(_kinds, "string")(name)


def select_new(paths: list[str], have: list[str]) -> list[str]:
    """Paths not yet chosen, each once, in order."""
    return list(dict.fromkeys(p for p in paths if p not in set(have)))


def codec_of(encoding: str) -> str:
    """The codec of a configured encoding; what is not supported is read as UTF-8, with a warning."""
    found = ENCODINGS.get(encoding.lower())
    if found is None:
        warnings.warn(f"encoding {encoding!r} is not supported, the file is read as UTF-8", stacklevel=2)
    return found or "utf-8"


def _text_of(content: Column, codec: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else bytes(b).decode(codec, "replace")), "string")(content)


def decoded(content: Column, encoding: str = "utf8") -> Column:
    """Text of bytes, without a leading byte order mark; bad bytes become replacement characters."""
    return F.regexp_replace(_text_of(content, codec_of(encoding)), "^\ufeff", "")


def _status(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, p, fs.getFileStatus(p)


def without_folders(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are files, in order."""
    return [p for p in paths if not _status(spark, p)[2].isDirectory()]


def _ends_open(spark: SparkSession, path: str, codec: str = "utf-8") -> bool:
    """Whether a file's last character is a line end, so that an empty line follows it. One character is read."""
    fs, p, status = _status(spark, path)
    size = 2 if codec in WIDE else 1
    if status.getLen() < size:
        return False
    f = fs.open(p)
    try:
        f.seek(status.getLen() - size)
        return bytes(f.read() for _ in range(size)).decode(codec, "replace") in ("\n", "\r")
    finally:
        f.close()


def read_files(spark: SparkSession, paths: list[str], encoding: str = "utf8") -> DataFrame:
    """One row for each path, in the given order, also for empty files. file_index is the place in ``paths``."""
    if not paths:
        return spark.createDataFrame([], FILES)
    order = spark.createDataFrame([(i, p, p.rstrip("/").rsplit("/", 1)[-1]) for i, p in enumerate(paths)], "file_index int, path string, file_name string")
    found = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.col("content").alias("_content"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    out = order.join(found, plain == F.col("_path"), "left")
    return out.select("file_index", "file_name", "path", F.coalesce(decoded(F.col("_content"), encoding), F.lit("")).alias("text"))


def from_texts(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """Texts in memory, as (name, text)."""
    return spark.createDataFrame([(i, n, n, t) for i, (n, t) in enumerate(texts)], FILES)


def with_settings(files: DataFrame, offsets: list[Rule] | None = None, skews: list[Rule] | None = None, default_offset: int = 0) -> DataFrame:
    """Adds source_offset_min and skew_ms: of the first rule whose pattern is found in the file's name, else the default."""

    def first(rules: list[Rule], default: int) -> Column:
        if not rules:
            return F.lit(default)
        find = F.pandas_udf(lambda s: s.map(lambda n: next((r.value for r in rules if re.search(r.pattern, n)), default)), "bigint")
        return find("file_name")

    return files.withColumns({"source_offset_min": first(offsets or [], default_offset).cast("int"), "skew_ms": first(skews or [], 0).cast("bigint")})


def split_lines(files: DataFrame) -> DataFrame:
    """(file_index, line_no, line), numbered from 1. Empty text has no lines; a final line end leaves an empty line."""
    return files.where(F.col("text") != "").select("file_index", F.posexplode(F.split("text", LINE_ENDS, -1)).alias("_i", "line")).select("file_index", (F.col("_i") + 1).cast("bigint").alias("line_no"), "line")


#: Two bytes a unit, so that a byte of a line feed may be part of another character.
WIDE = {"utf-16-le": "\n\x00", "utf-16-be": "\x00\n"}
#: Shifts that last until they are undone: such texts are decoded whole.
SHIFTING = ("iso2022_jp",)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _byte_lines(spark: SparkSession, paths: list[str], codec: str) -> DataFrame:
    """(_path, _block, bytes): the files cut at line feeds by Spark's reader, which does not look at the bytes between."""
    reader = spark.read.option("lineSep", WIDE[codec]) if codec in WIDE else spark.read
    return reader.text(paths).select(_plain(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value"))


#: Bytes of files that one task decodes, whatever the splits that they are read in.
DECODED_AT_ONCE = 32 * 1024 * 1024


def _cut_lines(spark: SparkSession, paths: list[str], codec: str, size: int) -> tuple[DataFrame, set[str]]:
    """(_path, _block, _id, line) with ids that count on within a block; and of files of two bytes a unit those where a cut
    may lie within a unit.

    What is decoded is written, so that ``size`` bytes are read and decoded once, by tasks of many splits each.

    The first line of a file starts at a unit, and each line where the one before ended, block after block. So if all lines
    have an even length every cut is between units; and a cut within a unit leaves a line of odd length before it.
    """
    raw = _byte_lines(spark, paths, codec)
    if codec == "utf-8":
        raw = raw.select("_path", "_block", F.make_valid_utf8("value").alias("line"))
        return raw.withColumn("_id", F.monotonically_increasing_id()), set()
    raw = raw.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // DECODED_AT_ONCE)))
    seen, odd = Observation(), F.when(F.octet_length("value") % 2 == 1, F.col("_path"))
    raw = raw.observe(seen, F.collect_set(odd).alias("odd"))
    if codec not in WIDE:
        raw = raw.select("_path", "_block", _text_of(F.col("value").cast("binary"), codec).alias("line"))
    else:  # Spark cut at line feeds alone
        text = F.regexp_replace(_text_of(F.col("value").cast("binary"), codec), "\r\\z", "")
        raw = raw.select("_path", "_block", F.explode(F.split(text, "\r", -1)).alias("line"))
    raw = staged(raw.withColumn("_id", F.monotonically_increasing_id()), "cut-lines")
    found = set(seen.get["odd"] or []) if codec in WIDE else set()
    return raw, {p for p in paths if re.sub("^file:/+", "/", p) in found}


def open_files(spark: SparkSession, paths: list[str], encoding: str = "utf8") -> tuple[DataFrame, DataFrame]:
    """(files, lines) of files of any size: (file_index, file_name, path) and (file_index, line_no, line).

    Files are read in blocks by Spark's line reader, so that a large one is no single row or task. It cuts at the bytes of
    line ends, which in all encodings of one byte, and in those of more that keep ASCII apart, are nothing else; each line
    is then decoded by itself, and what is decoded is written here. UTF-16 is cut at its own line feeds; files where a cut
    falls within a unit are found on the way, and these alone, and encodings with lasting shifts, are read whole. In UTF-16 lines that only carriage returns end
    come in one row of the reader.

    Lines are numbered by the counts of the blocks before and the place within the block. As with whole texts, a final line
    end leaves an empty line, and an empty file has none.
    """
    codec = codec_of(encoding)
    named = [(i, p.rstrip("/").rsplit("/", 1)[-1], p, _ends_open(spark, p, codec)) for i, p in enumerate(paths)]
    files = spark.createDataFrame(named, "file_index int, file_name string, path string, open boolean")
    none = spark.createDataFrame([], "file_index int, line_no bigint, line string")
    raw, whole = (None, set(paths)) if codec in SHIFTING or not paths else _cut_lines(spark, paths, codec, sum(_status(spark, p)[2].getLen() for p in paths))
    cut = [p for p in paths if p not in whole]
    order = F.broadcast(files.select("file_index", _plain(F.col("path")).alias("_path"), "open"))  # a row for each chosen path
    lines = none
    if cut:
        raw = raw.where(~F.col("_path").isin([re.sub("^file:/+", "/", p) for p in whole])) if whole else raw
        blocks = raw.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        along = Window.partitionBy("_path").orderBy("_block")
        blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        lines = raw.join(blocks.select("_path", "_block", "_first", "_before"), ["_path", "_block"]).join(order, "_path")
        lines = lines.select("file_index", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")
        if codec != "utf-8":  # the line reader knows that mark alone
            lines = lines.withColumn("line", F.when(F.col("line_no") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
        last = blocks.groupBy("_path").agg(F.sum("_n").alias("_n")).join(order, "_path").where("open").select("file_index", (F.col("_n") + 1).alias("line_no"), F.lit("").alias("line"))
        lines = lines.unionByName(last)
    if whole:
        texts = read_files(spark, sorted(whole), encoding).drop("file_index").withColumn("_path", _plain(F.col("path"))).join(order, "_path")
        lines = lines.unionByName(split_lines(texts))
    return files.drop("open"), lines
