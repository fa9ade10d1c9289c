"""One place to open logs and look at them: parse once, then filter, mask, fold and render as often as wanted."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from timberline.functions.masks import mask_keys, mask_patterns
from timberline.functions.patterns import LIMIT_S
from timberline.operators import assess, filters, ordering, render, timeline
from timberline.operators.parse import parse_files
from timberline.options import Criteria, Display, ParseOptions
from timberline.sources import files as source
from timberline.sources.storage import staged


#: Fixed value: bytes from which a result goes to files.
LARGE = 50 * 1024 * 1024


@dataclass(frozen=True)
class View:
    """Numbered entries under criteria, masks and display options. Each view starts from all entries.

    Rows are lazy, unless a match or ignore pattern needs a time limit: then they are written, and if it fails on any entry
    the view is shown without these patterns and :meth:`filter_failure` says why. What folds repeats is made from the view's laid-out entries, which are written once, when first
    asked for; so a whole redraw (:meth:`payload`) writes one table, and further results of the view none.
    """

    entries: DataFrame
    several: bool
    criteria: Criteria = Criteria()
    display: Display = Display()
    mask_key_names: str = ""
    mask_pattern_sources: tuple[str, ...] = ()
    limit_s: float = LIMIT_S
    _made: dict = field(default_factory=dict, repr=False, compare=False)

    def with_criteria(self, criteria: Criteria) -> View:
        return replace(self, criteria=criteria, _made={})

    def filtered(self) -> tuple[DataFrame, str | None]:
        """The entries that meet the criteria, and why match and ignore were left out, if a pattern failed."""
        if "filtered" not in self._made:
            self._made["filtered"] = filters.with_fallback(self.entries, self.criteria, self.limit_s)
        return self._made["filtered"]

    def filter_failure(self) -> str | None:
        """``timeout`` or ``error`` where the view is shown without match and ignore patterns, else None."""
        return self.filtered()[1]

    def shown(self) -> DataFrame:
        """Filtered, then masked entries in order: filters see unmasked text. mask_failure says where a mask failed."""
        e = self.filtered()[0]
        masked = mask_patterns(mask_keys(F.col("message"), self.mask_key_names), self.mask_pattern_sources, self.limit_s)
        e = e.withColumn("_masked", masked)
        return e.withColumns({"message": F.col("_masked.text"), "mask_failure": F.col("_masked.failure")}).drop("_masked")

    def laid_out(self) -> DataFrame:
        """The shown entries numbered without holes, with the time before and their run; written once.

        The widths of columns and the number of lines are observed on the way, so that no later job asks for them.
        """
        if "laid_out" not in self._made:
            seen, e = Observation(), timeline.laid_out(self.shown(), self.display.mask)
            self._made["laid_out"] = staged(e.observe(seen, *render.measures(e)), "laid-out")
            self._made["measured"] = seen.get
        return self._made["laid_out"]

    def _rendered(self, entries: DataFrame) -> DataFrame:
        measured = self._made.get("measured")
        return (render.merged if self.several else render.normalized)(entries, self.display, render.widths_of(measured) if measured else None)

    def rows(self) -> DataFrame:
        return self._rendered(self._made.get("laid_out", self.shown()))

    def first_rows(self) -> DataFrame:
        """The rows within the display's budget. No entry has less than one, so later entries are not read."""
        n = self.display.max_lines
        return self.rows() if n <= 0 else render.limit_rows(self._rendered(self.laid_out().where(F.col("seq") <= n)), n)

    def row_index(self) -> DataFrame:
        """Which entries hold which rows, block by block; written once."""
        if "index" not in self._made:
            self._made["index"] = staged(render.row_index(self.laid_out(), self.display), "row-index")
        return self._made["index"]

    def page(self, first: int, last: int) -> DataFrame:
        """The rows from ``first`` to ``last``. Only the blocks of entries that hold them are read and rendered: their
        numbers are bounds that reach the Parquet scan."""
        inside = (F.col("before") < last) & (F.col("before") + F.col("rows") >= first)
        at = self.row_index().where(inside).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("before")).first()
        entries = self.laid_out().where(F.col("seq").between(at["lo"] or 1, at["hi"] or 0))
        rows = self._rendered(entries)
        return rows.withColumn("row_no", F.col("row_no") + F.lit(at["before"] or 0)).where(F.col("row_no").between(first, last))

    def source_of(self, row_no: int, files: DataFrame) -> DataFrame:
        """(file_index, file_name, path, line) that a row shows; no row for generated ones."""
        return render.resolve_source(self.page(row_no, row_no), files, row_no)

    def items(self) -> DataFrame:
        n = self.display.max_lines
        return render.limit_items(render.display_items(self.laid_out(), self.display, self.several, n), n)

    def mask_failures(self) -> DataFrame:
        """(failure, n): how many entries are shown unmasked, and why; no rows where all masks worked."""
        e = self._made.get("laid_out", self.shown())
        return e.where(F.col("mask_failure").isNotNull()).groupBy(F.col("mask_failure").alias("failure")).agg(F.count("*").alias("n"))

    def export(self, collapsed: bool = False) -> DataFrame:
        """Rows of text. Folded, a group of one file has its message's further lines; of several, its header alone."""
        if not collapsed:
            return self.rows()
        if not self.several:
            return render.collapsed(self.laid_out(), self.display)
        return render.folded_rows(self.laid_out(), self.display)

    def payload(self) -> dict[str, DataFrame]:
        """All parts of a redraw; severities and totals are those before any filter."""
        shown = self.laid_out()
        return {
            "severities": assess.distinct_severities(self.entries),
            "counts": assess.hidden_lines(self.entries, shown),
            "rows": self.first_rows(),
            "items": self.items(),
            "mask_failures": self.mask_failures(),
            "filter_failure": self.entries.sparkSession.range(1).select(F.lit(self.filter_failure()).cast("string").alias("failure")).where("failure IS NOT NULL"),
        }

    def write_text(self, path: str, collapsed: bool = False) -> None:
        """The rows as text files, in order."""
        self.export(collapsed).orderBy("row_no").select("text").write.mode("overwrite").text(path)

    def text_or_files(self, path: str, collapsed: bool = False, limit: int = LARGE) -> tuple[str | None, int]:
        """(text, bytes): the rows as one text where it has less than ``limit`` bytes; else None, and they are in files at
        ``path``. The rows are written once and measured on the way, so that only a small result comes to the driver."""
        seen, rows = Observation(), self.export(collapsed).orderBy("row_no").select("text")
        rows = rows.observe(seen, F.sum(F.octet_length("text") + 1).alias("bytes"))
        rows.write.mode("overwrite").text(path)
        size = max((seen.get["bytes"] or 0) - 1, 0)
        if size >= limit:
            return None, size
        parts = self.entries.sparkSession.read.text(path, wholetext=True).select("value", "_metadata.file_path").collect()
        return "".join(r["value"] for r in sorted(parts, key=lambda r: r["file_path"]))[:-1], size


#: Fixed value: characters from which lines on their way to a digest start a new row.
PACKED = 4096


def md5_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(md5) of the text that :meth:`View.text_or_files` left in files.

    A digest is a chain over the whole text, so one task folds it, holding a batch at a time; all that comes before is
    spread: lines are read in splits and packed where they lie, and only packs are put in order.
    """

    def pack(batches):
        for b in batches:
            out, size = [], PACKED
            for file, block, at, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= PACKED or out[-1][:2] != (file, block):
                    out.append((file, block, at, []))
                    size = 0
                out[-1][3].append(line)
                size += len(line) + 1
            columns = zip(*((*place, "\n".join(lines)) for *place, lines in out), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, b.schema, strict=True)], names=b.schema.names) if out else b

    def fold(batches):
        digest, separator = hashlib.md5(), b""
        for b in batches:
            for text in b.column("line").to_pylist():
                digest.update(separator + text.encode())
                separator = b"\n"
        yield pa.RecordBatch.from_pydict({"md5": [digest.hexdigest()]})

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    packs = lines.mapInArrow(pack, "file string, block bigint, at bigint, line string")
    return packs.repartition(1).sortWithinPartitions("file", "block", "at").select("line").mapInArrow(fold, "md5 string")


class LogSession:
    """Opened files with their settings. They are parsed, sorted and written once, whatever views follow."""

    def __init__(self, spark: SparkSession, options: ParseOptions = ParseOptions(), offsets=None, skews=None):
        self.spark, self.options, self.offsets, self.skews = spark, options, offsets, skews
        self.files: DataFrame | None = None
        self.lines: DataFrame | None = None
        self.n = 0
        self._log: DataFrame | None = None

    def open(self, paths: list[str], encoding: str = "utf8") -> LogSession:
        """Opens files of any size; folders among the paths are left out."""
        paths = source.without_folders(self.spark, source.select_new(paths, []))
        files, lines = source.open_files(self.spark, paths, encoding)
        return self._set(files, len(paths), lines)

    def open_texts(self, texts: list[tuple[str, str]]) -> LogSession:
        return self._set(source.from_texts(self.spark, texts), len(texts))

    def _set(self, files: DataFrame, n: int, lines: DataFrame | None = None) -> LogSession:
        self.files, self.n, self.lines, self._log = source.with_settings(files, self.offsets, self.skews, self.options.source_offset_min), n, lines, None
        return self

    def log(self) -> DataFrame:
        """The numbered entries: of one file in its order, of several by time."""
        if self._log is None:
            e = parse_files(self.files, self.options, self.lines)
            self._log = ordering.by_time(e) if self.n > 1 else ordering.by_line(e)
        return self._log

    def entries(self) -> DataFrame:
        return self.log().drop("seq")

    def view(self, criteria: Criteria = Criteria(), display: Display = Display(), **masks) -> View:
        return View(self.log(), self.n > 1, criteria, display, **masks)

    def recognition(self) -> DataFrame:
        return assess.recognition(self.entries(), self.files)


def compare(spark: SparkSession, left: str, right: str, options: ParseOptions = ParseOptions()) -> tuple[DataFrame, DataFrame]:
    """Two texts as comparable rows; times are masked, so neither offsets nor skews apply."""
    side = lambda t: render.compare_rows(ordering.by_line(parse_files(source.from_texts(spark, [("text", t)]), options)))
    return side(left), side(right)


def copy_masked(spark: SparkSession, text: str, mask=None, options: ParseOptions = ParseOptions()) -> DataFrame:
    e = ordering.by_line(parse_files(source.from_texts(spark, [("text", text)]), options))
    return render.copied_rows(e, mask) if mask else render.copied_rows(e)
