"""Whole entries over logs that still grow.

A log arrives in pieces, one file each, cut anywhere between lines. Within a block of a piece, entries that end before
another one starts are complete and pass on at once, without state or shuffle. What is left of a block are its edges: the
lines before its first start, and its last entry. These meet by log, in a state that holds the entry still open: the
next block's first lines continue it, the next start closes it, and so does a timer once the log has been silent. Lines of
an open entry are kept as a list of chunks that is only appended to, so a long one is not rewritten with each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timberline.operators.parse import recognize_lines
from timberline.options import ParseOptions

START = "timestamp_ms bigint, raw_timestamp string, timestamp_format string, severity string, message string, matched boolean"
PLACE = "log string, path string, block bigint, line bigint"
SEGMENT = f"{PLACE}, kind string, {START}, lines string, n bigint"
ENTRY = f"{PLACE}, {START}, lines string, n_lines bigint"
NAMES = [c.split(" ")[0] for c in SEGMENT.split(", ")]
FIELDS = [c.split(" ")[0] for c in START.split(", ")]
#: What the state store must be for state with timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
ARROW = pa.schema([(n, TYPES[t]) for n, t in (c.split(" ") for c in SEGMENT.split(", "))])


def read_pieces(spark: SparkSession, folder: str, log: str, files_per_batch: int | None = None) -> DataFrame:
    """New lines of the text files under a folder, as (log, path, block, line); group 1 of ``log`` in a path names its log.

    Of one log, pieces are read in the order of their paths within a batch, and batch after batch as they arrive. All new
    files are one batch: cut to ``files_per_batch``, Spark takes the oldest by time of modification, so set it only where
    the pieces of a log were last modified in the order of their paths.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    raw = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(folder)
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, log, 1).alias("log"), path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("line"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SEGMENT from lines in the order of their blocks: ``whole`` entries, and ``head`` and ``tail`` of each block."""
    block, at, kind, start, lines, done = None, 0, "head", None, [], []
    nothing = (None,) * (len(FIELDS) - 1)

    def cut(now: str) -> None:
        if lines:
            place, fields = start
            done.append((*block, place, now, *fields, "\n".join(lines), len(lines)))

    for b in batches:
        columns = [b.column(n).to_pylist() for n in ("log", "path", "block", "line", "r")]
        for log, path, offset, line, r in zip(*columns, strict=True):
            if block != (log, path, offset):
                cut("tail" if kind == "tail" else "head")
                block, at, kind, start, lines = (log, path, offset), 0, "head", (1, (*nothing, False)), []
            at += 1
            if r is not None and r["ms"] is not None:
                cut("whole" if kind == "tail" else "head")
                kind, start, lines = "tail", (at, (r["ms"], r["raw"], r["format"], r["severity"], r["message"], True)), []
            lines.append(line)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), ARROW, strict=True)], schema=ARROW)
            done.clear()
    cut("tail" if kind == "tail" else "head")
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), ARROW, strict=True)], schema=ARROW)


class OpenEntries(StatefulProcessor):
    """Of each log the entry that is still open. ``idle_ms`` without a new line closes it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", f"path string, block bigint, line bigint, {START}")
        self.chunks = handle.getListState("chunks", "lines string, n bigint")

    def _close(self, key, opened: tuple, chunks: list[tuple]) -> tuple:
        return (*key, *opened, "\n".join(c for c, _ in chunks), sum(n for _, n in chunks))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        edges = pd.concat(list(rows)).sort_values(["path", "block", "kind"])  # head before tail; two rows a block
        opened = tuple(self.opened.get()) if self.opened.exists() else None
        kept, more, done = opened is not None, [], []  # kept: the entry is that of the state, and its chunks are there
        for edge in edges.astype(object).where(edges.notna(), None).itertuples(index=False):
            chunk = (edge.lines, int(edge.n))
            if opened is not None and edge.kind == "head":
                more.append(chunk)
                continue
            if opened is not None:
                done.append(self._close(key, opened, ([tuple(c) for c in self.chunks.get()] if kept else []) + more))
            start = [getattr(edge, f) for f in FIELDS]
            opened, kept, more = (edge.path, int(edge.block), int(edge.line), None if start[0] is None else int(start[0]), *start[1:-1], bool(start[-1])), False, [chunk]
        if kept:
            self.chunks.appendList(more)
        else:
            self.opened.update(opened)
            self.chunks.put(more)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = []
        if self.opened.exists():
            done.append(self._close(key, tuple(self.opened.get()), [tuple(c) for c in self.chunks.get()]))
            self.opened.clear()
            self.chunks.clear()
        yield _frame(done)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ENTRY.split(", ")], dtype=object)
    return out.astype({"block": "int64", "line": "int64", "n_lines": "int64", "matched": "bool", "timestamp_ms": "Int64"})


def entry_stream(lines: DataFrame, options: ParseOptions = ParseOptions(), idle_ms: int = 10_000) -> DataFrame:
    """Entries (ENTRY, lines as an array) of a stream of lines (log, path, block, line), each once it is complete.

    path, block and line say where an entry starts, line counting from 1 in its block. Lines before a log's first start
    are one entry with matched = false, as are those that come after silence closed the entry they belong to. Of each
    block of a log its first lines and its last entry meet in one task. The session's state store must be PROVIDER. With a
    trigger that ends (availableNow) set spark.sql.streaming.noDataMicroBatches.enabled to false: else Spark goes on to wait
    for timers without end.
    """
    r = recognize_lines(lines, options)
    segments = r.select("log", "path", "block", "line", F.struct("r.ms", "r.raw", "r.format", "r.severity", "r.message").alias("r")).mapInArrow(_segments, SEGMENT)
    columns = [c.split(" ")[0] for c in ENTRY.split(", ")[:-1]]
    whole = segments.where("kind = 'whole'").select(*columns, F.col("n").alias("n_lines"))
    edges = segments.where("kind <> 'whole'").groupBy("log").transformWithStateInPandas(OpenEntries(idle_ms), ENTRY, "Append", "ProcessingTime")
    e = whole.unionByName(edges).withColumn("lines", F.split("lines", "\n", -1))
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    return e.withColumn("message", F.array_join(F.concat(F.array(F.coalesce(F.col("message"), F.col("lines")[0])), rest), "\n")).drop("n_lines")
