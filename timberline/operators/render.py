"""Entries as rows of text, each with the source line it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions.masks import HOST, TIMESTAMP, mask_copy, mask_hosts, mask_message
from timberline.functions.timestamps import display_time
from timberline.operators.ordering import block_of, with_running_sums
from timberline.operators.timeline import groups, laid_out, with_gap_rows, with_gaps
from timberline.options import COPY_MASK, Display, Mask
from timberline.sources.storage import staged

UNKNOWN, GAP_LABEL, BAR, MORE = "-", "...", " | ", ", etc."


def pad(text: Column, width: int) -> Column:
    """``text`` filled up with spaces on the right; never cut."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))))


def gutter(label: Column, width: int) -> Column:
    label = label.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(label), F.lit(0))), label, F.lit(BAR))


def measures(entries: DataFrame) -> list[Column]:
    """Aggregates from which the widths of columns follow, and the number of lines; also for an Observation."""
    timed = F.col("matched") & F.col("timestamp_ms").isNotNull()
    named = lambda n: F.max(F.length(n)) if n in entries.columns else F.max(F.lit(0))
    return [F.max(F.col("start_line") + F.size("lines") - 1).alias("line"), F.max(F.when(timed, F.length(F.coalesce("severity", F.lit(UNKNOWN))))).alias("severity"), named("file_name").alias("file"), named("kind").alias("kind"), F.sum(F.size("lines")).alias("lines")]


def widths_of(measured: dict) -> dict[str, int]:
    return {"gutter": len(str(measured["line"] or 0)), **{n: measured[n] or 0 for n in ("severity", "file", "kind")}}


def widths(entries: DataFrame) -> dict[str, int]:
    """The widths of columns; one small row that every task needs."""
    return widths_of(entries.agg(*measures(entries)).first().asDict())


def shown_time(ms: Column, d: Display) -> Column:
    return F.when(ms.isNotNull(), F.lit(TIMESTAMP)) if d.mask.timestamp else display_time(ms, d.offset_min, d.zone)


def with_parts(entries: DataFrame, d: Display, severity_width: int) -> DataFrame:
    """Adds _time, _lines (shown message lines), _head (text before the message) and _indent (of further lines)."""
    time = F.when(F.col("matched"), shown_time(F.col("timestamp_ms"), d))
    df = entries.withColumns({"_time": time, "_lines": mask_message(F.col("message"), F.col("timestamp_format"), d.mask)})
    head = F.when(F.col("_time").isNull(), "").otherwise(F.concat("_time", F.lit(" "), pad(F.coalesce("severity", F.lit(UNKNOWN)), severity_width), F.lit(" ")))
    return df.withColumn("_head", head).withColumn("_indent", F.repeat(F.lit(" "), F.length("_head")))


def _rows(df: DataFrame, texts: Column) -> DataFrame:
    """(row_no, text, source) from an array of (text, line) per entry; the numbers come from sums over entries."""
    df = df.withColumn("_rows", texts)
    df = df if "_end" in df.columns else with_running_sums(df, {"_end": F.size("_rows")})
    df = df.select("seq", "file_index", (F.col("_end") - F.size("_rows")).alias("_start"), F.posexplode("_rows").alias("_i", "_r"))
    source = F.when(F.col("_r.line").isNotNull(), F.struct(F.col("file_index"), F.col("_r.line").alias("line")))
    return df.select((F.col("_start") + F.col("_i") + 1).alias("row_no"), F.col("_r.text").alias("text"), source.alias("source"))


def _row(text: Column, line: Column | None) -> Column:
    return F.struct(text.alias("text"), (F.lit(None) if line is None else line).cast("bigint").alias("line"))


def _entry_rows(first_prefix, next_prefix, suffix: Column | None = None) -> Column:
    """An entry's rows: the header, then further lines under the message."""

    def one(x: Column, i: Column) -> Column:
        head = F.concat(first_prefix, F.col("_head"), x, *([suffix] if suffix is not None else []))
        return _row(F.when(i == 0, head).otherwise(F.concat(next_prefix(i), F.col("_indent"), x)), F.col("start_line") + i)

    return F.transform("_lines", one)


def _with_gap(rows: Column, prefix: Column) -> Column:
    gap = F.array(_row(F.concat(prefix, F.col("gap_text")), None))
    return F.when(F.col("gap_text").isNull(), rows).otherwise(F.concat(gap, rows))


def normalized(entries: DataFrame, d: Display = Display(), w: dict[str, int] | None = None) -> DataFrame:
    """One file: line number, time, severity, message; a row for each gap. ``w``: the widths, where they are known."""
    w = w or widths(entries)
    df = with_parts(with_gap_rows(entries, d.gap_threshold_ms), d, w["severity"])
    rows = _entry_rows(gutter(F.col("start_line"), w["gutter"]), lambda i: gutter(F.col("start_line") + i, w["gutter"]))
    return _rows(df, _with_gap(rows, gutter(F.lit(GAP_LABEL), w["gutter"])))


def merged(entries: DataFrame, d: Display = Display(), w: dict[str, int] | None = None) -> DataFrame:
    """Several files: name and kind before each header, blanks before other rows. ``w``: the widths, where they are known."""
    w = w or widths(entries)
    df = with_parts(with_gap_rows(entries, d.gap_threshold_ms), d, w["severity"])
    blank = F.lit(" " * w["file"] + BAR + " " * w["kind"] + BAR)
    prefix = F.concat(pad(F.col("file_name"), w["file"]), F.lit(BAR), pad(F.col("kind"), w["kind"]), F.lit(BAR))
    return _rows(df, _with_gap(_entry_rows(prefix, lambda i: blank), blank))


def group_suffix(n: Column, start: Column, end: Column) -> Column:
    """``(xN)``, with the last time where it differs from the first, without the date where that is the same."""
    t = F.position(F.lit("T"), end)
    short = F.when((t > 0) & (F.substr(start, F.lit(1), t - 1) == F.substr(end, F.lit(1), t - 1)), F.substr(end, t + 1)).otherwise(end)
    plain = F.concat(F.lit(" (x"), n.cast("string"))
    return F.when(start.isNull() | end.isNull() | (start == end), F.concat(plain, F.lit(")"))).otherwise(F.concat(plain, F.lit(", ~"), short, F.lit(")")))


def with_groups(entries: DataFrame, d: Display) -> DataFrame:
    """Runs with what a group's header shows: run_len, _first, _last_ms, _last_line, _files, _many_kinds; and is_group.

    Entries that are not laid out yet are, and are written once, as the groups' facts are joined back to them.
    """
    runs = entries if "run_id" in entries.columns else staged(laid_out(entries, d.mask), "laid-out")
    g = groups(runs, d.collapse_threshold).select(F.col("run_id").alias("_run"), F.col("n").alias("run_len"), F.col("first_seq").alias("_first"), F.col("last_ms").alias("_last_ms"), F.col("last_line").alias("_last_line"), F.col("file_indices").alias("_files"), F.col("many_kinds").alias("_many_kinds"))
    return runs.join(g, F.col("run_id") == F.col("_run"), "left").withColumn("is_group", F.col("_run").isNotNull()).drop("_run")


def _suffix(d: Display) -> Column:
    end = F.when(F.col("_time").isNotNull(), shown_time(F.col("_last_ms"), d))
    return F.when(F.col("is_group"), group_suffix(F.col("run_len"), F.col("_time"), end)).otherwise("")


def _range_label() -> Column:
    return F.when(F.col("is_group"), F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("_last_line").cast("string"))).otherwise(F.col("start_line").cast("string"))


def collapsed(entries: DataFrame, d: Display = Display()) -> DataFrame:
    """One file with runs folded: a group shows its first entry, the range of lines, count and last time; no gap rows."""
    w = widths(entries)
    df = with_groups(entries, d).where(~F.col("is_group") | (F.col("seq") == F.col("_first")))
    wide = max(w["gutter"], df.agg(F.max(F.length(_range_label()))).first()[0] or 0)
    df = with_parts(df, d, w["severity"])
    rows = _entry_rows(gutter(_range_label(), wide), lambda i: gutter(F.col("start_line") + i, wide), _suffix(d))
    return _rows(df, rows)


def _parts(entries: DataFrame, d: Display, several_files: bool, max_lines: int) -> tuple[DataFrame, Column, Column, Column]:
    """Entries with their groups, _items (items up to and with theirs) and _spent (rows so far); and their rows, whether they
    head a group, and the text of the header.

    Widths, sums and results each read the entries with their groups, so these are written once, unless a budget of lines
    keeps the results short or the entries are laid out already, as a view's are.
    """
    w = widths(entries)
    df = with_groups(entries, d)
    df = with_parts(df if max_lines > 0 or "run_id" in entries.columns else staged(df, "grouped"), d, w["severity"])
    mark = lambda c, many: F.when(F.col("is_group") & many, F.concat(c, F.lit(MORE))).otherwise(c)
    file_label, kind_label = mark(F.col("file_name"), F.size("_files") > 1), mark(F.col("kind"), F.col("_many_kinds"))
    heads = F.col("is_group") & (F.col("seq") == F.col("_first"))
    if several_files:
        r = df.where(heads).agg(F.max(F.length(file_label)), F.max(F.length(kind_label))).first()
        wf, wk = max(w["file"], r[0] or 0), max(w["kind"], r[1] or 0)
        own = F.concat(pad(F.col("file_name"), wf), F.lit(BAR), pad(F.col("kind"), wk), F.lit(BAR))
        head, first, further = F.concat(pad(file_label, wf), F.lit(BAR), pad(kind_label, wk), F.lit(BAR)), own, lambda i: own
    else:
        wide = max(w["gutter"], df.where(heads).agg(F.max(F.length(_range_label()))).first()[0] or 0)
        head, first, further = gutter(_range_label(), wide), gutter(F.col("start_line"), wide), lambda i: gutter(F.col("start_line") + i, wide)
    n = F.size("_lines")
    df = with_running_sums(df, {"_items": F.when(F.col("is_group"), heads.cast("int")).otherwise(n), "_spent": n + heads.cast("int")})
    df = df.where(F.col("_spent") - n <= max_lines + 1) if max_lines > 0 else df
    rows = F.transform(_entry_rows(first, further), lambda x: F.struct(x["text"].alias("text"), F.struct(F.col("file_index"), x["line"].alias("line")).alias("source")))
    return df, rows, heads, F.when(heads, F.concat(head, F.col("_head"), F.col("_lines")[0], _suffix(d)))


def _single_lines(df: DataFrame, rows: Column) -> DataFrame:
    """(item_no, _x) of the rows of entries outside groups."""
    lines = df.where(~F.col("is_group")).select((F.col("_items") - F.size("_lines")).alias("_before"), F.posexplode(rows).alias("_i", "_x"))
    return lines.select((F.col("_before") + F.col("_i") + 1).alias("item_no"), "_x")


def display_items(entries: DataFrame, d: Display = Display(), several_files: bool = False, max_lines: int = 0) -> DataFrame:
    """(item_no, kind, text, lines, header_file_indices): a line for each row of single entries, a group for each run.

    ``lines`` holds a group's rows (text, source) in order. A group over several files names the first one with
    ", etc."; so does its kind where kinds differ. With ``max_lines`` only what :func:`limit_items` may show is built:
    of longer groups no more rows than tell that they are too long.
    """
    df, rows, _, header = _parts(entries, d, several_files, max_lines)
    lines = _single_lines(df, rows).select("item_no", F.lit("line").alias("kind"), F.col("_x.text").alias("text"), F.array("_x").alias("lines"), F.lit(None).cast("array<int>").alias("header_file_indices"))
    g = df.where("is_group").select("_items", "seq", header.alias("_header"), "_files", rows.alias("_own")).groupBy(F.col("_items").alias("item_no"))
    g = g.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "_own"))), lambda x: x["_own"])).alias("lines"), F.max("_header").alias("text"), F.first("_files").alias("header_file_indices"))
    return lines.unionByName(g.withColumn("kind", F.lit("group")))


def folded_rows(entries: DataFrame, d: Display = Display()) -> DataFrame:
    """(row_no, text, source) of several files with runs folded, groups by their header alone; no group is gathered."""
    df, rows, heads, header = _parts(entries, d, True, 0)
    lines = _single_lines(df, rows).select(F.col("item_no").alias("row_no"), "_x.text", "_x.source")
    return lines.unionByName(df.where(heads).select(F.col("_items").alias("row_no"), header.alias("text"), rows[0]["source"].alias("source")))


def limit_items(items: DataFrame, max_lines: int) -> DataFrame:
    """Items from the first on, as long as they fit in whole; a group costs a row more than its lines.

    If the very first does not fit, its lines are cut to what remains; up to 0 is no limit.
    """
    if max_lines <= 0:
        return items
    cost = F.when(F.col("kind") == "group", F.size("lines") + 1).otherwise(1)
    df = with_running_sums(items, {"_end": cost}, "item_no")
    cut = F.when((F.col("item_no") == 1) & (F.col("_end") > max_lines), F.slice("lines", 1, max(max_lines - 1, 1))).otherwise(F.col("lines"))
    keep = (F.col("_end") <= max_lines) | ((F.col("item_no") == 1) & F.lit(max_lines > 1))
    return df.where(keep).withColumn("lines", cut).drop("_end")


def row_index(laid_out: DataFrame, d: Display = Display()) -> DataFrame:
    """(lo, hi, before, rows) of every block of laid-out entries: their numbers, the rows before and those of its own.

    A small table; with it a row is found without rendering what stands before it.
    """
    df = with_gaps(laid_out, d.gap_threshold_ms).withColumn("_n", F.size(F.split("message", "\n", -1)) + F.col("gap_ms").isNotNull().cast("int"))
    blocks = df.groupBy(block_of().alias("_block")).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum("_n").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("before", before).select("lo", "hi", "before", "rows")


def limit_rows(rows: DataFrame, max_lines: int) -> DataFrame:
    return rows if max_lines <= 0 else rows.where(F.col("row_no") <= max_lines)


def compare_rows(entries: DataFrame) -> DataFrame:
    """Rows for a comparison: line number, no times, masked hosts, neither padding nor indents."""
    w = widths(entries)["gutter"]
    lines = F.transform(F.split("message", "\n", -1), mask_hosts)
    first = F.when(F.col("matched") & (F.col("timestamp_format") == "syslog"), F.regexp_replace(lines[0], r"^\S+", HOST)).otherwise(lines[0])
    timed = F.col("matched") & F.col("timestamp_ms").isNotNull()
    head = F.when(timed, F.concat(F.lit(TIMESTAMP + " "), F.coalesce("severity", F.lit(UNKNOWN)), F.lit(" "), first)).otherwise(first)
    rows = F.transform(lines, lambda x, i: _row(F.concat(gutter(F.col("start_line") + i, w), F.when(i == 0, head).otherwise(x)), F.col("start_line") + i))
    return _rows(entries, rows)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, text, n) of compared rows that one side has more often, without their line numbers."""
    bare = lambda df, side: df.select(F.regexp_replace("text", r"^ *[0-9]+ \| ", "").alias("text"), F.lit(side).alias("side"))
    n = bare(a, 1).unionByName(bare(b, -1)).groupBy("text").agg(F.sum("side").alias("d")).where("d <> 0")
    return n.select(F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), "text", F.abs("d").alias("n"))


def copied_rows(entries: DataFrame, mask: Mask = COPY_MASK) -> DataFrame:
    """The text as it stood, masked."""
    lines = mask_copy(F.col("lines"), F.col("raw_timestamp"), F.col("timestamp_format"), F.col("prefix_len"), mask)
    return _rows(entries, F.transform(lines, lambda x, i: _row(x, F.col("start_line") + i)))


def resolve_source(rows: DataFrame, files: DataFrame, row_no: int) -> DataFrame:
    """(file_index, file_name, path, line) that a row shows; no row for generated ones."""
    r = rows.where((F.col("row_no") == row_no) & F.col("source").isNotNull()).select("source.*")
    return r.join(files.select("file_index", "file_name", "path"), "file_index")
