"""More registered queries: odd lines, settings, files, sessions with their masks and exports, inferred patterns."""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import masks
from timberline.functions.patterns import compile_python
from timberline.operators import filters, highlight, infer, ordering, render
from timberline.operators.parse import parse_files, parse_lines, recognize_lines
from timberline.options import Criteria, Display, Mask, ParseOptions, Rule, TimestampFormat
from timberline.plans import rendered as log
from timberline.plans.registry import GAP, REFERENCE, RUNS, SECOND, SUFFIX, E, query, single
from timberline.plans.session import LogSession, View, compare, md5_of_files
from timberline.settings import CriteriaForm, compile_criteria, compile_formats, compile_highlights, updated_severities
from timberline.sources import files as source
from timberline.sources.storage import shared_dir
from timberline.streaming import entries


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _chosen(*choices):
    """The choice that an event's number points to, in turn."""
    out = F.when(F.col("event_id") % len(choices) == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(F.col("event_id") % len(choices) == i, c)
    return out


TEXT = ParseOptions(reference_time_ms=1_735_603_200_000, json_lines=False)


def _found(spark, sf_dir, line, options: ParseOptions = ParseOptions(reference_time_ms=1_735_603_200_000)) -> DataFrame:
    """What each event's line is recognised as, line by line."""
    lines = log.events(spark, sf_dir).select("file_index", "line_no", line.alias("line"))
    return recognize_lines(lines, options).select("line_no", F.col("r.ms").alias("timestamp_ms"), F.col("r.format").alias("timestamp_format"), F.col("r.severity").alias("severity"), F.col("r.message").alias("message"))


@query("parse_jsonl_odd", rf"""{E} SELECT line_no, CASE event_id % 8 WHEN 1 THEN NULL WHEN 6 THEN NULL ELSE ms END AS timestamp_ms, CASE event_id % 8 WHEN 1 THEN NULL WHEN 6 THEN NULL ELSE 'json-lines' END AS timestamp_format,
    CASE event_id % 8 WHEN 0 THEN 'WARN' WHEN 2 THEN 'WARN' WHEN 3 THEN '35' WHEN 4 THEN severity WHEN 5 THEN NULL WHEN 7 THEN 'INFO' END AS severity,
    CASE event_id % 8 WHEN 0 THEN 'user ' || user_id || ' big=Infinity list=[null,1]'
        WHEN 2 THEN 'message=5 note="two words" empty=null' WHEN 3 THEN chr(65533) || ' half user=' || user_id WHEN 4 THEN 'x ts2="\ud800 y"'
        WHEN 5 THEN 'level={{"n":1}} ok=true' WHEN 7 THEN 'm 1=b b=' || user_id || ' t=late' END AS message FROM e""")
def parse_jsonl_odd(spark, sf_dir):
    """Infinite numbers, halves of surrogate pairs, other fields for time and level, values that are no record."""
    iso, ms, user = log.stamp("iso"), F.col("ms"), F.col("user_id")
    line = _chosen(
        _text('{"time":', ms, ',"severity":"warning","msg":"user ', user, '","big":', "9" * 400, ',"list":[1e999,1.0]}'),
        _text('{"ts":', "9" * 400, ',"time":"', iso, '","msg":"x"}'),
        _text('{"@timestamp":"', iso, '","lvl":"  Warning ","message":5,"note":"two words","empty":null}'),
        _text('{"timestamp":"', iso, '","level":35,"msg":"\\ud800 half","user":', user, "}"),
        _text('{"t":"', iso, '","level":"', F.col("severity"), '","msg":"x","ts2":"\\ud800 y"}'),
        _text('{"ts":"', iso, '","level":{"n":1},"msg":"","ok":true}'),
        _text('["', iso, '"]'),
        _text('{"b":', user, ',"ts":"', iso, '","level":30,"msg":"m","1":"b","t":"late"}'),
    )
    return _found(spark, sf_dir, line)


@query("parse_custom_odd", f"""{E} SELECT line_no, CASE event_id % 8 WHEN 0 THEN {SECOND} WHEN 1 THEN {SECOND} - 5400000 WHEN 2 THEN {SECOND} + 315569520000000 WHEN 3 THEN ms END AS timestamp_ms,
    CASE event_id % 8 WHEN 0 THEN 'own' WHEN 1 THEN 'own' WHEN 2 THEN 'own' WHEN 3 THEN 'own-ms' END AS timestamp_format, CASE WHEN event_id % 8 < 4 THEN severity END AS severity, CASE WHEN event_id % 8 < 4 THEN message END AS message FROM e""")
def parse_custom_odd(spark, sf_dir):
    """Own formats whose groups may hold no digits, take no part or lie beyond the calendar: the match is refused."""
    t, clock = F.col("text"), F.col("text").substr(12, 8)
    y, mo, d = t.substr(1, 4), t.substr(6, 2), t.substr(9, 2)
    tail = _text(" ", F.col("severity"), " ", log.body())
    line = _chosen(
        _text(y, "~", mo, "~", d, " ", clock, tail),
        _text(y, "~", mo, "~", d, " ", clock, "+01:30", tail),
        _text("1", (y.cast("int") - 10000 + 20000 - 10000).cast("string"), "~", mo, "~", d, " ", clock, tail).substr(1, 4000),
        _text("@", F.col("ms"), tail),
        _text("year~", mo, "~", d, " ", clock, tail),
        _text(y, "~~", d, " ", clock, tail),
        _text("@", "7" * 40, tail),
        _text("999999~", mo, "~", d, " ", clock, tail),
    )
    own = [("own", r"(?<y>\w+)~(?<mo>\d*)~(?<d>\d+) (?<h>\d+):(?<mi>\d+):(?<s>\d+)(?:(?<tzs>[+-])(?<tzh>\d{2})(?::(?<tzm>\d{2}))?)?"), ("own-ms", r"@(?<epochMs>\d+)")]
    options = ParseOptions(formats=tuple(TimestampFormat(n, compile_python(p).pattern) for n, p in own))
    return _found(spark, sf_dir, line, options)


def ordinal_instants(m: pd.DataFrame) -> pd.Series:
    """Milliseconds of year, day of the year and clock; a day that the year lacks is none."""
    day = pd.to_datetime(m["y"] + m["doy"], format="%Y%j", errors="coerce")
    ms = (day - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1) + pd.to_timedelta(m["clock"]) // pd.Timedelta(milliseconds=1) - m["offset_min"] * 60_000
    return ms.where(day.dt.year == m["y"].astype(int))


@query("parse_format_function", f"""{E} SELECT line_no, CASE event_id % 4 WHEN 3 THEN NULL ELSE {SECOND} - 3600000 END AS timestamp_ms, CASE event_id % 4 WHEN 1 THEN 'json-lines' WHEN 3 THEN NULL ELSE 'ordinal' END AS timestamp_format,
    CASE WHEN event_id % 4 <> 3 THEN severity END AS severity, CASE event_id % 4 WHEN 0 THEN message WHEN 1 THEN 'x' WHEN 2 THEN 'k=v ' || message END AS message FROM e""")
def parse_format_function(spark, sf_dir):
    """A format with a function of its own: days of the year, at a source offset; a day that does not exist is refused."""
    t, day = F.col("text"), F.lpad(F.dayofyear("ts").cast("string"), 3, "0")
    y, clock, tail = t.substr(1, 4), t.substr(12, 8), _text(" ", F.col("severity"), " ", log.body())
    line = _chosen(_text(y, ".", day, "T", clock, tail), _text('{"ts":"', y, ".", day, "T", clock, '","level":"', F.col("severity"), '","msg":"x"}'), _text("k=v ", y, ".", day, "T", clock, tail), _text(y, ".367T", clock, tail))
    own = TimestampFormat("ordinal", compile_python(r"(?<y>\d{4})\.(?<doy>\d{3})T(?<clock>\d{2}:\d{2}:\d{2})").pattern, ordinal_instants)
    return _found(spark, sf_dir, line, ParseOptions(formats=(own,), source_offset_min=60))


@query("parse_leading_fields", f"""{E} SELECT line_no, CASE WHEN event_id % 8 IN (5, 6, 7) THEN NULL ELSE ms END AS timestamp_ms, CASE WHEN event_id % 8 NOT IN (5, 6, 7) THEN severity END AS severity,
    CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN '[w-' || user_id || '] ' WHEN 2 THEN 'k=' || user_id || ' [x] ' WHEN 3 THEN 'a=1 b=2 c=3 ' WHEN 4 THEN '10.1.2.3 - bob ' END || message AS message
    FROM e""")
def parse_leading_fields(spark, sf_dir):
    """At most three fields of at most 64 characters before a timestamp; a field that goes beyond ends the search."""
    stamp, tail = log.stamp("iso"), _text(" ", F.col("severity"), " ", log.body())
    head = _chosen(
        F.lit(""), _text("[w-", F.col("user_id"), "] "), _text("k=", F.col("user_id"), " [x] "), F.lit("a=1 b=2 c=3 "),
        F.lit("10.1.2.3 - bob "), F.lit("a=1 b=2 c=3 d=4 "), F.lit("k=" + "v" * 62 + " "), F.lit("k=1 " + "m" * 58 + "=2 [a] "),
    )
    stamp = F.when(F.col("event_id") % 8 == 4, log.stamp("bracketed")).otherwise(stamp)
    return _found(spark, sf_dir, _text(head, stamp, tail), TEXT).drop("timestamp_format")


@query("parse_validation", f"{E} SELECT line_no, CASE event_id % 8 WHEN 0 THEN ms - 20700000 WHEN 1 THEN ms + 12600000 WHEN 2 THEN ms - 32400000 WHEN 3 THEN ms END AS timestamp_ms FROM e")
def parse_validation(spark, sf_dir):
    """Written offsets in all spellings; offsets, days, months and clocks that do not exist are no timestamps."""
    iso, t = log.stamp("local"), F.col("text")
    line = _chosen(_text(iso, "+05:45 x"), _text(iso, "-0330 x"), _text(iso, "+09 x"), _text(iso, "z x"), _text(iso, "+14:01 x"), _text("2024-02-30T", t.substr(12, 8), " x"), _text("2024-13-01T", t.substr(12, 8), " x"), _text(t.substr(1, 10), "T24:00:00 x"))
    return _found(spark, sf_dir, line, TEXT).select("line_no", "timestamp_ms")


@query("parse_syslog_year", f"""{E} SELECT line_no, CASE WHEN {SECOND} > 1705276800000 + 86400000 THEN epoch_ms(date_trunc('second', ts) - INTERVAL 1 YEAR) ELSE {SECOND} END AS timestamp_ms FROM e""")
def parse_syslog_year(spark, sf_dir):
    """Lines without a year, read on 2024-01-15: what would lie more than a day ahead is of the year before."""
    return _found(spark, sf_dir, _text(log.stamp("syslog"), " h x"), ParseOptions(reference_time_ms=1_705_276_800_000, json_lines=False)).select("line_no", "timestamp_ms")


@query("clock_skew", f"{E} SELECT line_no AS start_line, file_name, ms + CASE file_index WHEN 1 THEN 1500 WHEN 2 THEN -250 ELSE 0 END AS timestamp_ms, iso || 'Z' AS raw_timestamp FROM e")
def clock_skew(spark, sf_dir):
    """A correction by file name, added to recognised times; the raw text stays."""
    return _with_rules(spark, sf_dir, "iso", skews=[Rule("^web", 1500), Rule("db", -250)]).select("start_line", "file_name", "timestamp_ms", "raw_timestamp")


def _with_rules(spark, sf_dir, fmt, **rules) -> DataFrame:
    files = log.with_names(spark.range(3).select(F.col("id").cast("int").alias("file_index")))
    return parse_files(source.with_settings(files, **rules), lines=log.lines(spark, sf_dir, fmt))


@query("source_offset_again", f"{E} SELECT line_no AS start_line, ms - CASE file_index WHEN 0 THEN 60 WHEN 1 THEN -300 ELSE 0 END * 60000 AS first_ms, ms - 32400000 AS then_ms FROM e")
def source_offset_again(spark, sf_dir):
    """Offsets are resolved anew from the same lines when the rules change."""
    one, two = (_with_rules(spark, sf_dir, "local", offsets=r) for r in ([Rule("app", 60), Rule("^web", -300)], [Rule(".", 540)]))
    return one.select("start_line", F.col("timestamp_ms").alias("first_ms")).join(two.select("start_line", F.col("timestamp_ms").alias("then_ms")), "start_line")


def _log_files(spark, sf_dir, encoding: str = "UTF-8") -> list[str]:
    """The events as text files, sorted, each with two lines more for every event of a click."""
    lines = log.lines(spark, sf_dir).repartitionByRange(4, "line_no").sortWithinPartitions("line_no")
    more = F.when(F.col("line").contains("click"), F.array("line", F.lit("" if encoding == "UTF-8" else "-"), F.lit("  more"))).otherwise(F.array("line"))
    path = f"{shared_dir(spark)}/timberline/log-files-{uuid.uuid4().hex}"
    lines = lines.select(F.explode(more))
    if encoding == "UTF-8":
        lines.write.option("lineSep", "\r\n").text(path)
    else:  # the text writer knows UTF-8 alone
        lines.write.options(encoding=encoding, sep="\x01", quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect())


OPENED = f"""{E} SELECT ms AS timestamp_ms, severity, message || CASE WHEN event_type = 'click' THEN chr(10) || chr(10) || '  more' ELSE '' END AS message,
    CAST(CASE WHEN event_type = 'click' THEN 3 ELSE 1 END AS INTEGER) AS n_lines FROM e"""


def _entries(session: LogSession) -> DataFrame:
    """Entries as they were written: the empty line that ends each file is left out."""
    ends = F.when(F.element_at("lines", -1) == "", 1).otherwise(0)
    return session.entries().select("timestamp_ms", "severity", F.regexp_replace("message", r"\n\z", "").alias("message"), (F.size("lines") - ends).alias("n_lines"))


@query("open_files", OPENED)
def open_files(spark, sf_dir):
    """Files of any size, read in blocks; a folder among the paths is left out."""
    paths = _log_files(spark, sf_dir)
    return _entries(LogSession(spark).open([*paths, paths[0].rsplit("/", 1)[0], paths[0]]))


@query("open_encoded_files", OPENED.replace("chr(10) || chr(10)", "chr(10) || '-' || chr(10)"))
def open_encoded_files(spark, sf_dir):
    """Files of two bytes a unit, each read in several splits."""
    paths = _log_files(spark, sf_dir, "UTF-16LE")
    with _setting(spark, "spark.sql.files.maxPartitionBytes", "64k"):
        session = LogSession(spark).open(paths, "utf16le")  # read, cut and written here
    return _entries(session)


@query("decode_documents", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decode_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return d.select("doc_id", source.decoded(F.encode("text", "UTF-16BE"), "utf16be").alias("text"))


@query("severity_defaults", f"{E} SELECT DISTINCT severity FROM e WHERE file_index > 0 AND severity NOT IN ('DEBUG', 'INFO') UNION SELECT 'OLD'")
def severity_defaults(spark, sf_dir):
    """New severities count as checked when files are added; unchecked ones stay so, and none that is checked is lost."""
    now = {r["severity"] for r in single(spark, sf_dir).select("severity").distinct().collect()}
    return spark.createDataFrame([(s,) for s in updated_severities({"OLD"}, {"DEBUG", "INFO", "OLD"}, now)], "severity string")


@query("pattern_time_limit", f"{E} SELECT line_no AS start_line, CASE WHEN event_id % 1000 = 1 THEN 'timeout' END AS failure, CASE WHEN event_id % 1000 = 1 THEN repeat('a', 40) || 'b' ELSE '<MASKED>' END AS text FROM e")
def pattern_time_limit(spark, sf_dir):
    """A pattern that never ends on some messages leaves these unmasked, and says so."""
    message = F.when(F.col("event_id") % 1000 == 1, "a" * 40 + "b").otherwise("aaa")
    e = single(spark, sf_dir, message=message)
    return e.select("start_line", masks.mask_patterns(F.col("message"), ("(a|aa)+$",), 0.2).alias("m")).select("start_line", "m.failure", "m.text")


#: Every 5,000th message is one that the pattern never ends on; the pattern asks for a time limit wherever it runs.
ENDLESS = r"(a|aa)+$"


def _slow():
    return F.when(F.col("event_id") % 5000 == 1, "a" * 60 + "b").otherwise(log.body())


def _limited_view(spark, sf_dir, form: CriteriaForm, message, **kw) -> View:
    criteria, errors = compile_criteria(form)
    assert not errors
    return View(ordering.by_time(single(spark, sf_dir, message=message)), True, criteria, limit_s=0.2, **kw)


@query("filter_fallback", f"""{E} SELECT row_number() OVER (ORDER BY ms, file_index, line_no) AS row_no, line_no AS source_line, 'timeout' AS failure FROM e WHERE severity IN ('WARN', 'NOTICE') AND
    (SELECT count(*) FROM e WHERE event_id % 5000 = 1 AND severity IN ('WARN', 'NOTICE')) > 0 UNION ALL SELECT row_number() OVER (ORDER BY ms, file_index, line_no), line_no, NULL FROM e WHERE severity IN ('WARN', 'NOTICE') AND user_id <> 7 AND (SELECT count(*) FROM e WHERE event_id % 5000 = 1 AND severity IN ('WARN', 'NOTICE')) = 0""")
def filter_fallback(spark, sf_dir):
    """An ignore pattern that never ends on an entry that the other criteria keep: the view shows what these keep, and says why."""
    v = _limited_view(spark, sf_dir, CriteriaForm(severities=("WARN", "NOTICE"), ignore=((ENDLESS, True), (r"user 7\b", True))), _slow(), display=Display(gap_threshold_ms=0))
    return v.rows().select("row_no", F.col("source.line").cast("bigint").alias("source_line"), F.lit(v.filter_failure()).cast("string").alias("failure"))


@query("filter_timed", f"{E} SELECT line_no AS start_line, CAST(NULL AS VARCHAR) AS failure FROM e WHERE (user_id % 10 = 5 OR event_type = 'view') AND event_type <> 'signup'")
def filter_timed(spark, sf_dir):
    """Patterns that need a time limit, and hold: what safe ones beside them decide never reaches the limited engine."""
    v = _limited_view(spark, sf_dir, CriteriaForm(match=((r"user (?:\d|\d\d)*5 did", True), ("did view$", True)), ignore=((r"(?:[st]ig|x)+nup", True),)), log.body())
    return v.shown().select("start_line", F.lit(v.filter_failure()).cast("string").alias("failure"))


@query("highlight_failure", f"{E} SELECT text, max(failure) AS failure, CAST(max(n) AS INTEGER) AS n FROM (SELECT CASE WHEN event_id % 5000 = 1 THEN repeat('a', 60) || 'b' ELSE message END AS text, CASE WHEN event_id % 5000 = 1 THEN 'timeout' END AS failure, CASE WHEN event_id % 5000 = 1 THEN 0 ELSE 1 END AS n FROM e) GROUP BY text")
def highlight_failure(spark, sf_dir):
    """Texts on which a rule never ends have no highlights, and say so; all others have theirs."""
    rules, _ = compile_highlights([{"pattern": ENDLESS}, {"pattern": r"did \w+"}])
    h = highlight.highlights(single(spark, sf_dir, message=_slow()).select(F.col("message").alias("text")), rules, 0.2)
    return h.select("text", "failure", F.size("ranges").alias("n"))


@query("mask_failure", f"{E} SELECT 'error' AS failure, count(*) AS n FROM e")
def mask_failure(spark, sf_dir):
    return _view(spark, sf_dir, mask_pattern_sources=("(",)).mask_failures()


@query("mask_ipv6", f"{E} SELECT line_no AS start_line, 'from <HOST> to <HOST>, <HOST> at 1:' || user_id || ':3' AS message FROM e")
def mask_ipv6(spark, sf_dir):
    h = F.hex(F.col("event_id") % 65536)
    text = _text("from 2001:db8::", h, " to fe80::", F.lower(h), "%eth0, 1:2:3:4:5:6:7:", h, " at 1:", F.col("user_id"), ":3")
    return single(spark, sf_dir, message=text).select("start_line", masks.mask_hosts(F.col("message")).alias("message"))


@query("mask_keys_blanks", f"{E} SELECT line_no AS start_line, 'user=<MASKED> token: \"<MASKED>\" Id=<MASKED>' AS message FROM e")
def mask_keys_blanks(spark, sf_dir):
    """Keys may be separated by blanks, commas or both."""
    text = _text("user=", F.col("user_id"), ' token: "', F.col("event_type"), ' x" Id=', F.col("event_id"))
    return single(spark, sf_dir, message=text).select("start_line", masks.mask_keys(F.col("message"), " user  token,\tid ,").alias("message"))


@query("highlight_rules", f"{E} SELECT DISTINCT message AS text, CAST(strpos(message, 'did') - 1 AS INTEGER) AS first_start, 'yellow' AS first_color, 3 AS errors FROM e WHERE event_type <> 'view'")
def highlight_rules(spark, sf_dir):
    """Rules as users write them: the good ones are compiled, the others reported."""
    rules, bad = compile_highlights([{"pattern": r"DID (?!view)\w+"}, {"pattern": "("}, {"name": "none"}, {"pattern": "x", "color": "pink"}])
    h = highlight.highlights(single(spark, sf_dir).select(F.col("message").alias("text")), rules)
    return h.select("text", F.col("ranges")[0]["start"].alias("first_start"), F.col("ranges")[0]["color"].alias("first_color"), F.lit(len(bad)).alias("errors"))


def _view(spark, sf_dir, criteria: Criteria = Criteria(), display: Display = Display(gap_threshold_ms=600_000), **kw) -> View:
    return View(ordering.by_time(single(spark, sf_dir, message=F.concat(F.lit("did "), F.col("event_type")))), True, criteria, display, **kw)


ERRORS = compile_criteria(CriteriaForm(severities=("ERROR", "INFO")))[0]
CELLS = "rpad(file_name, 18, ' ') || ' | ' || rpad(kind, 3, ' ') || ' | ' || iso || 'Z ' || rpad(severity, 5, ' ') || ' did '"
SHOWN = E.replace("FROM events", "FROM events WHERE event_type IN ('error', 'view')")


@query("view_counts", f"{E} SELECT count(*) AS total_lines, count(*) FILTER (severity IN ('ERROR', 'INFO')) AS visible_lines, count(*) FILTER (severity NOT IN ('ERROR', 'INFO')) AS hidden_lines FROM e")
def view_counts(spark, sf_dir):
    """Totals of a redraw are those before any filter; new criteria replace those before."""
    return _view(spark, sf_dir, Criteria(severities=frozenset({"DEBUG"}))).with_criteria(ERRORS).payload()["counts"]


@query("view_severities", f"{E} SELECT severity FROM e GROUP BY severity")
def view_severities(spark, sf_dir):
    return _view(spark, sf_dir, ERRORS).payload()["severities"].select("severity")


@query("view_rows", f"""{SHOWN}, g AS (SELECT *, ms - lag(ms) OVER (ORDER BY ms, file_index, line_no) AS gap FROM e),
    r AS (SELECT ms AS t, file_index AS f, line_no AS place, 1 AS sub, {CELLS} || '<MASKED>' AS text FROM g UNION ALL SELECT ms, file_index, line_no, 0, repeat(' ', 18) || ' |     | ' || {GAP} FROM g WHERE gap >= 600000)
    SELECT * FROM (SELECT row_number() OVER (ORDER BY t, f, place, sub) AS row_no, text FROM r) WHERE row_no <= 700""")
def view_rows(spark, sf_dir):
    """A redraw's rows: filtered by the unmasked text, masked, with gaps between shown entries, within the row budget."""
    c = compile_criteria(CriteriaForm(match=((" did (error|view) ", True), ("", True))))[0]
    display = Display(gap_threshold_ms=600_000, max_lines=700)
    return _view(spark, sf_dir, c, display, mask_pattern_sources=("error|view",)).payload()["rows"].select("row_no", "text")


ALL_ROWS = f"""{SHOWN}, g AS (SELECT *, ms - lag(ms) OVER (ORDER BY ms, file_index, line_no) AS gap FROM e),
    r AS (SELECT ms AS t, file_index AS f, line_no AS place, 1 AS sub, {CELLS} || event_type AS text, line_no AS source_line FROM g UNION ALL SELECT ms, file_index, line_no, 0, repeat(' ', 18) || ' |     | ' || {GAP}, NULL FROM g WHERE gap >= 600000),
    n AS (SELECT row_number() OVER (ORDER BY t, f, place, sub) AS row_no, text, source_line, f FROM r)"""


@query("view_page", ALL_ROWS + " SELECT row_no, text, source_line FROM n WHERE row_no BETWEEN 301 AND 450")
def view_page(spark, sf_dir):
    """A page of rows: the index tells which entries to read."""
    return _view(spark, sf_dir, ERRORS).page(301, 450).select("row_no", "text", F.col("source.line").alias("source_line"))


@query("source_of_row", ALL_ROWS + " SELECT f AS file_index, 'f' || f AS file_name, '/logs/' || f AS path, source_line AS line FROM n WHERE row_no = 318 AND source_line IS NOT NULL")
def source_of_row(spark, sf_dir):
    """Where a shown row comes from, found through the index."""
    files = spark.range(3).select(F.col("id").cast("int").alias("file_index"), _text("f", F.col("id")).alias("file_name"), _text("/logs/", F.col("id")).alias("path"))
    return _view(spark, sf_dir, ERRORS).source_of(318, files)


@query("view_sized_sink", ALL_ROWS + ", s AS (SELECT string_agg(text, chr(10) ORDER BY row_no) AS t FROM n) SELECT md5(t) AS small_md5, strlen(t) AS small_bytes, true AS large_in_files, strlen(t) AS large_bytes FROM s")
def view_sized_sink(spark, sf_dir):
    """A small result comes as a text, one beyond the limit stays in files; its digest is the same from either."""
    v, path = _view(spark, sf_dir, ERRORS), f"{shared_dir(spark)}/timberline/sink-{uuid.uuid4().hex}"
    (small, n), (large, m) = v.text_or_files(f"{path}-a"), v.text_or_files(f"{path}-b", limit=1000)
    read = spark.read.text(f"{path}-b").agg(F.sum(F.octet_length("value") + 1).alias("b"))
    md5 = hashlib.md5(small.encode()).hexdigest() if small is not None else md5_of_files(spark, f"{path}-a").first()["md5"]
    return read.select(F.lit(md5).alias("small_md5"), F.lit(n).cast("bigint").alias("small_bytes"), F.lit(large is None).alias("large_in_files"), (F.col("b") - 1).alias("large_bytes"))


SHOWN_RUNS = RUNS.replace("ORDER_BY", "ms, file_index, line_no").replace(E, SHOWN)
SHOWN_FOLDED = SHOWN_RUNS + """, s AS (SELECT *, last_value(iso) OVER w AS last_iso, first_value(seq) OVER w AS first_seq FROM c WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    m AS (SELECT run, count(DISTINCT file_index) AS files FROM c WHERE n >= 3 GROUP BY run),
    f AS (SELECT s.*, CASE WHEN files > 1 THEN file_name || ', etc.' ELSE file_name END AS fl, CASE WHEN files > 1 THEN kind || ', etc.' ELSE kind END AS kl FROM s LEFT JOIN m USING (run) WHERE n < 3 OR seq = first_seq)"""
FOLDED_TEXT = f"rpad(fl, CAST((SELECT max(length(fl)) FROM f) AS INTEGER), ' ') || ' | ' || rpad(kl, CAST((SELECT max(length(kl)) FROM f) AS INTEGER), ' ') || ' | ' || iso || 'Z ' || rpad(severity, 5, ' ') || ' did ' || event_type || {SUFFIX}"


@query("view_items", SHOWN_FOLDED + f""", k AS (SELECT *, sum(CASE WHEN n >= 3 THEN n + 1 ELSE 1 END) OVER (ORDER BY seq) AS spent FROM f)
    SELECT row_number() OVER (ORDER BY seq) AS item_no, {FOLDED_TEXT} AS text, CAST(CASE WHEN n >= 3 THEN n ELSE 1 END AS INTEGER) AS n_lines FROM k WHERE spent <= 500""")
def view_items(spark, sf_dir):
    items = _view(spark, sf_dir, ERRORS, Display(max_lines=500)).payload()["items"]
    return items.select("item_no", "text", F.size("lines").alias("n_lines"))


@query("view_export_collapsed", SHOWN_FOLDED + f" SELECT row_number() OVER (ORDER BY seq) AS row_no, {FOLDED_TEXT} AS text FROM f")
def view_export_collapsed(spark, sf_dir):
    return _view(spark, sf_dir, ERRORS).export(collapsed=True).select("row_no", "text")


@query("view_written_text", SHOWN_FOLDED + f" SELECT {FOLDED_TEXT} AS text FROM f")
def view_written_text(spark, sf_dir):
    """A large result goes to text files, which are read back here."""
    path = f"{shared_dir(spark)}/timberline/export-{uuid.uuid4().hex}"
    _view(spark, sf_dir, ERRORS).write_text(path, collapsed=True)
    return spark.read.text(path).withColumnRenamed("value", "text")


@query("view_mask_order", f"{SHOWN} SELECT line_no AS line, {CELLS} || CASE WHEN event_type = 'error' THEN '<<MASKED>>' ELSE event_type END AS text FROM e")
def view_mask_order(spark, sf_dir):
    """Own patterns see what the masks of keys leave, and run one after the other."""
    v = _view(spark, sf_dir, ERRORS, Display(gap_threshold_ms=0), mask_key_names="none", mask_pattern_sources=("error", "MASKED"))
    return v.rows().select(F.col("source.line").alias("line"), "text")


@query("copied_export", f"{SHOWN} SELECT row_number() OVER (ORDER BY ms, file_index, line_no) AS row_no, '<TIMESTAMP> ' || severity || ' did ' || event_type AS text FROM e")
def copied_export(spark, sf_dir):
    """The shown entries in their own layout, masked for copying."""
    return render.copied_rows(_view(spark, sf_dir, ERRORS).laid_out(), Mask(timestamp=True, host=True)).select("row_no", "text")


@query("infer_pattern", f"{E} SELECT line_no, {SECOND} AS timestamp_ms, strftime(ts, '%d.%m.%Y %H:%M:%S') AS matched_text, true AS matched FROM e")
def infer_pattern(spark, sf_dir):
    """A pattern made from one marked example, previewed on all lines and used to parse them."""
    t = F.col("text")
    line = _text(t.substr(9, 2), ".", t.substr(6, 2), ".", t.substr(1, 4), " ", t.substr(12, 8), " ", log.body())
    p = infer.infer("27.06.2019 21:14:55 user 3", 0, 19)
    lines = log.events(spark, sf_dir).select("file_index", "line_no", line.alias("line"))
    seen = infer.preview(lines, p.name, p.pattern)
    formats, _ = compile_formats([{"name": p.name, "pattern": p.pattern}])
    e = parse_lines(lines, ParseOptions(formats=tuple(formats))).where(F.col("timestamp_format") == p.name)
    shown = seen.join(lines.select("line", "line_no"), "line").select("line_no", "timestamp_ms", "matched_text", "matched").distinct()
    return shown.join(e.select(F.col("start_line").alias("line_no"), F.col("raw_timestamp").alias("matched_text")), ["line_no", "matched_text"], "left_semi")


@query("recognition_by_formats", f"""{E}, l AS (SELECT file_index, line_no, line_no > (SELECT max(line_no) FROM e) / 2 AS late FROM e)
    SELECT file_index, count(*) AS total_lines, CAST(0 AS BIGINT) AS unrecognized_lines, count(*) FILTER (late) AS suspicious_run, count(*) FILTER (late) >= 10 AS should_warn FROM l GROUP BY file_index""")
def recognition_by_formats(spark, sf_dir):
    """Every file changes halfway to a format unknown here: its later lines are one long run that looks like timestamps."""
    from timberline.operators import assess

    e = log.events(spark, sf_dir)
    top = e.agg(F.max("line_no")).first()[0]
    t = F.col("text")
    strange = _text(t.substr(9, 2), ".", t.substr(6, 2), ".", t.substr(1, 4), " ", t.substr(12, 8), " ", log.body())
    line = F.when(F.col("line_no") > top / 2, strange).otherwise(_text(log.stamp("iso"), " ", log.body()))
    out = assess.recognition(parse_lines(e.select("file_index", "line_no", line.alias("line"))))
    return out.select("file_index", "total_lines", "unrecognized_lines", "suspicious_run", "should_warn")


@query("filter_prompted", f"{E} SELECT line_no AS start_line FROM e WHERE ts >= TIMESTAMP '2024-01-05 09:00' AND ts < TIMESTAMP '2024-01-06 09:00' AND user_id % 10 = 5 AND event_type <> 'view'")
def filter_prompted(spark, sf_dir):
    """Bounds in the display's time zone, patterns with blanks around them, and rows that are off or empty."""
    form = CriteriaForm(start=" 2024-01-05 10:00 ", end="2024-01-06 09:59", match=(("  user \\d*5\\b ", True), ("x(", False)), ignore=((" DID view  ", True), ("  ", True)))
    criteria, errors = compile_criteria(form, zone="Europe/Berlin")
    return filters.apply(single(spark, sf_dir), criteria).select("start_line").where(F.lit(not errors))


def _nation_text(spark, sf_dir, keep=None) -> str:
    """The nations as a log in memory, as an editor would hand it over."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = (n if keep is None else n.where(keep)).orderBy("n_nationkey").collect()
    return "\n".join(f"2024-01-01T{r.n_nationkey // 60:02d}:{r.n_nationkey % 60:02d}:00Z INFO {r.n_name}\n  in region {r.n_regionkey}" for r in rows)


@query("texts_in_memory", """SELECT CAST(0 AS INTEGER) AS file_index, row_number() OVER (ORDER BY n_nationkey) * 2 - 1 AS start_line, 1704067200000 + n_nationkey * 60000 AS timestamp_ms, 'INFO' AS severity,
    n_name || chr(10) || '  in region ' || n_regionkey AS message FROM nation UNION ALL SELECT 1, 1, NULL, NULL, 'unsaved'""")
def texts_in_memory(spark, sf_dir):
    """Texts that are in no file."""
    s = LogSession(spark).open_texts([("nations.log", _nation_text(spark, sf_dir)), ("other", "unsaved"), ("none", "")])
    return s.entries().select("file_index", F.col("start_line").cast("bigint").alias("start_line"), "timestamp_ms", "severity", "message")


@query("compare_texts", """SELECT 'left' AS side, '<TIMESTAMP> INFO ' || n_name AS text, CAST(1 AS BIGINT) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'left', '  in region 2', count(*) FROM nation WHERE n_regionkey = 2 HAVING count(*) > 0""")
def compare_texts(spark, sf_dir):
    """Two texts as comparable rows, and what one has more often than the other."""
    left, right = compare(spark, _nation_text(spark, sf_dir), _nation_text(spark, sf_dir, "n_regionkey <> 2"))
    return render.differences(left, right)


#: Line numbers of one piece of a growing log; every other cut parts an entry.
PIECE = 4002


@query("stream_entries", f"""{E} SELECT file_index, ms AS timestamp_ms, severity, CAST(event_id % 3 + 1 AS INTEGER) AS n_lines,
    message || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '  at frame 1' ELSE chr(10) || '  at frame 1' || chr(10) || '  at frame 2' END AS message FROM e""")
def stream_entries(spark, sf_dir):
    """Entries of logs that arrive in pieces: half of them, then, after a restart from the checkpoint, the others."""
    base = f"{shared_dir(spark)}/timberline/stream-{uuid.uuid4().hex}"
    lines = log.with_continuations(log.lines(spark, sf_dir)).withColumn("piece", F.floor(F.col("line_no") / PIECE))
    last = lines.agg(F.max("piece")).first()[0] or 0
    silence = spark.createDataFrame([(9, 0, 0, "the others are silent")], "file_index int, piece int, line_no int, line string")
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", entries.PROVIDER), _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):
        for new in (lines.where(F.col("piece") <= last // 2), lines.where(F.col("piece") > last // 2), silence):
            named = new.select(F.col("file_index").alias("log"), F.format_string("%012d", F.col("piece").cast("bigint")).alias("piece"), "line_no", "line")
            named.repartition("log", "piece").sortWithinPartitions("log", "piece", "line_no").select("log", "piece", "line").write.mode("append").partitionBy("log", "piece").text(f"{base}/in")
            e = entries.entry_stream(entries.read_pieces(spark, f"{base}/in", "log=([0-9]+)"), replace(REFERENCE, json_lines=False), idle_ms=1)
            e.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("log").cast("int").alias("file_index"), "timestamp_ms", "severity", F.size("lines").alias("n_lines"), "message")


@contextmanager
def _setting(spark, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
