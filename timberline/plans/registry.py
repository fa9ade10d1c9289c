"""Registered queries and their DuckDB oracles.

Queries parse log lines back that were written from ``events`` (see :mod:`timberline.plans.rendered`); oracles compute
the same columns from the table itself. Only integers, texts and booleans are compared.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import masks
from timberline.functions.patterns import compile_python
from timberline.functions.timestamps import display_time
from timberline.operators import assess, filters, highlight, ordering, render, timeline
from timberline.operators.parse import parse_files, parse_lines, raw_text
from timberline.options import Criteria, Display, HighlightRule, Mask, ParseOptions, Rule, TimestampFormat
from timberline.plans import rendered as log
from timberline.settings import CriteriaForm, compile_criteria
from timberline.sources import files as source

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
REFERENCE = ParseOptions(reference_time_ms=1_735_603_200_000)

#: What the oracles start from: one row for each event, with what its log line says.
E = """
WITH e AS (
    SELECT *, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(user_id % 3 AS INTEGER) AS file_index, event_id * 4 + 1 AS line_no,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'NOTICE' WHEN 'view' THEN 'INFO' ELSE 'DEBUG' END AS severity,
        'user ' || user_id || ' did ' || event_type AS message,
        ['app.log', 'web-2024-01-02.log', 'db.log'][CAST(user_id % 3 AS INTEGER) + 1] AS file_name,
        ['app', 'web', 'db'][CAST(user_id % 3 AS INTEGER) + 1] AS kind,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(epoch_us(ts) // 1000 AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS iso
    FROM events
)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def single(spark: SparkSession, sf_dir: str, fmt: str = "iso", **kw) -> DataFrame:
    """Parsed entries of all events, as one file."""
    options = replace(REFERENCE, json_lines=fmt in ("jsonl", "mixed"))  # the others are text alone
    return log.with_names(parse_lines(log.lines(spark, sf_dir, fmt, **kw), options))


def one_file(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    lines = log.lines(spark, sf_dir, **kw).withColumn("file_index", F.lit(0))
    return ordering.by_line(parse_lines(lines, REFERENCE).withColumns({"file_name": F.lit("app.log"), "kind": F.lit("app")}))


def _basic(df: DataFrame) -> DataFrame:
    return df.select("file_index", "start_line", "timestamp_ms", "timestamp_format", "severity", "message", "matched")


def _basic_sql(fmt: str, ms: str = "ms", message: str = "message") -> str:
    return f"{E} SELECT file_index, line_no AS start_line, {ms} AS timestamp_ms, '{fmt}' AS timestamp_format, severity, {message} AS message, true AS matched FROM e"


SECOND = "(ms // 1000) * 1000"
for _fmt, _name, _ms in (("iso", "iso8601", "ms"), ("bracketed", "bracketed-iso8601", "ms"), ("slash", "slash-date", "ms"), ("apache", "apache-access-log", SECOND), ("epoch", "epoch", "ms"), ("syslog", "syslog", SECOND)):
    query(f"parse_{_fmt}", _basic_sql(_name, _ms))(lambda spark, sf_dir, fmt=_fmt: _basic(single(spark, sf_dir, fmt)))

query("parse_jsonl", _basic_sql("json-lines", message="message || ' user_id=' || user_id"))(lambda spark, sf_dir: _basic(single(spark, sf_dir, "jsonl")))


@query("parse_mixed", f"""{E} SELECT file_index, line_no AS start_line, CASE WHEN event_id % 6 = 3 THEN {SECOND} ELSE ms END AS timestamp_ms,
    ['iso8601', 'bracketed-iso8601', 'slash-date', 'apache-access-log', 'epoch', 'json-lines'][CAST(event_id % 6 AS INTEGER) + 1] AS timestamp_format, severity,
    CASE WHEN event_id % 6 = 5 THEN message || ' user_id=' || user_id WHEN event_id % 4 = 0 THEN 'host=web01 ' || message ELSE message END AS message, true AS matched FROM e""")
def parse_mixed(spark, sf_dir):
    return _basic(single(spark, sf_dir, "mixed"))


@query("parse_multiline", f"""{E} SELECT file_index, line_no AS start_line, ms AS timestamp_ms,
    message || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '  at frame 1' ELSE chr(10) || '  at frame 1' || chr(10) || '  at frame 2' END AS message,
    CAST(event_id % 3 + 1 AS INTEGER) AS n_lines,
    iso || 'Z ' || severity || ' ' || message || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '  at frame 1' ELSE chr(10) || '  at frame 1' || chr(10) || '  at frame 2' END AS raw FROM e""")
def parse_multiline(spark, sf_dir):
    lines = log.with_continuations(log.lines(spark, sf_dir, "iso"))
    return parse_lines(lines).select("file_index", "start_line", "timestamp_ms", "message", F.size("lines").alias("n_lines"), raw_text().alias("raw"))


@query("parse_custom_format", f"{E} SELECT file_index, line_no AS start_line, {SECOND} AS timestamp_ms, 'dotted' AS timestamp_format, message FROM e")
def parse_custom_format(spark, sf_dir):
    e = log.events(spark, sf_dir)
    t = F.col("text")
    line = F.concat(t.substr(9, 2), F.lit("."), t.substr(6, 2), F.lit("."), t.substr(1, 4), F.lit("_"), t.substr(12, 8), F.lit(" - "), log.body())
    own = TimestampFormat("dotted", compile_python(r"(?<d>\d{2})\.(?<mo>\d{2})\.(?<y>\d{4})_(?<h>\d{2}):(?<mi>\d{2}):(?<s>\d{2})").pattern)
    p = parse_lines(e.select("file_index", "line_no", line.alias("line")), ParseOptions(formats=(own,)))
    return p.select("file_index", "start_line", "timestamp_ms", "timestamp_format", "message")


@query("severity_normalize", f"""{E} SELECT line_no AS start_line, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'NOTICE' WHEN 'view' THEN 'INFO' ELSE 'CRITICAL' END AS severity, message FROM e""")
def severity_normalize(spark, sf_dir):
    return single(spark, sf_dir, "iso", words=log.SPELLED).select("start_line", "severity", "message")


@query("severity_extra_tokens", f"{E} SELECT line_no AS start_line, CASE event_type WHEN 'error' THEN 'OUCH' END AS severity FROM e")
def severity_extra_tokens(spark, sf_dir):
    words = {k: "ouch" if k == "error" else "hmm" for k in log.SEVERITY}
    return parse_lines(log.lines(spark, sf_dir, "iso", words=words), ParseOptions(severity_tokens=("OUCH",))).select("start_line", "severity")


@query("source_offset", f"{E} SELECT file_index, line_no AS start_line, ms - CASE file_index WHEN 0 THEN 540 WHEN 1 THEN -210 ELSE 0 END * 60000 AS timestamp_ms FROM e")
def source_offset(spark, sf_dir):
    lines = log.lines(spark, sf_dir, "local")
    offset = F.element_at(F.array(F.lit(540), F.lit(-210), F.lit(0)), F.col("file_index") + 1)
    return parse_lines(lines.withColumn("source_offset_min", offset)).select("file_index", "start_line", "timestamp_ms")


@query("file_settings", """SELECT CAST(n AS INTEGER) AS file_index, 'server-' || chr(CAST(97 + n % 3 AS INTEGER)) || '_20190627.log' AS file_name, CASE WHEN n % 3 = 0 THEN 540 WHEN n % 3 = 1 THEN 60 ELSE -480 END AS source_offset_min, CAST(CASE WHEN n % 3 = 2 THEN -1500 ELSE 0 END AS BIGINT) AS skew_ms, 'server-' || chr(CAST(97 + n % 3 AS INTEGER)) AS kind FROM (SELECT n_nationkey AS n FROM nation)""")
def file_settings(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("file_index"))
    f = n.withColumn("file_name", F.concat(F.lit("server-"), F.char(F.lit(97) + F.col("file_index") % 3), F.lit("_20190627.log")))
    f = source.with_settings(f, [Rule("server-a", 540), Rule("server-[ab]", 60)], [Rule("c_", -1500)], -480)
    return f.select("file_index", "file_name", "source_offset_min", "skew_ms", source.kind_of("file_name").alias("kind"))


@query("documents_lines", "SELECT doc_id, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i) WHERE text <> ''")
def documents_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_index"), "text")
    return source.split_lines(d).withColumnRenamed("file_index", "doc_id")


@query("documents_entries", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, text AS message, false AS matched FROM documents WHERE text <> ''")
def documents_entries(spark, sf_dir):
    """Documents hold no timestamps: each is one entry that was not recognised, and no line is lost."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("int").alias("file_index"), F.lit("x.log").alias("file_name"), "text")
    e = parse_files(d)
    return e.select(F.col("file_index").cast("bigint").alias("doc_id"), F.size("lines").alias("n_lines"), "message", "matched")


def _filtered(name: str, criteria: Criteria, where: str) -> None:
    @query(name, f"{E} SELECT file_index, line_no AS start_line, ms AS timestamp_ms, severity FROM e WHERE {where}")
    def run(spark, sf_dir):
        return filters.apply(single(spark, sf_dir), criteria).select("file_index", "start_line", "timestamp_ms", "severity")


_filtered("filter_severity", Criteria(severities=frozenset({"ERROR", "WARN"})), "severity IN ('ERROR', 'WARN')")
_filtered("filter_severity_none", Criteria(severities=frozenset()), "false")
_filtered("filter_files", Criteria(files=frozenset({0, 2})), "file_index <> 1")
_filtered("filter_match", Criteria(match=compile_criteria(CriteriaForm(match=(("DID (view|click)$", True), (" user 7\\b ", True), ("never", False))))[0].match), "event_type IN ('view', 'click') OR user_id = 7")
_filtered("filter_ignore", Criteria(ignore=compile_criteria(CriteriaForm(ignore=((r"\bdebug\b", True), (" ", True))))[0].ignore), "severity <> 'DEBUG'")
_RANGE, _ = compile_criteria(CriteriaForm(start="2024-01-05", end="2024-01-09 12:30"))
_filtered("filter_date_range", _RANGE, "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:31:00'")
_ALL, _ = compile_criteria(CriteriaForm(severities=("ERROR", "INFO"), start="2024-01-05 06:00", match=(("user [0-9]*5\\b", True),), ignore=(("did view", True),), files=(0, 1)))
_filtered("filter_criteria", _ALL, "severity = 'ERROR' AND ts >= TIMESTAMP '2024-01-05 06:00' AND user_id % 10 = 5 AND file_index < 2")


@query("distinct_severities", f"{E} SELECT severity, min_by(file_index, (file_index, line_no)) AS first_file, min_by(line_no, (file_index, line_no)) AS first_line FROM e GROUP BY severity")
def distinct_severities(spark, sf_dir):
    return assess.distinct_severities(single(spark, sf_dir))


@query("line_counts", f"{E} SELECT count(*) AS entries, CAST(sum(event_id % 3 + 1) AS BIGINT) AS lines FROM e")
def line_counts(spark, sf_dir):
    return assess.line_counts(parse_lines(log.with_continuations(log.lines(spark, sf_dir))))


@query("hidden_lines", f"{E} SELECT count(*) AS total_lines, count(*) FILTER (severity = 'ERROR') AS visible_lines, count(*) FILTER (severity <> 'ERROR') AS hidden_lines FROM e")
def hidden_lines(spark, sf_dir):
    e = single(spark, sf_dir)
    return assess.hidden_lines(e, filters.apply(e, Criteria(severities=frozenset({"ERROR"}))))


@query("recognition_by_file", """SELECT CAST(doc_id AS INTEGER) AS file_index, n AS total_lines, n AS unrecognized_lines, CAST(0 AS BIGINT) AS suspicious_run, n >= 10 AS should_warn FROM (
    SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS n FROM documents)""")
def recognition_by_file(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("int").alias("file_index"), F.lit("x.log").alias("file_name"), "text")
    return assess.recognition(parse_files(d), d).select("file_index", "total_lines", "unrecognized_lines", "suspicious_run", "should_warn")


@query("unrecognized_sample", """SELECT CAST(doc_id AS INTEGER) AS file_index, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i)
    WHERE text <> '' AND regexp_matches(string_split(text, chr(10))[i], '\\S') ORDER BY doc_id, i LIMIT 10""")
def unrecognized_sample(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("int").alias("file_index"), F.lit("x.log").alias("file_name"), "text")
    return assess.unrecognized_sample(parse_files(d), 10)


@query("merge_timeline", f"{E} SELECT row_number() OVER (ORDER BY CASE WHEN event_id % 50 = 0 THEN NULL ELSE ms END NULLS LAST, file_index, line_no) AS seq, file_index, line_no AS start_line FROM e")
def merge_timeline(spark, sf_dir):
    e = single(spark, sf_dir).withColumn("timestamp_ms", F.when(((F.col("start_line") - 1) / log.STEP) % 50 != 0, F.col("timestamp_ms")))
    return ordering.by_time(e).select("seq", "file_index", "start_line")


@query("gap_markers", f"""{E}, g AS (SELECT *, ms - lag(ms) OVER (ORDER BY ms, file_index, line_no) AS gap FROM e WHERE severity <> 'DEBUG')
    SELECT line_no AS start_line, gap AS gap_ms, CAST((gap + 50) // 100 // 10 AS VARCHAR) || CASE WHEN (gap + 50) // 100 % 10 = 0 THEN '' ELSE '.' || ((gap + 50) // 100 % 10) END || 's gap' AS gap_text FROM g WHERE gap >= 600000""")
def gap_markers(spark, sf_dir):
    """Gaps are those between shown entries, here of all files but without one severity."""
    e = single(spark, sf_dir).where("severity <> 'DEBUG'")
    return timeline.with_gaps(ordering.by_time(e), 600_000).where("gap_ms is not null").select("start_line", "gap_ms", "gap_text")


RUNS = f"""{E}, o AS (SELECT *, row_number() OVER (ORDER BY ORDER_BY) AS seq, lag(event_type) OVER (ORDER BY ORDER_BY) AS before FROM e),
    r AS (SELECT *, sum(CASE WHEN before = event_type THEN 0 ELSE 1 END) OVER (ORDER BY seq) AS run FROM o),
    c AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM r)"""


@query("collapse_runs", RUNS.replace("ORDER_BY", "line_no") + " SELECT line_no AS start_line, CAST(run AS BIGINT) AS run_id, n AS run_len, n >= 3 AS is_group FROM c")
def collapse_runs(spark, sf_dir):
    e = one_file(spark, sf_dir, message=F.concat(F.lit("did "), F.col("event_type")))
    return timeline.with_runs(e, 3).select("start_line", "run_id", "run_len", "is_group")


@query("collapse_merged", RUNS.replace("ORDER_BY", "ms, file_index, line_no") + """ SELECT CAST(run AS BIGINT) AS run_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, min_by(ms, seq) AS first_ms, max_by(ms, seq) AS last_ms,
    min_by(line_no, seq) AS first_line, max_by(line_no, seq) AS last_line, count(DISTINCT file_index) AS n_files FROM c WHERE n >= 3 GROUP BY run""")
def collapse_merged(spark, sf_dir):
    """Runs over the merged timeline; hosts in messages do not tell entries apart."""
    message = F.concat(F.lit("10.0.0."), (F.col("event_id") % 200).cast("string"), F.lit(" did "), F.col("event_type"))
    e = ordering.by_time(single(spark, sf_dir, message=message))
    return timeline.groups(timeline.with_runs(e, 3)).withColumn("n_files", F.size("file_indices").cast("bigint")).drop("file_indices", "many_kinds")


@query("display_timezone", f"{E} SELECT line_no AS start_line, iso || 'Z' AS utc, strftime(ts + INTERVAL 540 MINUTE, '%Y-%m-%dT%H:%M:%S.') || right(iso, 3) || '+09:00' AS tokyo, strftime(ts - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S.') || right(iso, 3) || '-03:30' AS west, strftime(ts + INTERVAL 60 MINUTE, '%Y-%m-%dT%H:%M:%S.') || right(iso, 3) || '+01:00' AS berlin FROM e")
def display_timezone(spark, sf_dir):
    ms = F.col("timestamp_ms")
    return single(spark, sf_dir).select("start_line", display_time(ms).alias("utc"), display_time(ms, 540).alias("tokyo"), display_time(ms, -210).alias("west"), display_time(ms, zone="Europe/Berlin").alias("berlin"))


def _source(df: DataFrame) -> DataFrame:
    return df.select("row_no", "text", F.col("source.file_index").alias("file_index"), F.col("source.line").alias("line"))


GAP = "CAST((gap + 50) // 100 // 10 AS VARCHAR) || CASE WHEN (gap + 50) // 100 % 10 = 0 THEN '' ELSE '.' || ((gap + 50) // 100 % 10) END || 's gap'"
WIDE = "(SELECT greatest(length(CAST(max(line_no) AS VARCHAR)), 1) FROM e)"


@query("format_normalized", f"""{E}, g AS (SELECT *, ms - lag(ms) OVER (ORDER BY line_no) AS gap FROM e),
    r AS (SELECT line_no AS place, 1 AS sub, lpad(CAST(line_no AS VARCHAR), CAST({WIDE} AS INTEGER), ' ') || ' | ' || iso || 'Z ' || rpad(severity, 6, ' ') || ' ' || message AS text, 0 AS file_index, line_no AS line FROM g
        UNION ALL SELECT line_no, 0, lpad('...', CAST({WIDE} AS INTEGER), ' ') || ' | ' || {GAP}, NULL, NULL FROM g WHERE gap >= 600000)
    SELECT row_number() OVER (ORDER BY place, sub) AS row_no, text, CAST(file_index AS INTEGER) AS file_index, line FROM r""")
def format_normalized(spark, sf_dir):
    return _source(render.normalized(one_file(spark, sf_dir), Display(gap_threshold_ms=600_000)))


@query("format_multiline", f"""{E}, r AS (SELECT line_no + k AS line, CASE WHEN k = 0 THEN iso || 'Z ' || rpad(severity, 6, ' ') || ' ' || message ELSE repeat(' ', 32) || '  at frame ' || k END AS body FROM e, unnest(range(0, event_id % 3 + 1)) AS t(k))
    SELECT row_number() OVER (ORDER BY line) AS row_no, lpad(CAST(line AS VARCHAR), CAST((SELECT length(CAST(max(line) AS VARCHAR)) FROM r) AS INTEGER), ' ') || ' | ' || body AS text FROM r""")
def format_multiline(spark, sf_dir):
    lines = log.with_continuations(log.lines(spark, sf_dir)).withColumn("file_index", F.lit(0))
    return render.normalized(ordering.by_line(parse_lines(lines)), Display(gap_threshold_ms=0)).select("row_no", "text")


@query("format_merged", f"""{E}, g AS (SELECT *, ms - lag(ms) OVER (ORDER BY ms, file_index, line_no) AS gap FROM e),
    r AS (SELECT ms AS t, file_index AS f, line_no AS place, 1 AS sub, rpad(file_name, 18, ' ') || ' | ' || rpad(kind, 3, ' ') || ' | ' || iso || 'Z ' || rpad(severity, 6, ' ') || ' ' || message AS text, file_index, line_no AS line FROM g
        UNION ALL SELECT ms, file_index, line_no, 0, repeat(' ', 18) || ' | ' || '   ' || ' | ' || {GAP}, NULL, NULL FROM g WHERE gap >= 600000)
    SELECT row_number() OVER (ORDER BY t, f, place, sub) AS row_no, text, file_index, line FROM r""")
def format_merged(spark, sf_dir):
    return _source(render.merged(ordering.by_time(single(spark, sf_dir)), Display(gap_threshold_ms=600_000)))


SUFFIX = "CASE WHEN n >= 3 THEN ' (x' || n || CASE WHEN last_iso = iso THEN ')' WHEN left(last_iso, 10) = left(iso, 10) THEN ', ~' || substr(last_iso, 12) || 'Z)' ELSE ', ~' || last_iso || 'Z)' END ELSE '' END"
FOLDED = RUNS + """, s AS (SELECT *, last_value(iso) OVER w AS last_iso, last_value(line_no) OVER w AS last_line, first_value(seq) OVER w AS first_seq FROM c WINDOW w AS (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    f AS (SELECT *, CASE WHEN n >= 3 THEN line_no || '-' || last_line ELSE CAST(line_no AS VARCHAR) END AS label FROM s WHERE n < 3 OR seq = first_seq)"""


@query("format_collapsed", FOLDED.replace("ORDER_BY", "line_no") + f"""
    SELECT row_number() OVER (ORDER BY seq) AS row_no, lpad(label, CAST((SELECT max(length(label)) FROM f) AS INTEGER), ' ') || ' | ' || iso || 'Z ' || rpad(severity, 6, ' ') || ' did ' || event_type || {SUFFIX} AS text FROM f""")
def format_collapsed(spark, sf_dir):
    e = one_file(spark, sf_dir, message=F.concat(F.lit("did "), F.col("event_type")))
    return render.collapsed(e, Display()).select("row_no", "text")


@query("display_items", FOLDED.replace("ORDER_BY", "line_no") + f"""
    SELECT row_number() OVER (ORDER BY seq) AS item_no, CASE WHEN n >= 3 THEN 'group' ELSE 'line' END AS kind, lpad(label, CAST((SELECT max(length(label)) FROM f) AS INTEGER), ' ') || ' | ' || iso || 'Z ' || rpad(severity, 6, ' ') || ' did ' || event_type || {SUFFIX} AS text,
        CAST(CASE WHEN n >= 3 THEN n ELSE 1 END AS INTEGER) AS n_lines FROM f""")
def display_items(spark, sf_dir):
    e = one_file(spark, sf_dir, message=F.concat(F.lit("did "), F.col("event_type")))
    return render.display_items(e, Display()).select("item_no", "kind", "text", F.size("lines").alias("n_lines"))


@query("display_items_merged", FOLDED.replace("ORDER_BY", "ms, file_index, line_no") + f""", m AS (SELECT run, count(DISTINCT file_index) AS files FROM c WHERE n >= 3 GROUP BY run),
    x AS (SELECT f.*, files, CASE WHEN files > 1 THEN file_name || ', etc.' ELSE file_name END AS fl, CASE WHEN files > 1 THEN kind || ', etc.' ELSE kind END AS kl FROM f LEFT JOIN m USING (run))
    SELECT row_number() OVER (ORDER BY seq) AS item_no, rpad(fl, CAST((SELECT max(length(fl)) FROM x) AS INTEGER), ' ') || ' | ' || rpad(kl, CAST((SELECT max(length(kl)) FROM x) AS INTEGER), ' ') || ' | ' || iso || 'Z ' || rpad(severity, 6, ' ') || ' did ' || event_type || {SUFFIX} AS text, coalesce(files, 0) AS n_files FROM x""")
def display_items_merged(spark, sf_dir):
    e = ordering.by_time(single(spark, sf_dir, message=F.concat(F.lit("did "), F.col("event_type"))))
    return render.display_items(e, Display(), True).select("item_no", "text", F.coalesce(F.size("header_file_indices"), F.lit(0)).cast("bigint").alias("n_files"))


@query("limit_display", FOLDED.replace("ORDER_BY", "line_no") + """, k AS (SELECT *, sum(CASE WHEN n >= 3 THEN n + 1 ELSE 1 END) OVER (ORDER BY seq) AS spent FROM f)
    SELECT row_number() OVER (ORDER BY seq) AS item_no, CASE WHEN n >= 3 THEN 'group' ELSE 'line' END AS kind FROM k WHERE spent <= 1000""")
def limit_display(spark, sf_dir):
    """The display's row budget is the feature."""
    e = one_file(spark, sf_dir, message=F.concat(F.lit("did "), F.col("event_type")))
    return render.limit_items(render.display_items(e, Display()), 1000).select("item_no", "kind")


@query("resolve_source", f"{E} SELECT file_index, file_name, line_no AS line FROM e QUALIFY row_number() OVER (ORDER BY ms, file_index, line_no) = 500")
def resolve_source(spark, sf_dir):
    """The source of the 500th shown row."""
    e = ordering.by_time(single(spark, sf_dir))
    files = log.with_names(spark.range(3).select(F.col("id").cast("int").alias("file_index"), F.lit("/logs").alias("path")))
    return render.resolve_source(render.merged(e, Display(gap_threshold_ms=0)), files, 500).drop("path")


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query("mask_ipv4_documents", f"SELECT doc_id, regexp_replace(text, '\\b{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}\\b', '<HOST>', 'g') AS text FROM documents WHERE regexp_matches(text, '{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}')")
def mask_ipv4_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(r"OCT\.OCT\.OCT\.OCT".replace("OCT", masks.OCTET)))
    return d.select("doc_id", masks.mask_hosts(F.col("text")).alias("text"))


@query("mask_pid", f"{E} SELECT line_no AS start_line, 'sshd[<PID>]: pid=<PID> items[0]: done' AS message FROM e")
def mask_pid(spark, sf_dir):
    text = F.concat(F.lit("sshd["), (F.col("user_id") + 10).cast("string"), F.lit("]: pid="), F.col("event_id").cast("string"), F.lit(" items[0]: done"))
    return single(spark, sf_dir, message=text).select("start_line", masks.mask_process_ids(F.col("message")).alias("message"))


@query("mask_key", f"{E} SELECT line_no AS start_line, 'user=<MASKED> token: \"<MASKED>\", superuser=' || user_id AS message FROM e")
def mask_key(spark, sf_dir):
    text = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(' token: "'), F.col("event_type"), F.lit(' x", superuser='), F.col("user_id").cast("string"))
    return single(spark, sf_dir, message=text).select("start_line", masks.mask_keys(F.col("message"), "user, token").alias("message"))


@query("mask_custom", f"{E} SELECT line_no AS start_line, '<MASKED> did ' || CASE WHEN event_type IN ('view', 'error') THEN '<MASKED>' ELSE event_type END AS message FROM e")
def mask_custom(spark, sf_dir):
    own = tuple(masks.user_pattern(p) for p in (r"^USER \d+", "view|error"))
    return single(spark, sf_dir).select("start_line", masks.mask_patterns(F.col("message"), own)["text"].alias("message"))


@query("mask_display", f"{E} SELECT row_number() OVER (ORDER BY line_no) AS row_no, lpad(CAST(line_no AS VARCHAR), CAST({WIDE} AS INTEGER), ' ') || ' | <TIMESTAMP> ' || rpad(severity, 6, ' ') || ' from <HOST> sshd[<PID>]: x' AS text FROM e")
def mask_display(spark, sf_dir):
    text = F.concat(F.lit("from 10.0.0."), (F.col("event_id") % 256).cast("string"), F.lit(" sshd["), (F.col("user_id") + 10).cast("string"), F.lit("]: x"))
    return render.normalized(one_file(spark, sf_dir, message=text), Display(gap_threshold_ms=0, mask=Mask(True, True, True))).select("row_no", "text")


@query("mask_compare", f"{E} SELECT row_number() OVER (ORDER BY line_no) AS row_no, lpad(CAST(line_no AS VARCHAR), CAST({WIDE} AS INTEGER), ' ') || ' | <TIMESTAMP> ' || severity || ' ' || message || ' from <HOST>' AS text FROM e")
def mask_compare(spark, sf_dir):
    text = F.concat(log.body(), F.lit(" from 10.0.0."), (F.col("event_id") % 256).cast("string"))
    return render.compare_rows(one_file(spark, sf_dir, message=text)).select("row_no", "text")


@query("compare_differences", f"{E} SELECT 'left' AS side, '<TIMESTAMP> ERROR ' || message AS text, count(*) AS n FROM e WHERE severity = 'ERROR' GROUP BY message")
def compare_differences(spark, sf_dir):
    e = one_file(spark, sf_dir)
    return render.differences(render.compare_rows(e), render.compare_rows(e.where("severity <> 'ERROR'")))


@query("mask_copy", f"""{E} SELECT row_number() OVER (ORDER BY line_no) AS row_no, CASE WHEN event_id % 6 = 5 THEN '{{"ts":"<TIMESTAMP>","level":"' || severity || '","msg":"' || message || '","user_id":' || user_id || '}}' ELSE CASE WHEN event_id % 4 = 0 THEN 'host=web01 ' ELSE '' END || '<TIMESTAMP> ' || severity || ' ' || message END AS text FROM e""")
def mask_copy(spark, sf_dir):
    return render.copied_rows(one_file(spark, sf_dir, fmt="mixed")).select("row_no", "text")


@query("mask_copy_syslog", f"{E} SELECT row_number() OVER (ORDER BY line_no) AS row_no, '<TIMESTAMP> <HOST> sshd[<PID>]: x' AS text FROM e")
def mask_copy_syslog(spark, sf_dir):
    e = log.events(spark, sf_dir)
    line = F.concat(log.stamp("syslog"), F.lit(" web"), (F.col("event_id") % 9).cast("string"), F.lit(" sshd["), (F.col("event_id") % 9 + 1).cast("string"), F.lit("]: x"))
    p = parse_lines(e.select(F.lit(0).alias("file_index"), "line_no", line.alias("line")), REFERENCE)
    return render.copied_rows(ordering.by_line(p), Mask(True, True, True)).select("row_no", "text")


@query("highlight", f"""{E} SELECT DISTINCT message AS text, CAST(0 AS INTEGER) AS first_start, CAST(4 AS INTEGER) AS first_end, 'blue' AS first_color, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS n FROM e""")
def highlights(spark, sf_dir):
    rules = [HighlightRule("a", "(?i)error", "red"), HighlightRule("b", r"(?:(?<=[\n\r  ])|\A)user", "blue"), HighlightRule("c", "user 1|rror", "green")]
    h = highlight.highlights(single(spark, sf_dir).select(F.col("message").alias("text")), rules)
    first = F.col("ranges")[0]
    return h.select("text", first["start"].alias("first_start"), first["end"].alias("first_end"), first["color"].alias("first_color"), F.size("ranges").alias("n"))


@query("file_kind", "SELECT p_partkey AS id, ['batch', 'app', 'queue', 'app', '.env', '20190627'][CAST(p_partkey % 6 AS INTEGER) + 1] AS kind FROM part")
def file_kind(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.element_at(F.array(F.lit("batch_20190627.log"), F.concat(F.lit("app.log."), k.cast("string")), F.lit("queue_20190627_1845.log"), F.lit("app.log.2019-06-27"), F.lit(".env"), F.lit("20190627.log")), (k % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), source.kind_of(name).alias("kind"))


from timberline.plans import more  # noqa: E402, F401  (registers its queries here)
