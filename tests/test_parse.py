"""Literal lines and what must come of them."""

import json

import pytest

from timberline.functions.jsonline import number_text
from timberline.functions.recognize import Recognizer
from timberline.functions.timestamps import date_boundary, parse_offset, wall_clock_ms
from timberline.operators import assess
from timberline.operators.parse import parse_files, parse_lines
from timberline.options import ParseOptions
from timberline.settings import compile_formats
from timberline.sources.files import file_kind, from_texts, read_files, split_lines

R = Recognizer(ParseOptions(reference_time_ms=wall_clock_ms(2019, 12, 1, 0, 0, 0)))
NOON = wall_clock_ms(2019, 6, 27, 12, 34, 56)
HOUR = 3_600_000


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('172.20.0.9 - mira [27/Jun/2019:12:34:56 -0230] "PUT /cart/88 HTTP/2" 409 17', (NOON + 2 * HOUR + HOUR // 2, "apache-access-log", None, '172.20.0.9 - mira "PUT /cart/88 HTTP/2" 409 17')),
        ("[pool 7] [2019-06-27 12:34:56] shards balanced", (NOON, "bracketed-iso8601", None, "[pool 7] shards balanced")),
        ("zone=b7 rack=12 2019-06-27T12:34:56Z FATAL disk gone", (NOON, "iso8601", "FATAL", "zone=b7 rack=12 disk gone")),
        ("[ALERT] 2019-06-27 12:34:56 fan stopped", (NOON, "iso8601", None, "[ALERT] fan stopped")),
        ("2019-06-27T12:34:56,001999-0145 [io] [q9] Severe | - heat", (NOON + 1 + 105 * 60_000, "iso8601", "SEVERE", "heat")),
        ("2019/6/27 12:34:56.25 EMERG up", (NOON + 250, "slash-date", "EMERG", "up")),
        ("1561638896042 panic now", (NOON + 42, "epoch", "PANIC", "now")),
        ("1561638896,9 tick", (NOON + 900, "epoch", None, "tick")),
        ("Jun 27 12:34:56 gw3 relay: linked", (NOON, "syslog", None, "gw3 relay: linked")),
        ("Errors: 2019 of them", None),
        ("at=31415926535897932384 FATAL far away", None),
        ("2019-06-31T12:34:56Z no such day", None),
        ("2019-06-27T12:61:00Z x", None),
        ("2019-06-27T12:34:56-14:30 x", None),
        ("0042-06-27T12:34:56 x", None),
        ("15616388960421 a digit too many", None),
        ("a=1 b=2 c=3 d=4 2019-06-27T12:34:56Z x", None),
        ("rack=" + "n" * 70 + " 2019-06-27T12:34:56Z x", None),
        ("rack=7 2019-06-27T12:34:56Z " + "n" * 70, (NOON, "iso8601", None, "rack=7 " + "n" * 70)),
        ("rack=7 " + "n" * 60 + "=1 [e] 2019-06-27T12:34:56Z x", None),
    ],
)
def test_lines(line, want):
    ms, _, fmt, _, severity, message = R.line(line, 0)
    assert (None if ms is None else (ms, fmt, severity, message)) == want


def record(**kw):
    return json.dumps({"ts": "2019-06-27T12:34:56Z"} | kw, ensure_ascii=False)


@pytest.mark.parametrize(
    ("line", "severity", "message"),
    [
        (record(msg="order kept", shelf="q-17", why="out of stock", parent=None, box={"w": 2}), None, 'order kept shelf=q-17 why="out of stock" parent=null box={"w":2}'),
        (record(msg=False, shelf="q-17"), None, "msg=false shelf=q-17"),
        (record(level=["low"], msg="go"), None, 'go level=["low"]'),
        (record(level=60, msg="go"), "FATAL", "go"),
        (record(level=12.5, msg="go"), "12.5", "go"),
        (record(severity=" crit ", msg=""), "CRITICAL", ""),
        ('{"t":"1999-09-09T00:00:00Z","time":1561638896,"msg":"go"}', None, "go t=1999-09-09T00:00:00Z"),
        ('{"ts":1561638896.5,"p":2.0,"30":5e2,"4":3e22}', None, "4=3e+22 30=500 p=2"),
        ('{"ts":1561638896,"n":' + "7" * 500 + ',"m":[-1e400]}', None, "n=Infinity m=[null]"),
        ('{"ts":1561638896,"msg":"half \\udc21","k":"\\ud83d\\ude00"}', None, "half \ufffd k=\U0001f600"),
    ],
)
def test_json(line, severity, message):
    r = R.line(line, 0)
    assert r[0] is not None and r[2] == "json-lines" and (r[4], r[5]) == (severity, message)


@pytest.mark.parametrize("line", ['{"msg":"when?"}', '{"ts":"soon","msg":"x"}', '[{"ts":1561638896}]', '{"ts":1561638896},', '{"ts":Infinity}', '{"ts":', '{"ts":' + "7" * 500 + "}"])
def test_json_not_a_record(line):
    assert R.line(line, 0)[0] is None


def test_lone_surrogates_reach_spark(spark):
    rows = [(0, 1, '{"ts":1561638896,"msg":"half \\udc21"}'), (0, 2, '{"ts":1561638896,"level":"\\ud800","msg":"x"}')]
    got = parse_lines(spark.createDataFrame(rows, "file_index int, line_no long, line string")).orderBy("start_line").collect()
    assert [(r.severity, r.message) for r in got] == [(None, "half \ufffd"), ("\ufffd", "x")]


@pytest.mark.parametrize(
    ("line", "ms"),
    [
        ("on 2019.06.27 12h34m56", NOON),
        ("on 2019.06.27 12h34m56 +02", NOON - 2 * HOUR),
        ("on 12019.06.27 12h34m56", wall_clock_ms(12019, 6, 27, 12, 34, 56)),
        ("on some.06.27 12h34m56", None),
        ("on 2019..27 12h34m56", None),
        ("on 2019.06.27 12h34m56 +2", NOON),
        ("on 999999.06.27 12h34m56", None),
        ("t1561638896042.9", NOON + 42),
        ("tx", None),
        ("t" + "9" * 40, None),
    ],
)
def test_odd_groups_of_own_formats(line, ms):
    own, bad = compile_formats([{"name": "a", "pattern": r"on (?<y>\w+)\.(?<mo>\d*)\.(?<d>\d+) (?<h>\d+)h(?<mi>\d+)m(?<s>\d+)(?: (?<tzs>[+-])(?<tzh>\d{2}))?"}, {"name": "b", "pattern": r"t(?<epochMs>[\w.]+)"}])
    assert not bad and Recognizer(ParseOptions(formats=tuple(own))).line(line, 0)[0] == ms


def test_numbers():
    assert [number_text(x) for x in (1.0, 1e3, 0.1, 1e21, 1.5e-7, 1e-6, 2**60, -0.0, 123456.789)] == ["1", "1000", "0.1", "1e+21", "1.5e-7", "0.000001", "1152921504606847000", "0", "123456.789"]


def test_year_of_syslog_lines():
    leap = Recognizer(ParseOptions(reference_time_ms=wall_clock_ms(2021, 4, 10, 0, 0, 0)))
    assert leap.line("Feb 29 21:22:23 gw x", 0)[0] == wall_clock_ms(2020, 2, 29, 21, 22, 23)
    assert leap.line("Nov  3 21:22:23 gw x", 0)[0] == wall_clock_ms(2020, 11, 3, 21, 22, 23)
    assert leap.line("Apr 11 00:00:00 gw x", 0)[0] == wall_clock_ms(2021, 4, 11, 0, 0, 0)
    assert Recognizer(ParseOptions(assumed_year=2013)).line("Apr 11 00:00:00 gw x", 0)[0] == wall_clock_ms(2013, 4, 11, 0, 0, 0)


def test_offsets_and_bounds():
    assert [parse_offset(x) for x in ("z", " Utc ", "-07", "+1245", "-09:30", "-14:15", "utc+1", "+03:75")] == [0, 0, -420, 765, -570, None, None, None]
    assert [date_boundary(x, True) for x in ("2019-06-27 12:34", "2019-06-27T12:34:20", "2019-11-31", "2019-06-27 25:00", "2019-06-27 12:99")] == [NOON + 3_999, NOON - 36_000 + 999, None, None, None]
    assert date_boundary("2019-06-27", False, -300) == wall_clock_ms(2019, 6, 27, 5, 0, 0)
    assert date_boundary("2019-03-10 02:15", False, zone="America/New_York") is None
    assert date_boundary("2019-11-03 01:15", False, zone="America/New_York") == wall_clock_ms(2019, 11, 3, 5, 15, 0)


@pytest.mark.parametrize(("name", "kind"), [("ledger_20190627.log", "ledger"), ("mail-2019-06-27.txt", "mail"), ("queue_20190627_1845.log", "queue"), ("20190627.log", "20190627"), (".profile", ".profile"), ("db.log.12", "db"), ("db.log.2019-06-27", "db"), ("", "")])
def test_kinds(name, kind):
    assert file_kind(name) == kind


def test_entries_keep_every_line(spark):
    text = "== boot ==\n\n2019-06-27T12:34:56Z FATAL core halted\r\n  since 2019-06-27T12:34:50Z\r2019-06-27T12:34:57Z back\n"
    f = from_texts(spark, [("core.log", text), ("none.log", ""), ("notes.log", "no times here")])
    e = {(r.file_index, r.start_line): r for r in parse_files(f).collect()}
    assert sorted(e) == [(0, 1), (0, 3), (0, 5), (2, 1)]
    assert e[0, 1].lines == ["== boot ==", ""] and not e[0, 1].matched
    assert e[0, 3].message == "core halted\n  since 2019-06-27T12:34:50Z" and e[0, 3].severity == "FATAL"
    assert e[0, 5].lines == ["2019-06-27T12:34:57Z back", ""]
    assert sum(len(r.lines) for r in e.values()) == split_lines(f).count()
    r = {x.file_index: x for x in assess.recognition(parse_files(f), f).collect()}
    assert (r[1].total_lines, r[1].should_warn) == (0, False) and r[2].ratio == 1.0


def test_long_preamble_and_blocks(spark, monkeypatch):
    """Entries that cross blocks of lines stay whole."""
    import timberline.operators.parse as parse

    monkeypatch.setattr(parse, "BLOCK", 4)
    rows = [(0, i, f"2019-06-27T12:34:{i % 60:02d}Z x" if i in (7, 30) else "more") for i in range(1, 40)]
    got = {r.start_line: len(r.lines) for r in parse_lines(spark.createDataFrame(rows, "file_index int, line_no long, line string")).collect()}
    assert got == {1: 6, 7: 23, 30: 10}


def test_custom_formats():
    good, bad = compile_formats([{"pattern": r"#(?<epochSec>\d+)"}, {"name": "k", "pattern": r"(?<mo>\d)"}, {"name": "l"}, {"pattern": "[x"}, None])
    assert [g.name for g in good] == ["custom-1"]
    assert [b.code for b in bad] == ["missingTimestampGroups", "missingNamedPattern", "invalidNamedRegex", "notAnObject"]
    own, _ = compile_formats([{"name": "ru", "pattern": r"(?<d>\d+) числа (?<mo>\d+) месяца (?<y>\d{4}), (?<h>\d+):(?<mi>\d+):(?<s>\d+)"}])
    r = Recognizer(ParseOptions(formats=tuple(own)))
    assert r.line("27 числа 6 месяца 2019, 12:34:56 NOTICE да", 0)[:3] == (NOON, "27 числа 6 месяца 2019, 12:34:56", "ru")


def test_formats_with_a_function(spark):
    """The function is called once a batch; what it refuses goes to the next format or field, its offset is the source's."""
    import pandas as pd
    from pyspark.sql import functions as F

    from timberline.functions.recognize import recognized
    from timberline.options import TimestampFormat

    def hours(m):
        n = m["n"].astype(int)
        return pd.Series([x * 3_600_000 - o * 60_000 if x % 2 == 0 and len(m) > 3 else None for x, o in zip(n, m["offset_min"], strict=True)], dtype="Int64")

    own = (TimestampFormat("hours", r"h(?P<n>[0-9]+)", hours), TimestampFormat("odd", r"h(?P<epochMs>[0-9]*[13579])"))
    lines = ["h2 WARN a", "h3 b", "h4", "k=1 h6 c", "[h8] h10 d", "x h2", '{"ts":"h12","msg":"e"}', "h2500000002", None]
    df = spark.createDataFrame([(i, x, 60 * (i % 2)) for i, x in enumerate(lines)], "i int, line string, off int").coalesce(1)
    got = [(r.r.ms, r.r.format, r.r.message) for r in df.withColumn("r", recognized(F.col("line"), F.col("off"), ParseOptions(formats=own))).orderBy("i").collect()]
    h = 3_600_000
    assert got == [(2 * h, "hours", "a"), (3, "odd", "b"), (4 * h, "hours", ""), (5 * h, "hours", "k=1 c"), (10 * h, "hours", "[h8] d"), (None, None, None), (12 * h, "json-lines", "e"), (25, "odd", "00000002"), (None, None, None)]


def test_files_of_any_size_and_folders(spark, tmp_path):
    from timberline.plans.session import LogSession

    body = {"a.log": "".join(f"2019-06-27T12:34:56Z n{i}\r\n" for i in range(300)), "b.log": "one\rtwo\nthree", "c.log": "", "d.log": "\n\n", "e.log": "\ufeffx\n"}
    for name, text in body.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    paths = [str(tmp_path / n) for n in [*body, "sub", "a.log"]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        s = LogSession(spark).open(paths)
        got = sorted((r.file_index, r.line_no, r.line) for r in s.lines.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = sorted((r.file_index, r.line_no, r.line) for r in split_lines(read_files(spark, paths[:5])).collect())
    assert got == whole and len(got) == 301 + 3 + 3 + 2
    assert [r.file_name for r in s.files.orderBy("file_index").collect()] == list(body)


def test_encodings(spark, tmp_path):
    (tmp_path / "x").write_bytes("\ufeffzażółć".encode("utf-16-be"))
    assert read_files(spark, [str(tmp_path / "x")], "utf16be").first().text == "zażółć"
    (tmp_path / "y").write_bytes("日誌".encode("cp932"))
    assert read_files(spark, [str(tmp_path / "y")], "ShiftJIS").first().text == "日誌"
    with pytest.warns(UserWarning, match="cp437"):
        assert read_files(spark, [str(tmp_path / "y")], "cp437").first().text != "日誌"


TEXT = "".join(f"2019-06-27T12:34:56Z żółw №{i} 日誌ア{'x' * (i % 40)}\r\n  et cætera\n" for i in range(200))
#: In one order of bytes or the other these look like a line feed between their units.
SPLIT = "ਅĀ਀Ā Āਊ\u0a00\u0100\n"


@pytest.mark.parametrize("encoding", ["utf16le", "utf16be", "shiftjis", "eucjp", "gb18030", "cp950", "euckr", "windows1250", "iso2022jp", "koi8r"])
@pytest.mark.parametrize("tail", ["", "\r\n", "\r", "\n\n", "odd"])
def test_encoded_files_are_cut_in_blocks(spark, tmp_path, encoding, tail):
    """Many small splits give the lines of the whole text, with marks, all line ends and bytes that are none."""
    from timberline.sources.files import codec_of, open_files

    codec = codec_of(encoding)
    wide = encoding.startswith("utf16")
    body = ("\ufeff" if wide else "") + TEXT + ("one\rtwo\r\rthree" if tail != "odd" else "") + (tail if tail != "odd" else "")
    data = body.encode(codec, "replace") + (b"\x41" if tail == "odd" else b"") + (SPLIT.encode(codec) + b"" if wide and tail == "\n\n" else b"")
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "b.log").write_bytes("plain\n".encode(codec))
    (tmp_path / "c.log").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("a.log", "b.log", "c.log")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = sorted((r.file_index, r.line_no, r.line) for r in open_files(spark, paths, encoding)[1].collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((r.file_index, r.line_no, r.line) for r in split_lines(read_files(spark, paths, encoding)).collect())
