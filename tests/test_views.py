"""Rendering, masks, filters, highlights and settings on small logs."""

from itertools import groupby

import pytest
import regex
from pyspark.sql import functions as F

from timberline.functions import masks
from timberline.functions.patterns import PatternError, compile_python, java_source
from timberline.operators import filters, highlight, infer, ordering, render, timeline
from timberline.operators.parse import parse_files
from timberline.options import Criteria, Display, Mask
from timberline.plans.session import LogSession, compare, copy_masked
from timberline.settings import CriteriaForm, compile_clock_skews, compile_criteria, compile_file_offsets, compile_highlights, resolve, severity_tokens, updated_severities
from timberline.sources import storage
from timberline.sources.files import from_texts

TRACE = "2019-06-27T12:34:56Z FATAL cannot load plug-in\nplug.MissingPart: gear\n   in turn (wheel.rb:7)\n2019-06-27T12:34:58Z OK back to work"


def text(rows):
    return [r.text for r in rows.orderBy("row_no").collect()]


def entries(spark, t):
    return ordering.by_line(parse_files(from_texts(spark, [("app.log", t)])))


def test_normalized(spark):
    pad = " " * 31
    assert text(render.normalized(entries(spark, TRACE))) == ["1 | 2019-06-27T12:34:56.000Z FATAL cannot load plug-in", f"2 | {pad}plug.MissingPart: gear", f"3 | {pad}   in turn (wheel.rb:7)", "4 | 2019-06-27T12:34:58.000Z -     OK back to work"]


def test_collapsed_and_items(spark):
    t = "\n".join(f"2019-06-27T12:34:{s}Z DEBUG poll" for s in (10, 20, 30)) + "\n2019-06-27T12:34:33Z DEBUG sleep"
    e = entries(spark, t)
    assert text(render.collapsed(e)) == ["1-3 | 2019-06-27T12:34:10.000Z DEBUG poll (x3, ~12:34:30.000Z)", "  4 | 2019-06-27T12:34:33.000Z DEBUG sleep"]
    assert text(render.collapsed(e, Display(offset_min=-90)))[0].endswith("(x3, ~11:04:30.000-01:30)")
    items = render.display_items(e)
    assert [(r.kind, len(r.lines)) for r in items.orderBy("item_no").collect()] == [("group", 3), ("line", 1)]
    assert [(r.kind, len(r.lines)) for r in render.limit_items(items, 3).collect()] == [("group", 2)]
    assert render.limit_items(items, 1).count() == 0 and render.limit_items(items, 0).count() == 2 and render.limit_items(items, 4).count() == 1
    same = entries(spark, "\n".join(["2019-06-27T12:34:56Z DEBUG poll"] * 4))
    assert text(render.collapsed(same)) == ["1-4 | 2019-06-27T12:34:56.000Z DEBUG poll (x4)"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 11, 12, 13, 40])
def test_limited_items_are_those_of_the_whole(spark, n):
    """Building no more than the budget shows gives what cutting the whole would."""
    words = ["a"] * 3 + ["b"] + ["c"] * 2 + ["d"] * 30 + ["e"]
    e = entries(spark, "\n".join(f"2019-06-27T12:34:56Z {w}" for w in words))
    pick = lambda items: [(r.item_no, r.kind, r.text, len(r.lines)) for r in render.limit_items(items, n).orderBy("item_no").collect()]
    assert pick(render.display_items(e, max_lines=n)) == pick(render.display_items(e))


def test_merged_order_and_groups(spark):
    s = LogSession(spark).open_texts([("core.log", "undated\n2019-06-27T12:34:51Z WARN hot\n2019-06-27T12:34:53Z WARN fan"), ("edge.log", "2019-06-27T12:34:52Z WARN fan\n2019-06-27T12:34:54Z WARN fan\n2019-06-27T12:36:24Z . bye")])
    v = s.view()
    assert text(v.rows()) == ["core.log | core | 2019-06-27T12:34:51.000Z WARN hot", "edge.log | edge | 2019-06-27T12:34:52.000Z WARN fan", "core.log | core | 2019-06-27T12:34:53.000Z WARN fan", "edge.log | edge | 2019-06-27T12:34:54.000Z WARN fan", "         |      | 90s gap", "edge.log | edge | 2019-06-27T12:36:24.000Z -    . bye", "core.log | core | undated"]
    got = text(v.export(collapsed=True))
    assert got[1] == "edge.log, etc. | edge, etc. | 2019-06-27T12:34:52.000Z WARN fan (x3, ~12:34:54.000Z)"
    src = render.resolve_source(v.rows(), s.files, 3).first()
    assert (src.file_name, src.line) == ("core.log", 3)
    p = v.with_criteria(compile_criteria(CriteriaForm(severities=("WARN",)))[0]).payload()
    c = p["counts"].first()
    assert (c.total_lines, c.visible_lines, c.hidden_lines) == (6, 4, 2)
    assert [r.severity for r in p["severities"].collect()] == ["", "WARN"]


def test_a_redraw_writes_one_table(spark, monkeypatch):
    from timberline.plans import session

    wrote = []
    for module in (session, ordering, render):
        monkeypatch.setattr(module, "staged", lambda df, name, plain=storage.staged: wrote.append(name) or plain(df, name))
    s = LogSession(spark).open_texts([("a.log", TRACE), ("b.log", TRACE)])
    v = s.view()
    assert wrote == ["entries", "timeline"]
    v.rows().count()
    assert len(wrote) == 2
    p = v.payload()
    assert wrote[2:] == ["laid-out"] and [p[k].count() for k in ("rows", "items", "severities", "mask_failures")] == [8, 8, 2, 0]
    v.payload(), v.items(), v.export(True), s.view(), s.recognition()
    assert len(wrote) == 3


def test_no_task_gets_a_repeated_instant_or_run(spark):
    """One instant and one message in all rows: sorted and laid out over all partitions, folded into one group."""
    rows = spark.range(20_000).select((F.col("id") + 1).alias("start_line"), F.lit(0).alias("file_index"), F.lit(5).cast("long").alias("timestamp_ms"), F.lit("a.log").alias("file_name"), F.lit("a").alias("kind"), F.lit("INFO").alias("severity"), F.lit("beat").alias("message"), F.array(F.lit("beat")).alias("lines"), F.lit(True).alias("matched"), F.lit("iso8601").alias("timestamp_format"))
    e = ordering.by_time(rows)
    sizes = [r["count"] for r in e.groupBy(F.floor(F.col("seq") / 5_001)).count().collect()]
    assert len(sizes) == 4 and [r.start_line for r in e.orderBy("seq").limit(3).collect()] == [1, 2, 3]
    parts = spark.createDataFrame(rows.repartitionByRange(4, "timestamp_ms", "file_index", "start_line").groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert parts.count() == 4 and parts.agg(F.max("count")).first()[0] < 8_000
    (g,) = timeline.groups(timeline.laid_out(e)).collect()
    assert (g.n, g.first_line, g.last_line, g.file_indices) == (20_000, 1, 20_000, [0])
    items = render.display_items(e, Display(max_lines=50), False, 50)
    assert [len(r.lines) for r in items.collect()] == [51] and render.limit_items(items, 50).first().lines[-1].source.line == 49


def test_settings_of_files(spark, tmp_path):
    (tmp_path / "k.log").write_bytes(b"\xef\xbb\xbf2019-06-27T12:34:56 NOTICE \xfe!\n")
    (tmp_path / "none.log").write_bytes(b"")
    offsets, bad = compile_file_offsets([{"filePattern": "^k", "offset": "-03:30"}, {"filePattern": "[", "offset": "Z"}, {"filePattern": "x", "offset": "north"}, "k", {}])
    assert [b.code for b in bad] == ["invalidRegexProperty", "invalidUtcOffset", "notAnObject", "missingStringProperty"]
    skews, bad = compile_clock_skews([{"filePattern": "log$", "offsetSeconds": 0.25}, {"filePattern": "x", "offsetSeconds": None}])
    assert resolve(skews, "k.log", 0) == 250 and bad[0].code == "invalidOffsetSeconds"
    s = LogSession(spark, offsets=offsets, skews=skews).open([str(tmp_path / "k.log"), str(tmp_path / "none.log")])
    (e,) = s.entries().collect()
    assert (e.timestamp_ms, e.raw_timestamp, e.message) == (1561638896000 + 210 * 60_000 + 250, "2019-06-27T12:34:56", "\ufffd!\n")
    assert s.files.count() == 2


def test_failed_masks_and_filters(spark):
    """A mask that never ends leaves its entry as it is and says so; a filter that never ends fails the query."""
    bad = "a" * 40 + "b"
    s = LogSession(spark).open_texts([("a.log", f"2019-06-27T12:34:56Z {bad}\n2019-06-27T12:34:57Z aa")])
    slow = "(a|aa)+$"
    shown = spark.createDataFrame([(bad,), ("aa",)], "t string").select(masks.mask_patterns(F.col("t"), (slow,), 0.05).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in shown] == [(bad, "timeout"), (masks.MASKED, None)]
    assert s.view(mask_pattern_sources=("(",)).mask_failures().first().asDict() == {"failure": "error", "n": 2}
    with pytest.raises(Exception, match="regex timed out"):
        spark.createDataFrame([(bad,)], "t string").where(filters.found_in(F.col("t"), (slow,), 0.05)).count()


@pytest.mark.parametrize(("t", "want"), [("via 172.20.0.9/x", "via <HOST>/x"), ("fd12::9 fe80::c%wlan1 a:b:c:d:1:2:3:4", "<HOST> <HOST> <HOST>"), ("12:34:56 300.1.2.3 0a:1b:2c:3d:4e:5f 7:8", "12:34:56 300.1.2.3 0a:1b:2c:3d:4e:5f 7:8"), ("g::2h ß9.8.7.6", "g::2h ß<HOST>")])
def test_hosts(spark, t, want):
    assert spark.range(1).select(masks.mask_hosts(F.lit(t))).first()[0] == want


@pytest.mark.parametrize(("t", "want"), [("pid=77 Pid : 5 (pid 31)", "pid=<PID> Pid : <PID> (pid <PID>)"), ("relayd[48]: up", "relayd[<PID>]: up"), ("rows[0]: tries[6] = page[512] slot[012]:", "rows[0]: tries[6] = page[512] slot[012]:")])
def test_pids(spark, t, want):
    assert spark.range(1).select(masks.mask_process_ids(F.lit(t))).first()[0] == want


@pytest.mark.parametrize("keys", ["card, pin", "card pin", " pin\tcard ,", "pin,card"])
@pytest.mark.parametrize(("t", "want"), [("card=99 ok", "card=<MASKED> ok"), ("PIN:  0000; ok", "PIN:  <MASKED>; ok"), ("pin='4 2' ok", "pin='<MASKED>' ok"), ("card = 99", "card = 99"), ("postcard=x my-pin=y", "postcard=x my-pin=y"), ("card=, ok", "card=, ok"), ("pin=1;card=2", "pin=<MASKED>;card=<MASKED>")])
def test_keys(spark, t, want, keys):
    assert spark.range(1).select(masks.mask_keys(F.lit(t), keys)).first()[0] == want


def test_copy_and_compare(spark):
    t = "[q 4] 2019-06-27 12:34:56,007 NOTICE for 172.20.0.9\nJun 27 12:34:56 gw3 relay[48]: up"
    assert text(copy_masked(spark, t)) == ["[q 4] <TIMESTAMP> NOTICE for <HOST>", "<TIMESTAMP> <HOST> relay[48]: up"]
    assert text(copy_masked(spark, t, Mask(False, False, True))) == ["[q 4] 2019-06-27 12:34:56,007 NOTICE for 172.20.0.9", "Jun 27 12:34:56 gw3 relay[<PID>]: up"]
    a, b = compare(spark, t, t.split("\n")[0])
    assert text(a) == ["1 | <TIMESTAMP> NOTICE [q 4] for <HOST>", "2 | <TIMESTAMP> - <HOST> relay[48]: up"]
    assert [tuple(r) for r in render.differences(a, b).collect()] == [("left", "<TIMESTAMP> - <HOST> relay[48]: up", 1)]


def test_highlights(spark):
    rules, bad = compile_highlights([{"pattern": "leak", "color": "green"}, {"pattern": r"pipe \w+", "color": "purple"}, {"pattern": "x", "color": "gold"}, {"pattern": ""}])
    assert [b.code for b in bad] == ["invalidHighlightColor", "missingNamedPattern"]
    rows = spark.createDataFrame([("pipe leak found, pipe shut",), ("🛠 LEAK",), ("dry",)], "text string")
    got = {r.text: [tuple(x) for x in r.ranges] for r in highlight.highlights(rows, rules).collect()}
    assert got == {"pipe leak found, pipe shut": [(5, 9, "green"), (17, 26, "purple")], "🛠 LEAK": [(3, 7, "green")]}
    assert highlight.ranges("a" * 40 + "b", [(regex.compile("(a|aa)+$"), "red")], 0.05) == ([], "timeout")


def test_criteria_forms():
    c, bad = compile_criteria(CriteriaForm(start="someday", end="", match=(("b[", True), ("  fine ", True), (" ", True), ("no", False))))
    assert not c.in_range and c.match == ("(?i)fine",) and [b.code for b in bad] == ["invalidRegexProperty", "invalidDateBoundary"]
    assert severity_tokens(["LOUD", 3, " "]) == ("LOUD",)
    assert updated_severities({"WARN", "GONE"}, {"WARN", "DEBUG"}, {"WARN", "DEBUG", "FATAL"}) == {"WARN", "GONE", "FATAL"}


@pytest.mark.parametrize(("pattern", "flags", "yes", "no"), [("abc$", "", "abc", "abc\n"), ("^b", "m", "a\nb", "ab"), (r"\bé", "", "aé", "éa"), (r"a.c", "", "abc", "a\rc"), (r"\s", "", " ", "x"), (r"(?<n>a)\k<n>", "", "aa", "ab"), ("É", "i", "é", "e"), (r"[\d\-x]", "", "-", "y")])
def test_patterns(spark, pattern, flags, yes, no):
    p = compile_python(pattern, flags)
    assert p.search(yes) and not p.search(no)
    got = spark.createDataFrame([(yes,), (no,)], "t string").select(F.col("t").rlike(java_source(pattern, flags))).collect()
    assert [r[0] for r in got] == [True, False]


@pytest.mark.parametrize("pattern", ["[^]", "(", r"\cA", r"a\\"[:2], "[a"])
def test_refused_patterns(pattern):
    with pytest.raises(PatternError):
        compile_python(pattern)


def test_inference(spark):
    line = "at 04-11-2018 23:05:09 start"
    p = infer.infer(line, 3, 22)
    assert (p.name, p.ambiguous, p.groups) == ("DD-MM-YYYY_hh:mm:ss", True, ("d", "mo", "y", "h", "mi", "s"))
    assert infer.infer(line, 3, 22, "mdy").groups[:2] == ("mo", "d") and not infer.infer("04-21-2018 23:05:09", 0, 19).ambiguous
    assert infer.infer("2018/04/21 23:05:09.1-0230", 0, 26).groups[-3:] == ("tzs", "tzh", "tzm")
    assert infer.infer("1541372709.5", 0, 12).name == "custom-epoch-sec" and infer.infer("1541372709500", 0, 13).name == "custom-epoch-ms"
    for t, why in (("11 November 2018 23:05:09", "monthName"), ("04-11-18 23:05:09", "twoDigitYear"), ("23:05", "missingFields"), (" \t", "emptySelection"), ("at 7", "unsupportedToken")):
        with pytest.raises(infer.Refused, match=why):
            infer.infer(t, 0, len(t))
    got = infer.preview(spark.createDataFrame([(line,), ("at 31-11-2018 23:05:09",), ("-",)], "line string"), "n", p.pattern).collect()
    assert [(r.matched, r.matched_text is not None) for r in got] == [(True, True), (False, True), (False, False)]


def test_ordering_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 7)
    n = 60
    df = spark.createDataFrame([((i * 37) % n, 0, None if i % 9 == 0 else 1000 * ((i * 11) % 50), i % 4) for i in range(n)], "start_line long, file_index int, timestamp_ms long, v long").repartition(5)
    rows = sorted(df.collect(), key=lambda r: (r.timestamp_ms is None, r.timestamp_ms or 0, r.file_index, r.start_line))
    out = ordering.with_running_sums(ordering.with_previous(ordering.by_time(df), {"p": F.col("v")}), {"s": F.col("v"), "n": F.lit(1)}).orderBy("seq").collect()
    assert [r.start_line for r in out] == [r.start_line for r in rows] and [r.seq for r in out] == list(range(1, n + 1))
    assert [r.p for r in out] == [None] + [r.v for r in rows[:-1]]
    assert [r.s for r in out] == [sum(x.v for x in rows[: i + 1]) for i in range(n)]
    assert [r.n for r in out] == list(range(1, n + 1))
    left = [r for r in rows if r.v > 2]  # whole blocks are gone
    again = ordering.with_running_sums(ordering.with_previous(ordering.by_time(df).where("v > 2"), {"p": F.col("start_line")}), {"n": F.lit(1)}).orderBy("seq").collect()
    assert [(r.start_line, r.n) for r in again] == [(r.start_line, i + 1) for i, r in enumerate(left)]
    assert [r.p for r in again] == [None] + [r.start_line for r in left[:-1]]


def test_gap_rows_across_blocks(spark, monkeypatch):
    """Gaps and row numbers in one pass are those of the two passes; blocks end at gaps, and some are empty."""
    monkeypatch.setattr(ordering, "BLOCK", 4)
    times = [0, 1, 50, 51, 90, 91, 92, 150, 151, 152, 153, 154, 199, 200, 260]
    t = "\n".join(f"2019-06-27T12:{x // 60:02d}:{x % 60:02d}Z m{x}" + "\n  more" * (x % 3) for x in times)
    e = entries(spark, t).where("seq not in (5, 6, 7, 8)")
    one = {r.seq: (r.gap_text, r._end) for r in timeline.with_gap_rows(e, 30_000).collect()}
    n = F.size("lines") + F.col("gap_ms").isNotNull().cast("int")
    two = {r.seq: (r.gap_text, r._end) for r in ordering.with_running_sums(timeline.with_gaps(e, 30_000), {"_end": n}).collect()}
    assert one == two and sum(g is not None for g, _ in one.values()) == 4


def test_layout_across_blocks(spark, monkeypatch):
    """Runs that end with, cross and fill blocks, over numbers with holes."""
    monkeypatch.setattr(ordering, "BLOCK", 5)
    words = [w for w, k in zip("abacdabcb", (5, 1, 9, 2, 1, 16, 3, 5, 2), strict=True) for _ in range(k)]
    e = entries(spark, "\n".join(f"2019-06-27T12:{i:02d}:56Z {w}" for i, w in enumerate(words))).where("seq % 3 <> 0")
    kept = [(i, w) for i, w in enumerate(words) if (i + 1) % 3]
    runs = [k for k, (_, g) in enumerate(groupby(kept, key=lambda x: x[1]), 1) for _ in g]
    out = timeline.laid_out(e).orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(1, len(kept) + 1)) and [r.run_id for r in out] == runs
    assert [r.previous_ms for r in out] == [None] + [r.timestamp_ms for r in out[:-1]]
    assert [(r.run_id, r.n) for r in timeline.groups(timeline.laid_out(e)).orderBy("run_id").collect()] == [(k, runs.count(k)) for k in sorted(set(runs)) if runs.count(k) > 2]


def test_gap_text(spark):
    got = spark.createDataFrame([(30_000,), (30_049,), (30_050,), (61_234,)], "ms long").select(timeline.gap_text(F.col("ms"))).collect()
    assert [r[0] for r in got] == ["30s gap", "30s gap", "30.1s gap", "61.2s gap"]


SAFE = {r"did (view|click)$": True, r"user [0-9]*5\b": True, "a.*b.*c": True, "(ab)+": True, "(?:x{3})y": True, r"\(a+\)": True, "[(]+": True, r"(?<k>\d+) x": True, "(a+)?b": True,
        "(a|aa)+$": False, "(a+)+b": False, "(a*)*": False, "a*b*c*": False, r"(\w)\1": False, "(?=x)y": False, "(?<!x)y": False, "(a|b){2,}": False, "(?:a?){9}": False, "()+": False, r"(?<a>x)\k<a>": False, "((ab)+c)+": False, "a{1,500}b{2,9}c+": False}


@pytest.mark.parametrize(("pattern", "safe"), SAFE.items())
def test_what_runs_without_a_limit(pattern, safe):
    from timberline.functions.patterns import checked

    assert bool(checked(pattern, "im").java) == safe


@pytest.mark.parametrize(("pattern", "flags", "literal"), [("(a|b)+ did view", "", " did view"), ("x|yy", "", ""), (r"ab\.cd*e", "", "ab.c"), ("(long one)+ab", "", "ab"), ("Disk", "i", "D"), ("naïve", "i", "na"), (r"\d+", "", ""), ("a?bc", "", "bc"), ("a{2}bc", "", "bc"), ("[abc]{2}", "", "")])
def test_what_every_match_holds(pattern, flags, literal):
    from timberline.functions.patterns import checked, required_literal

    assert required_literal(pattern, "i" in flags) == literal
    assert not literal or checked(pattern, flags).literal == literal


def test_patterns_on_the_jvm_and_under_a_limit_agree(spark):
    """The same rows from both engines, over texts with other alphabets and line ends."""
    import regex

    from timberline.functions.patterns import checked

    texts = ["user 15 did view", "USER 5\nuser 25", "a\u2028user 5", "x5 é5 5é", "Kelvin \u212a", "ſtop", "a.b", "ab", "", "a\rb$", "tab\tuser 5 ", "日本 5", "\ufeffuser 5", "a b", None]
    patterns = [r"user [0-9]*5\b", "^user 5$", r"\s\d", "kelvin k", "STOP", "a.b", r"[^\s]5", "a$", "(?:us|x)er? ?5", "É5", r"\bé", "."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for p in patterns:
        p = checked(p, "im")
        assert p.java
        want = {i for i, t in enumerate(texts) if t is not None and regex.search(str(p), t)}
        found = df.where(filters.found_in(F.col("t"), (p,)))
        assert {r.i for r in found.collect()} == want, p
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.i for r in df.where(filters.found_in(F.col("t"), (str(p),))).collect()} == want, p


def test_fallback_of_a_view(spark):
    """A pattern that fails drops match and ignore alike, but only where an entry that is otherwise kept shows it."""
    from timberline.operators import ordering
    from timberline.operators.parse import parse_files
    from timberline.plans.session import View

    text = "2019-06-27T12:34:56Z ERROR one\n2019-06-27T12:34:57Z WARN " + "a" * 60 + "b\n2019-06-27T12:34:58Z ERROR two\n"
    log = ordering.by_line(parse_files(from_texts(spark, [("a.log", text)])))
    view = lambda **kw: View(log, False, compile_criteria(CriteriaForm(**kw))[0], limit_s=0.1)
    shown = lambda v: sorted(r.message[:3].strip() for r in v.shown().collect())
    slow = ((r"(a|aa)+$", True),)
    v = view(match=(("one", True),), ignore=slow)
    assert shown(v) == ["one"] and v.filter_failure() is None  # what match leaves out is not searched
    v = view(ignore=slow)
    assert shown(v) == ["aaa", "one", "two"] and v.filter_failure() == "timeout"
    assert {r.failure for r in v.payload()["filter_failure"].collect()} == {"timeout"}
    v = view(severities=("ERROR",), match=(("two", True), *slow))
    assert shown(v) == ["two"] and v.filter_failure() is None and v.payload()["filter_failure"].count() == 0
    v = View(log, False, Criteria(match=("(",)), limit_s=0.1)
    assert shown(v) == ["aaa", "one", "two"] and v.filter_failure() == "error"


def test_pages_read_only_their_blocks(spark, monkeypatch):
    """Pages put together are all rows, gaps at the edges of blocks included; the scan gets the block's bounds."""
    from timberline.plans.session import View

    monkeypatch.setattr(ordering, "BLOCK", 5)
    text = "".join(f"2019-06-27T12:{34 + i // 7}:{i % 7:02d}Z {'ERROR' if i % 3 else 'WARNING'} n{i}\n" + "  more\n" * (i % 4) for i in range(60))
    log = ordering.by_line(parse_files(from_texts(spark, [("a.log", text)])))
    v = View(log, False, display=Display(gap_threshold_ms=2000, max_lines=17))
    rows = [(r.row_no, r.text, r.source) for r in v.rows().orderBy("row_no").collect()]
    paged = [tuple(r) for a in range(1, len(rows) + 1, 13) for r in v.page(a, a + 12).orderBy("row_no").collect()]
    assert paged == rows and len(rows) > 150
    assert v.page(len(rows) + 1, len(rows) + 5).count() == v.page(-5, 0).count() == 0
    assert [tuple(r) for r in v.first_rows().orderBy("row_no").collect()] == rows[:17]
    plan = v.page(40, 41)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(seq), GreaterThanOrEqual(seq," in plan
    files = spark.createDataFrame([(0, "a.log", "/a.log")], "file_index int, file_name string, path string")
    for no, _, source in rows[30:36]:
        assert [r.line for r in v.source_of(no, files).collect()] == ([source.line] if source else [])


def test_sink_by_size(spark, tmp_path):
    v = LogSession(spark).open_texts([("a.log", TRACE)]).view()
    want = "\n".join(text(v.rows()))
    assert v.text_or_files(str(tmp_path / "a")) == (want, len(want.encode()))
    assert v.text_or_files(str(tmp_path / "b"), limit=10) == (None, len(want.encode()))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "b")).collect()) == want
    none = LogSession(spark).open_texts([("a.log", "")]).view()
    assert none.text_or_files(str(tmp_path / "c")) == ("", 0) and none.page(1, 9).count() == 0


def test_digest_of_a_result_in_files(spark, tmp_path, monkeypatch):
    """The registered query agrees with its text where that is too large to come as one; lines of all splits are in order."""
    import hashlib

    from timberline.plans import registry, session

    lines = [f"line {i} ünd" * (i % 5) for i in range(3000)] + [""]
    spark.createDataFrame(list(enumerate(lines)), "i int, t string").repartitionByRange(5, "i").sortWithinPartitions("i").select("t").write.text(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert session.md5_of_files(spark, str(tmp_path / "d")).first()["md5"] == hashlib.md5("\n".join(lines).encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = registry.QUERIES["view_sized_sink"](spark, "/root/testdata/sf0.001").first()
    monkeypatch.setattr(session.View.text_or_files, "__defaults__", (False, 1000))
    assert registry.QUERIES["view_sized_sink"](spark, "/root/testdata/sf0.001").first() == want and want.small_md5


def test_copies_of_a_slow_text_cost_no_time(spark):
    """A search that was given up is not repeated for copies of its text; another pattern, limit or text is searched."""
    from timberline.functions.patterns import within

    tried = []

    def search(limit):
        tried.append(limit)
        raise TimeoutError

    for of in (("slow", "t"), ("slow", "t"), ("slow", "u"), ("other", "t"), ("slow", "t")):
        with pytest.raises(TimeoutError):
            within(0.25, search, *of)
    assert tried == [0.25, 1.0] * 3
    assert within(0.5, lambda limit: limit, "slow", "t") == 0.5


def test_highlights_search_distinct_texts_once(spark):
    """The search runs above the distinct texts, once."""
    rules, _ = compile_highlights([{"pattern": "(a|aa)+$"}])
    plan = highlight.highlights(spark.createDataFrame([("a",)] * 3, "text string").repartition(2), rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("HashAggregate")


def test_encoded_files_are_decoded_once(spark, tmp_path):
    """Lines come from what was written when the files were opened, whatever the splits; the source is not read again."""
    from timberline.sources.files import open_files

    for name, text in {"a": "one\r\ntwo\n" * 500, "b": "ਊč x\rlast"}.items():
        (tmp_path / name).write_bytes(text.encode("utf-16-le"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        _, lines = open_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "utf16le")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [tuple(r) for r in lines.orderBy("file_index", "line_no").collect()]
    want = [*(t for _ in range(500) for t in ("one", "two")), ""]
    assert got == [(0, i + 1, t) for i, t in enumerate(want)] + [(1, 1, "ਊč x"), (1, 2, "last")]
    assert "Format: Text" not in lines._jdf.queryExecution().optimizedPlan().toString() + lines._jdf.queryExecution().executedPlan().toString()


def test_unbounded_items_read_groups_that_were_written_once(spark):
    """Widths, sums, lines and groups of a display without a budget do not each join the groups again."""
    texts = [("a.log", "\n".join(f"2024-01-02T03:04:0{i}Z INFO up" for i in range(5))), ("b.log", "2024-01-02T03:05:00Z WARN x")]
    items = render.display_items(LogSession(spark).open_texts(texts).log(), Display(), True)
    assert items.inputFiles() and all("/grouped-" in f for f in items.inputFiles())
    assert [(r["kind"], len(r["lines"])) for r in items.orderBy("item_no").collect()] == [("group", 5), ("line", 1)]
