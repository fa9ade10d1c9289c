"""The compiled recognition gives what the rules in Python give, line by line."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.functions.compiled import compilable, with_text_recognized
from timberline.functions.recognize import Recognizer
from timberline.functions.timestamps import wall_clock_ms
from timberline.options import ParseOptions, TimestampFormat

HEADS = ["", "", "", "k=v ", "[w-1] ", "[w][q]", "10.0.0.1 - bob ", "a=1 b=2 c=3 ", "a=1 b=2 c=3 d=4 ", "k=" + "v" * 60 + " ", "k=" + "v" * 62 + " ", "k=1 " + "m" * 58 + "=2 [a] ", "😀=1 ", "[é] ", "x ", "[2024-13-01 00:00:00] ", "\x01 \x01 \x01 ", "a =1 ", " "]
DAYS = ["2024-02-29", "2023-02-29", "1900-02-29", "2000-02-29", "2024-04-31", "2024-12-31", "0099-01-01", "0100-01-01", "9999-12-31", "2024-00-10", "2024-10-00", "2024-1-05", "2024-06-27"]
SLASH = ["2024/2/29", "2023/02/29", "2024/06/7", "2024/6/31", "2024/12/31", "2024/13/1", "2024/0/1", "0042/1/1", "2024/006/1"]
CLOCKS = ["12:34:56", "00:00:00", "23:59:59", "24:00:00", "12:60:00", "12:34:60", "1:02:03", "12:34", "12:34:561"]
FRACTIONS = ["", "", ".5", ",123", ".123456789", ".1234567890", ".", ".12x"]
ZONES = ["", "", "Z", "z", "+09", "+0530", "-03:30", "+14:00", "+14:01", "-1400", "+15:00", "+05:99", "+05:3", "+5", " +0100", "Zulu", "-14", "+1360"]
MONTHS = ["Jan", "FEB", "feb", "Apr", "jun", "Dec", "Foo", "Nov"]
TAILS = ["", " ERROR boom", " [x] [y] warning: m", " [a][b][c] ERROR", ": - | err| x", " errors", " info", " WARN m", " crit", " [NOTICE] n", "x", "9", "] tail", " OUCH now", " É x", " ſevere s", " panic more", " emerg" + "n" * 200, " | "]


def lines(n=6000, seed=11):
    r = random.Random(seed)
    c = r.choice
    out = ["", " ", "plain", "\x01", "{", "{}", '{"ts":1}', "[", "[]", "1561638896", "15616388960421"]
    for _ in range(n):
        clock = c(CLOCKS) if r.random() < 0.3 else f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"
        day, slash = (c(DAYS), c(SLASH)) if r.random() < 0.5 else (f"20{r.randint(0, 99):02d}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}", f"20{r.randint(0, 99):02d}/{r.randint(1, 12)}/{r.randint(1, 31)}")
        stamp = c(
            [
                f"{day}{c('T  t')}{clock}{c(FRACTIONS)}{c(ZONES)}",
                f"[{day}{c('T ')}{clock}{c(FRACTIONS)}{c(ZONES)}]",
                f"{slash}{c('T ')}{clock}{c(FRACTIONS)}{c(ZONES)}",
                f"[{r.randint(0, 32):02d}/{c(MONTHS)}/{c(['2024', '2023', '2000', '0099'])}:{clock}{c(['', ' +0000', ' -0330', ' +1401', ' +1400', '+0000', ' +09:00'])}]",
                f"{c(MONTHS)}{c([' ', '  ', chr(9), chr(0xA0)])}{r.randint(0, 32)}{c([' ', '  '])}{clock}",
                c(["1561638896042", "1561638896", "1561638896.5", "1561638896,1234567890", "15616388961", "156163889604212", "0000000000000"]),
            ]
        )
        out.append(c(HEADS) + stamp + c(TAILS))
    return out


OPTIONS = [
    ParseOptions(reference_time_ms=wall_clock_ms(2024, 3, 1, 0, 0, 0)),
    ParseOptions(reference_time_ms=wall_clock_ms(2023, 1, 15, 12, 0, 0), severity_tokens=("OUCH", "É", " ", "a.b")),
    ParseOptions(assumed_year=2021),
    ParseOptions(assumed_year=2020, source_offset_min=-210),
    ParseOptions(assumed_year=42),
]


@pytest.mark.parametrize("options", OPTIONS)
def test_same_as_in_python(spark, options):
    rules = Recognizer(options)
    rows = [(i, x, (i % 3 - 1) * 90) for i, x in enumerate(lines())]
    df = spark.createDataFrame(rows, "i int, line string, off int").repartition(4)
    got = {r.i: r.r for r in with_text_recognized(df, "line", F.col("off"), options).collect()}
    for i, line, off in rows:
        if line.startswith("{"):
            continue
        want = rules.line(line, off)
        have = tuple(got[i]) if got[i] is not None else (None,) * 6
        assert have == want, line


def test_what_is_compiled():
    assert compilable(ParseOptions())
    assert not compilable(ParseOptions(formats=(TimestampFormat("a", "x"),)))
    assert not compilable(ParseOptions(severity_tokens=("a\x01",)))
    assert not compilable(ParseOptions(assumed_year=20_000))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_each_line_is_recognised_once(spark):
    """Text never leaves the JVM; with JSON records there is one Python step, and both readers share one exchange."""
    from timberline.plans import registry

    text = plan(registry.QUERIES["parse_iso"](spark, "/root/testdata/sf0.001"))
    assert "ArrowEvalPython" not in text and text.count("ReusedExchange") == 1 and text.count("regexp_replace(") == 2
    mixed = plan(registry.QUERIES["parse_mixed"](spark, "/root/testdata/sf0.001"))
    assert mixed.count("+- ArrowEvalPython") == mixed.count("ReusedExchange") == 1
