"""Recognition of text lines on the JVM: the built-in formats compiled to a few Catalyst expressions.

All formats and leading fields become one pattern that runs once a line: up to three fields, tried from none upward, then
the first format that holds a real date, clock and offset. What the calendar forbids is part of the pattern (a look-ahead
over month lengths and leap years), so a refused match goes on to the next field as it should. The match is rewritten to
its fields, and arithmetic on these gives the instant; a second pattern splits severity and message. At any one place
the shapes exclude each other, so their order does not matter here.

Own formats and JSON records are not compiled; :mod:`timberline.functions.recognize` has the same rules in Python.
"""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.patterns import SPACE_CLASS as SPACE
from timberline.functions.recognize import FILLER, LEADING, MAX_FIELDS, MAX_LEADING, RESULT, SPELLINGS, tokens_of
from timberline.functions.timestamps import DAY_MS, MONTHS, YEAR_MAX, YEAR_MIN
from timberline.options import ParseOptions

MARK = "\x01"
FIELDS = ("raw", "y", "mo", "mon", "d", "h", "mi", "s", "ms", "tz", "epochMs", "epochSec", "prefix")
TWO = "[0-9]{2}"
LEAP = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
HOUR, SIXTY = "[01][0-9]|2[0-3]", "[0-5][0-9]"
#: A written offset of at most 14:00. One beyond refuses the match, so no offset may be read only where none is written.
OFFSET = f"[+-](?:(?:0[0-9]|1[0-3])(?::?{SIXTY}|(?!:?{TWO}))|14(?::?00|(?!:?{TWO})))"


def _days(pad: str, month: dict[int, str], sep: str, february: int) -> str:
    """Month, separator and day of the months' lengths; ``pad`` stands before a one-digit day."""
    last = {28: "[0-8]", 29: "[0-9]"}[february]
    thirty_one = "|".join(month[m] for m in (1, 3, 5, 7, 8, 10, 12))
    thirty = "|".join(month[m] for m in (4, 6, 9, 11))
    return f"(?:(?:{thirty_one}){sep}(?:{pad}[1-9]|[12][0-9]|3[01])|(?:{thirty}){sep}(?:{pad}[1-9]|[12][0-9]|30)|(?:{month[2]}){sep}(?:{pad}[1-9]|1[0-9]|2{last}))"


class Shapes:
    """Builds the pattern; remembers which group holds which field of which format."""

    def __init__(self, options: ParseOptions):
        self.groups: dict[str, list[int]] = {f: [] for f in FIELDS}
        self.n = 0
        fields = "|".join(p.pattern for p in LEADING)
        prefix = self.group("prefix", f"(?>{fields}){{0,{MAX_FIELDS}}}?")
        self.n += 1
        self.groups["raw"].append(self.n)
        formats = [f"\\[{self.iso()}\\]", self.iso(), self.slash(), self.apache(), *self.syslog(options), self.epoch()]
        self.pattern = f"(?s)^(?:{prefix}({'|'.join(formats)})|).*$"

    def group(self, field: str, pattern: str) -> str:
        self.n += 1
        self.groups[field].append(self.n)
        return f"({pattern})"

    def rewritten(self) -> str:
        """The replacement that leaves the fields, each the group of the one format that matched, between marks."""
        return MARK.join("".join(f"${g}" for g in self.groups[f]) for f in FIELDS)

    def clock(self, hour: str = HOUR) -> str:
        return ":".join(self.group(f, p) for f, p in (("h", hour), ("mi", SIXTY), ("s", SIXTY)))

    def fraction(self) -> str:
        return f"(?:[.,]{self.group('ms', '[0-9]{1,9}+')})?+"

    def iso(self) -> str:
        two = {m: f"{m:02d}" for m in range(1, 13)}
        real = f"(?!00)(?=(?:[0-9]{{4}}-{_days('0', two, '-', 28)}|{LEAP}-02-29)[T ])"
        parts = [self.group("y", "[0-9]{4}"), "-", self.group("mo", TWO), "-", self.group("d", TWO), "[T ]", self.clock(), self.fraction()]
        return real + "".join(parts) + self.group("tz", f"[Zz]|{OFFSET}|(?![+-]{TWO})")

    def slash(self) -> str:
        some = {m: f"0?{m}" if m < 10 else str(m) for m in range(1, 13)}
        real = f"(?!00)(?=(?:[0-9]{{4}}/{_days('0?', some, '/', 28)}|{LEAP}/0?2/29)[T ])"
        parts = [self.group("y", "[0-9]{4}"), "/", self.group("mo", "[0-9]{1,2}"), "/", self.group("d", "[0-9]{1,2}"), "[T ]", self.clock("[01]?[0-9]|2[0-3]"), self.fraction()]
        return real + "".join(parts)

    def apache(self) -> str:
        names = {i: f"(?i:{m})" for m, i in MONTHS.items()}
        thirty_one = "|".join(names[m] for m in (1, 3, 5, 7, 8, 10, 12))
        thirty = "|".join(names[m] for m in (4, 6, 9, 11))
        days = f"(?:0[1-9]|[12][0-9]|3[01])/(?:{thirty_one})|(?:0[1-9]|[12][0-9]|30)/(?:{thirty})|(?:0[1-9]|1[0-9]|2[0-8])/{names[2]}"
        real = f"(?=(?:(?:{days})/(?!00)[0-9]{{4}}|29/{names[2]}/(?!00){LEAP}):)"
        parts = ["\\[", real, self.group("d", TWO), "/", self.group("mon", "[A-Za-z]{3}"), "/", self.group("y", "[0-9]{4}"), ":", self.clock()]
        return "".join(parts) + f"(?: {self.group('tz', f'[+-](?:(?:0[0-9]|1[0-3]){SIXTY}|1400)')})?\\]"

    def syslog(self, options: ParseOptions) -> list[str]:
        years = years_of(options)
        if not years:
            return []
        names = {i: f"(?i:{m})" for m, i in MONTHS.items()}
        real = f"(?={_days('0?', names, f'[{SPACE}]+', 29 if any(map(calendar.isleap, years)) else 28)}[{SPACE}])"
        return [real + f"{self.group('mon', '[A-Za-z]{3}')}[{SPACE}]+{self.group('d', '[0-9]{1,2}')}[{SPACE}]{self.clock()}"]

    def epoch(self) -> str:
        return f"(?:{self.group('epochMs', '[0-9]{13}')}|{self.group('epochSec', '[0-9]{10}')}(?:[.,]{self.group('ms', '[0-9]{1,9}')})?)(?![0-9])"


def years_of(options: ParseOptions) -> list[int]:
    """The years that a line without one may be of, the likelier first; none where the assumed one is beyond the calendar."""
    if options.assumed_year is not None:
        return [options.assumed_year] if YEAR_MIN <= options.assumed_year <= YEAR_MAX else []
    year = datetime.fromtimestamp(options.reference_time_ms / 1000, timezone.utc).year
    return [y for y in (year, year - 1) if y >= YEAR_MIN]


def compilable(options: ParseOptions) -> bool:
    """Own formats stay in Python, and so do a severity word with the mark in it and years that Spark's dates lack."""
    years = years_of(options)
    return not options.formats and not any(MARK in t for t in options.severity_tokens) and all(y <= 9999 for y in years)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once.

    The body is evaluated as a tree, outside the stage's generated method. That keeps the method small enough for
    the JVM to compile; above its limit of 8,000 bytes every row of the stage would be interpreted.
    """
    return F.transform(F.array(value), f)[0]


def instant(x: Column, source_offset_min: Column, options: ParseOptions) -> Column:
    """Milliseconds since 1970 of the fields ``x``, which the pattern has proved to be a real time."""
    text = lambda f: x[FIELDS.index(f)]
    digits = lambda c, kind="int": F.when(c != "", c.cast(kind))  # noqa: E731  (a failing try_cast is an exception in the JVM, and slow)
    number = lambda f: digits(text(f))
    names = "".join(sorted(MONTHS, key=MONTHS.get))
    month = F.when(text("mon") != "", ((F.position(F.lower(text("mon")), F.lit(names)) + 2) / 3).cast("int")).otherwise(number("mo"))
    fraction = F.when(text("ms") == "", 0).otherwise(F.rpad(text("ms").substr(1, 3), 3, "0").cast("int"))
    tz = F.replace(text("tz"), F.lit(":"))
    minutes = F.when(F.startswith(tz, F.lit("-")), -1).otherwise(1) * (digits(tz.substr(2, 2)) * 60 + F.coalesce(digits(tz.substr(4, 2)), F.lit(0)))
    offset = F.when(text("tz") == "", source_offset_min).otherwise(F.coalesce(minutes, F.lit(0)))
    clock = ((number("h") * 60 + number("mi")) * 60 + number("s")).cast("bigint") * 1000 + fraction - offset.cast("bigint") * 60_000
    at = lambda v, year: (F.unix_date(F.make_date(year, v["mo"], F.lit(1))).cast("bigint") + v["d"] - 1) * DAY_MS + v["clock"]
    calendar_time = let(F.struct(month.alias("mo"), number("d").alias("d"), clock.alias("clock")), lambda v: F.when(text("y") != "", at(v, number("y"))).otherwise(without_year(v, at, options)))
    return F.when(text("epochMs") != "", text("epochMs").cast("bigint")).when(text("epochSec") != "", text("epochSec").cast("bigint") * 1000 + fraction).otherwise(calendar_time)


def without_year(v: Column, at, options: ParseOptions) -> Column:
    """Of the years that come into question the first, unless that lies more than a day ahead or has no such day."""
    years = years_of(options)
    if not years:
        return F.lit(None).cast("bigint")
    has_day = lambda y: F.lit(calendar.isleap(y)) | (v["mo"] != 2) | (v["d"] != 29)
    now, *before = (F.when(has_day(y), at(v, F.lit(y))) for y in years)
    if options.assumed_year is not None or not before:
        return now
    return F.when(now <= options.reference_time_ms + DAY_MS, now).otherwise(F.coalesce(before[0], now))


def with_text_recognized(lines: DataFrame, line: str, offset_min: Column, options: ParseOptions, name: str = "r") -> DataFrame:
    """Adds the struct RESULT of what each line starts, null where it starts no record. See ``compilable``."""
    shapes = Shapes(options)
    df = lines.withColumn("_x", F.split(F.regexp_replace(F.col(line), F.lit(shapes.pattern), F.lit(shapes.rewritten())), MARK, len(FIELDS)))
    prefix = F.col("_x")[FIELDS.index("prefix")]
    at = F.length(prefix)
    found = (F.col("_x")[0] != "") & (at <= MAX_LEADING)
    word = "|".join(map(re.escape, tokens_of(options)))
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    severity = rf"(?siu)^(?:{FILLER}(?:\[[^\]\r\n]*\]{FILLER}){{0,2}}\[?({word}){edge}\]?{FILLER}|{FILLER})(.*)$"
    rest = F.expr(f"substring(`{line}`, length(_x[{FIELDS.index('prefix')}]) + length(_x[0]) + 1)")
    df = df.withColumn("_s", F.when(found, F.regexp_replace(rest, F.lit(severity), F.lit(f"$1{MARK}$2"))))
    df = df.withColumn("_t", F.substring_index("_s", MARK, 1))
    level = F.when(F.col("_t") == "", None)
    for said, means in SPELLINGS.items():
        level = level.when(F.upper("_t") == said, means)
    level = level.otherwise(F.upper("_t"))
    message = F.concat(prefix, F.expr("substring(_s, length(_t) + 2)"))
    raw = F.col("_x")[0]
    kind = F.when(raw.startswith("["), F.when(raw.contains("/"), "apache-access-log").otherwise("bracketed-iso8601")).when(F.col("_x")[FIELDS.index("mon")] != "", "syslog")
    kind = kind.when(F.col("_x")[FIELDS.index("y")] == "", "epoch").when(raw.substr(5, 1) == "/", "slash-date").otherwise("iso8601")
    ms = let(F.col("_x"), lambda v: instant(v, offset_min, options))
    fields = [v.cast(t).alias(n) for (n, t), v in zip((f.split(" ") for f in RESULT.split(", ")), (ms, raw, kind, at, level, message), strict=True)]
    return df.withColumn(name, F.when(found, F.struct(*fields))).drop("_x", "_s", "_t")
