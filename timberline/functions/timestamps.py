"""From a line's text to an instant: the built-in formats, their validation, offsets and display."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.patterns import SPACE_CLASS, compile_python
from timberline.options import ParseOptions

DAY_MS, YEAR_MIN, YEAR_MAX = 86_400_000, 100, 275_760
MONTH_DAYS = [calendar.monthrange(2023, m)[1] for m in range(1, 13)]
EPOCH_DAY = datetime(1970, 1, 1).toordinal()
MAX_OFFSET_MIN = 14 * 60
MAX_INSTANT_MS = 8_640_000_000_000_000
MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
# The shapes of the built-in formats.
CLOCK = r"(?P<h>[0-9]{2}):(?P<mi>[0-9]{2}):(?P<s>[0-9]{2})"
FRACTION = r"(?:[.,](?P<ms>[0-9]{1,9}))?"
ZONE = r"(?:(?P<tzz>[Zz])|(?P<tzs>[+-])(?P<tzh>[0-9]{2})(?::?(?P<tzm>[0-9]{2}))?)?"
ISO = rf"(?P<y>[0-9]{{4}})-(?P<mo>[0-9]{{2}})-(?P<d>[0-9]{{2}})[T ]{CLOCK}{FRACTION}{ZONE}"
SHAPES = {
    "bracketed-iso8601": rf"\[{ISO}\]",
    "iso8601": ISO,
    "slash-date": rf"(?P<y>[0-9]{{4}})/(?P<mo>[0-9]{{1,2}})/(?P<d>[0-9]{{1,2}})[T ](?P<h>[0-9]{{1,2}}):(?P<mi>[0-9]{{2}}):(?P<s>[0-9]{{2}}){FRACTION}",
    "apache-access-log": rf"\[(?P<d>[0-9]{{2}})/(?P<mon>[A-Za-z]{{3}})/(?P<y>[0-9]{{4}}):{CLOCK}(?: (?P<tzs>[+-])(?P<tzh>[0-9]{{2}})(?P<tzm>[0-9]{{2}}))?\]",
    "syslog": rf"(?P<mon>[A-Za-z]{{3}})[{SPACE_CLASS}]+(?P<d>[0-9]{{1,2}})[{SPACE_CLASS}]{CLOCK}",
    "epoch": r"(?:(?P<epochMs>[0-9]{13})|(?P<epochSec>[0-9]{10})(?:[.,](?P<ms>[0-9]{1,9}))?)(?![0-9])",
}


def parse_offset(text: str) -> int | None:
    """Minutes east of Greenwich of ``Z``, ``UTC``, ``+hh``, ``+hhmm`` or ``+hh:mm``; None where it is none of these."""
    text = text.strip()
    if text.upper() in ("Z", "UTC"):
        return 0
    m = re.fullmatch(r"([+-])([0-9]{2})(?::?([0-9]{2}))?", text)
    if not m:
        return None
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    if int(m[3] or 0) > 59 or minutes > MAX_OFFSET_MIN:
        return None
    return -minutes if m[1] == "-" else minutes


def offset_suffix(minutes: int) -> str:
    return "Z" if minutes == 0 else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def _fraction(text: str | None) -> int | None:
    """Milliseconds of the digits after the point; None where they are no digits."""
    if text is None:
        return 0
    return int(text.ljust(3, "0")[:3]) if text.isascii() and text.isdigit() else None


def _number(text: str | None) -> float | int | None:
    """What a group of an own format says: empty is 0, and None stands for no group and for no number."""
    if text is None:
        return None
    text = text.strip()
    if text.isascii() and text.isdigit():
        return int(text[:400])
    try:
        return float(text) if re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text) else None if text else 0
    except OverflowError:
        return None


def _clipped(ms: float | int | None) -> int | None:
    return None if ms is None or not abs(ms) <= MAX_INSTANT_MS else int(ms)


def wall_clock_ms(year: int, month: int, day: int, hour: int, minute: int, second: int, ms: int = 0) -> int | None:
    """The instant of a wall clock in UTC, None where the calendar or the clock has no such time."""
    if not YEAR_MIN <= year <= YEAR_MAX or not 0 <= hour <= 23 or not 0 <= minute <= 59 or not 0 <= second <= 59:
        return None
    if not 1 <= month <= 12 or not 1 <= day <= MONTH_DAYS[month - 1] + (month == 2 and calendar.isleap(year)):
        return None
    cycles, year = divmod(year - YEAR_MIN, 400)  # the calendar repeats after 400 years of 146,097 days
    days = datetime(year + YEAR_MIN, month, day).toordinal() - EPOCH_DAY + cycles * 146_097
    return days * DAY_MS + ((hour * 60 + minute) * 60 + second) * 1000 + ms


def instant(groups: dict[str, str | None], source_offset_min: int, options: ParseOptions) -> int | None:
    """The instant that a match's groups mean. A written offset beats the configured one; an epoch has none.

    None rejects the match: a group that is no number or did not take part, or a time that does not exist.
    """
    g = groups.get
    if g("epochMs"):
        return _clipped(_number(g("epochMs")))
    ms = _fraction(g("ms"))
    if g("epochSec"):
        seconds = _number(g("epochSec"))
        return None if seconds is None or ms is None else _clipped(seconds * 1000 + ms)
    month = MONTHS.get((g("mon") or "").lower()) if "mon" in groups and "mo" not in groups else _number(g("mo"))
    parts = [month, *(_number(g(k)) for k in ("d", "h", "mi", "s"))]
    if ms is None or any(x is None or x != x // 1 for x in parts):
        return None
    offset = source_offset_min
    if g("tzs"):
        offset = parse_offset(g("tzs") + (g("tzh") or "") + ("" if g("tzm") is None else f":{g('tzm')}"))
    elif g("tzz"):
        offset = 0
    if offset is None:
        return None

    def at(year: float | int | None) -> int | None:
        if year is None or year != year // 1 or abs(year) > YEAR_MAX:
            return None
        found = wall_clock_ms(int(year), *map(int, parts), ms)
        return None if found is None else _clipped(found - offset * 60_000)

    if "y" in groups:
        return at(_number(g("y")))
    if options.assumed_year is not None:
        return at(options.assumed_year)
    year = datetime.fromtimestamp(options.reference_time_ms / 1000, timezone.utc).year
    now = at(year)
    if now is None or now > options.reference_time_ms + DAY_MS:
        before = at(year - 1)
        return now if before is None else before
    return now


@dataclass(frozen=True)
class Matcher:
    name: str
    match: Callable[[str, int], re.Match | None]
    instants: Callable[[pd.DataFrame], pd.Series] | None = None


def matchers(options: ParseOptions) -> list[Matcher]:
    """Custom formats first, then the built-in ones, the most ambiguous last."""
    own = [Matcher(f.name, compile_python(f"(?:{f.pattern})").match, f.instants) for f in options.formats]
    return own + [Matcher(n, re.compile(p, re.ASCII).match) for n, p in SHAPES.items()]


def instants_of(texts: list[tuple[str, int]], formats: list[Matcher], places: Callable[[str], list[int]]) -> dict[tuple, int]:
    """What the formats' own functions make of (text, offset_min) pairs, at all places where they may match: each function
    is called once. Keys are (number of the format, text, place, offset_min)."""
    out = {}
    for i, f in enumerate(formats):
        if f.instants is None:
            continue
        keys = [((i, t, at, offset), m) for t, offset in dict.fromkeys(texts) for at in places(t) if (m := f.match(t, at))]
        if not keys:
            continue
        found = f.instants(pd.DataFrame([m.groupdict() | {"text": m[0], "offset_min": k[3]} for k, m in keys]))
        for (k, _), ms in zip(keys, found.reindex(range(len(keys))), strict=True):
            if not pd.isna(ms) and (ms := _clipped(ms)) is not None:
                out[k] = ms
    return out


def recognize_at(line: str, at: int, formats: list[Matcher], offset: int, options: ParseOptions, known: dict[tuple, int] | None = None) -> tuple[str, re.Match, int] | None:
    """The first format that matches at a place and names a real instant; ``known`` are those of ``instants_of``."""
    for i, f in enumerate(formats):
        if m := f.match(line, at):
            ms = instant(m.groupdict(), offset, options) if f.instants is None else (known or {}).get((i, line, at, offset))
            if ms is not None:
                return f.name, m, ms
    return None


def date_boundary(text: str, end: bool, offset_min: int = 0, zone: str | None = None) -> int | None:
    """Milliseconds of a typed bound. An end runs to the last millisecond of the smallest unit written."""
    m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?", text.strip())
    if not m:
        return None
    h, mi, s = (None if x is None else int(x) for x in m.groups()[3:])
    fill = (23, 59, 59) if end else (0, 0, 0)
    ms = wall_clock_ms(*map(int, m.groups()[:3]), *(f if x is None else x for x, f in zip((h, mi, s), fill, strict=True)), 999 if end else 0)
    if ms is None or zone is None:
        return None if ms is None else ms - offset_min * 60_000
    wall = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    there = wall.replace(tzinfo=ZoneInfo(zone), fold=0)  # of a repeated time the earlier one
    utc = there.astimezone(timezone.utc)
    if utc.astimezone(ZoneInfo(zone)).replace(tzinfo=None) != wall:
        return None
    return round(utc.timestamp() * 1000)


def display_time(ms: Column, offset_min: int = 0, zone: str | None = None) -> Column:
    """ISO text with milliseconds, in a fixed offset or in a zone; whatever the session's own zone is."""
    at = F.timestamp_add("SECOND", F.floor(ms / 1000), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    if zone is None:
        wall, suffix = F.timestamp_add("MINUTE", F.lit(offset_min), at), F.lit(offset_suffix(offset_min))
    else:
        wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), at)
        minutes = F.timestamp_diff("MINUTE", at, wall)
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        suffix = F.when(minutes == 0, "Z").otherwise(F.concat(F.when(minutes < 0, "-").otherwise("+"), two(F.floor(F.abs(minutes) / 60)), F.lit(":"), two(F.abs(minutes) % 60)))
    text = wall.cast("string")
    day, clock = F.split_part(text, F.lit(" "), F.lit(1)), F.split_part(text, F.lit(" "), F.lit(2)).substr(1, 8)
    day = F.when(F.startswith(day, F.lit("+")), F.concat(F.lit("+"), F.lpad(day.substr(2, 12), 12, "0"))).otherwise(day)
    return F.concat(day, F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), suffix)
