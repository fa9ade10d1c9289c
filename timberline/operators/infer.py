"""A timestamp pattern from an example that a user marks in a line."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.patterns import escape
from timberline.functions.timestamps import instant
from timberline.options import ParseOptions
from timberline.settings import compile_formats

MAX_BEFORE = 128
MONTH_NAMES = {name.lower() for names in (calendar.month_name, calendar.month_abbr) for name in names if name} | {"sept"}
# Widths of the groups, and what stands for them in a name.
WIDTH = {"y": r"\d{4}", "mo": r"\d{1,2}", "d": r"\d{1,2}", "h": r"\d{1,2}", "mi": r"\d{2}", "s": r"\d{2}", "ms": r"\d{1,9}", "epochMs": r"\d{13}", "epochSec": r"\d{10}"}
PLACE = {"y": "YYYY", "mo": "MM", "d": "DD", "h": "hh", "mi": "mm", "s": "ss", "ms": "SSS"}
CLOCK = ("h", "mi", "s")
#: Outlines of a timestamp, with # for each number, and how many of them belong to the date.
OUTLINES = {re.compile(r"[^#]*#[^#]*"): 0, re.compile(r"[^#]*#[.,]#[^#]*"): 0, re.compile(r"(?:[^#]*#){3}[^#]*#:#:#(?:[.,]#)?[^#]*"): 3}
ZONES = (
    (re.compile(r"[Zz]$"), "(?<tzz>[Zz])", ("tzz",)),
    (re.compile(r"[+-][0-9]{2}:[0-9]{2}$"), r"(?<tzs>[+-])(?<tzh>\d{2}):(?<tzm>\d{2})", ("tzs", "tzh", "tzm")),
    (re.compile(r"[+-][0-9]{4}$"), r"(?<tzs>[+-])(?<tzh>\d{2})(?<tzm>\d{2})", ("tzs", "tzh", "tzm")),
    (re.compile(r"[+-][0-9]{2}$"), r"(?<tzs>[+-])(?<tzh>\d{2})", ("tzs", "tzh")),
)


@dataclass(frozen=True)
class Proposal:
    pattern: str
    name: str
    groups: tuple[str, ...]
    ambiguous: bool


class Refused(ValueError):
    """Why no pattern can be proposed: emptySelection, monthName, unsupportedToken, twoDigitYear or missingFields."""


def _peel_zone(text: str) -> tuple[str, str, tuple[str, ...]]:
    """The text without a time zone at its end, and the zone's pattern and groups.

    A zone stands on its own: no letter goes before Z, and of a date's or number's end nothing is taken.
    """
    for pattern, source, groups in ZONES:
        m = pattern.search(text)
        if not m:
            continue
        before = text[: m.start()]
        if groups == ("tzz",) and re.search(r"[A-Za-z]$", before):
            continue
        return before, source, groups
    return text, "", ()


def layouts(numbers: list[str], outline: str) -> list[tuple[str, ...]]:
    """All meanings, a group for each number, that the outline and the widths of the numbers allow."""
    dated = {n for p, n in OUTLINES.items() if p.fullmatch(outline)}
    wide = [len(x) for x in numbers]
    if dated == {0}:
        return [g for g in (("epochMs",), ("epochSec",), ("epochSec", "ms")) if len(g) == len(wide) and wide[0] == (13 if g == ("epochMs",) else 10)]
    if dated != {3}:
        return []
    clock = (*CLOCK, "ms")[: len(wide) - 3]
    return [(*date, *clock) for date in permutations(("y", "mo", "d")) if all((w == 4) if g == "y" else w <= 2 for g, w in zip(date, wide, strict=False))]


def meaning(numbers: list[str], outline: str, order: str | None) -> tuple[tuple[str, ...], bool]:
    """The meaning of the numbers, and whether another one would do as well.

    Where day and month could change places, the asked order decides; without one, the month follows a leading year,
    and the day comes first otherwise. A month beyond 12 rules a meaning out, if any other is left.
    """
    found = layouts(numbers, outline)
    if not found:
        dated = any(n and p.fullmatch(outline) for p, n in OUTLINES.items())
        raise Refused("twoDigitYear" if dated and all(len(x) <= 2 for x in numbers[:3]) else "missingFields")
    if len(found) == 1:
        return found[0], False
    real = [g for g in found if int(numbers[g.index("mo")]) <= 12]
    day_first = order == "dmy" if order else found[0][0] != "y"
    wanted = [g for g in real or found if (g.index("d") < g.index("mo")) == (day_first if real else True)]
    return (wanted or real)[0], len(real) > 1


def infer(line: str, start: int, end: int, day_month_order: str | None = None) -> Proposal:
    """A pattern for the marked part of a line; raises Refused where none can be made."""
    start = max(0, min(start, len(line)))
    end = max(start, min(end, len(line)))
    marked = line[start:end]
    start += len(marked) - len(marked.lstrip())
    if not (text := marked.strip()):
        raise Refused("emptySelection")
    text, zone, zone_groups = _peel_zone(text)
    parts = re.findall(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]+", text)
    for p in parts:
        if p.isascii() and p.isalpha() and len(p) > 1:
            raise Refused("monthName" if p.lower() in MONTH_NAMES else "unsupportedToken")
    digits = [i for i, p in enumerate(parts) if p[0] in "0123456789"]
    groups, ambiguous = meaning([parts[i] for i in digits], "".join("#" if i in digits else p for i, p in enumerate(parts)), day_month_order)
    roles = dict(zip(digits, groups, strict=True))
    body = "".join(f"(?<{roles[i]}>{WIDTH[roles[i]]})" if i in roles else escape(p) for i, p in enumerate(parts))
    prefix = f".{{0,{min(start, MAX_BEFORE)}}}?" if start else ""
    return Proposal(prefix + body + zone, _name(parts, roles), (*(roles[i] for i in sorted(roles)), *zone_groups), ambiguous)


def _name(parts: list[str], roles: dict[int, str]) -> str:
    for group, name in (("epochMs", "custom-epoch-ms"), ("epochSec", "custom-epoch-sec")):
        if group in roles.values():
            return name
    first_time = min(i for i, r in roles.items() if r in ("h", "mi", "s", "ms"))
    return "".join(PLACE[roles[i]] if i in roles else "_" if i == first_time - 1 else p for i, p in enumerate(parts))


def preview(lines: DataFrame, name: str, pattern: str, options: ParseOptions = ParseOptions()) -> DataFrame:
    """(line, matched, matched_text, timestamp_ms): matched_text alone means that the text fits but names no real time."""
    formats, errors = compile_formats([{"name": name, "pattern": pattern}])
    if errors:
        raise Refused(errors[0].code)
    source = formats[0].pattern

    @F.pandas_udf("matched_text string, timestamp_ms bigint")
    def run(s):
        import pandas as pd

        p, rows = re.compile(f"(?:{source})"), []
        for x in s:
            m = p.match(x)
            rows.append((m[0], instant(m.groupdict(), options.source_offset_min, options)) if m else (None, None))
        return pd.DataFrame(rows, columns=["matched_text", "timestamp_ms"], dtype=object).astype({"timestamp_ms": "Int64"})

    out = lines.select("line", run("line").alias("r"))
    return out.select("line", F.col("r.timestamp_ms").isNotNull().alias("matched"), "r.matched_text", "r.timestamp_ms")
