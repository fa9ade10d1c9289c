"""Settings as users write them, compiled item by item: the good ones, and an error for each of the others."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from timberline.functions.patterns import PatternError, checked, compile_python, escape
from timberline.functions.timestamps import date_boundary, parse_offset
from timberline.options import Criteria, HighlightRule, Rule, SettingsError, TimestampFormat

#: Allowed highlight colours, the default first among equals.
COLORS = ("red", "orange", "yellow", "green", "blue", "purple")
DEFAULT_COLOR = "yellow"
CALENDAR_GROUPS = ("y", "mo", "d", "h", "mi", "s")


def _text(item: dict, key: str) -> str | None:
    v = item.get(key)
    return v if isinstance(v, str) and v else None


def compile_formats(items: list) -> tuple[list[TimestampFormat], list[SettingsError]]:
    """Custom timestamp formats; a pattern needs epochMs, epochSec or all calendar groups."""
    good, bad = [], []
    for i, item in enumerate(items):
        if not isinstance(item, dict):
            bad.append(SettingsError("notAnObject", i))
            continue
        name, pattern = _text(item, "name") or f"custom-{i + 1}", _text(item, "pattern")
        if pattern is None:
            bad.append(SettingsError("missingNamedPattern", i, name))
            continue
        try:
            groups = compile_python(pattern).groupindex
        except PatternError as e:
            bad.append(SettingsError("invalidNamedRegex", i, f"{name}: {e}"))
            continue
        if "epochMs" not in groups and "epochSec" not in groups and not all(g in groups for g in CALENDAR_GROUPS):
            bad.append(SettingsError("missingTimestampGroups", i, name))
            continue
        good.append(TimestampFormat(name, compile_python(pattern).pattern))
    return good, bad


def _rules(items: list, value_of, code: str, key: str) -> tuple[list[Rule], list[SettingsError]]:
    good, bad = [], []
    for i, item in enumerate(items):
        if not isinstance(item, dict):
            bad.append(SettingsError("notAnObject", i))
        elif _text(item, "filePattern") is None:
            bad.append(SettingsError("missingStringProperty", i, "filePattern"))
        else:
            try:
                pattern = compile_python(item["filePattern"]).pattern
            except PatternError as e:
                bad.append(SettingsError("invalidRegexProperty", i, f"filePattern: {e}"))
                continue
            value = value_of(item.get(key))
            if value is None:
                bad.append(SettingsError(code, i))
            else:
                good.append(Rule(pattern, value))
    return good, bad


def compile_file_offsets(items: list) -> tuple[list[Rule], list[SettingsError]]:
    """Source offsets by file name, in minutes."""
    return _rules(items, lambda v: parse_offset(v) if isinstance(v, str) else None, "invalidUtcOffset", "offset")


def _milliseconds(v) -> int | None:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
        return None
    return math.floor(v * 1000 + 0.5)


def compile_clock_skews(items: list) -> tuple[list[Rule], list[SettingsError]]:
    """Corrections of a file's clock, in milliseconds."""
    return _rules(items, _milliseconds, "invalidOffsetSeconds", "offsetSeconds")


def resolve(rules: list[Rule], file_name: str, default: int) -> int:
    """The value of the first rule found in the name."""
    return next((r.value for r in rules if re.search(r.pattern, file_name)), default)


def compile_highlights(items: list) -> tuple[list[HighlightRule], list[SettingsError]]:
    good, bad = [], []
    for i, item in enumerate(items):
        if not isinstance(item, dict):
            bad.append(SettingsError("notAnObject", i))
            continue
        name, pattern, color = _text(item, "name") or f"highlight-{i + 1}", _text(item, "pattern"), item.get("color", DEFAULT_COLOR)
        if pattern is None:
            bad.append(SettingsError("missingNamedPattern", i, name))
            continue
        try:
            source = compile_python(pattern, "im").pattern
        except PatternError as e:
            bad.append(SettingsError("invalidNamedRegex", i, f"{name}: {e}"))
            continue
        if color not in COLORS:
            bad.append(SettingsError("invalidHighlightColor", i, f"{name}: {json.dumps(color, ensure_ascii=False)}"))
            continue
        good.append(HighlightRule(name, source, color))
    return good, bad


def severity_tokens(items: list) -> tuple[str, ...]:
    """Additional severity words; what is no word is left out in silence."""
    return tuple(x.strip() for x in items if isinstance(x, str) and x.strip())


@dataclass(frozen=True)
class CriteriaForm:
    """What a user fills in. Rows of patterns are (text, enabled)."""

    severities: tuple[str, ...] | None = None
    start: str = ""
    end: str = ""
    match: tuple[tuple[str, bool], ...] = ()
    ignore: tuple[tuple[str, bool], ...] = ()
    files: tuple[int, ...] | None = None


def compile_patterns(rows, flags: str = "im") -> tuple[tuple[str, ...], list[SettingsError]]:
    """The patterns of the enabled, non-blank rows, without blanks around them."""
    good, bad = [], []
    for i, (text, enabled) in enumerate(rows):
        if not enabled or not text.strip():
            continue
        try:
            good.append(checked(text.strip(), flags))
        except PatternError as e:
            bad.append(SettingsError("invalidRegexProperty", i, str(e)))
    return tuple(good), bad


def compile_criteria(form: CriteriaForm, offset_min: int = 0, zone: str | None = None) -> tuple[Criteria, list[SettingsError]]:
    """Criteria of a form, and an error for each pattern or bound that could not be used."""
    match, bad = compile_patterns(form.match)
    ignore, more = compile_patterns(form.ignore)
    bounds = {}
    for name, text in (("start", form.start), ("end", form.end)):
        if text.strip():
            bounds[name] = date_boundary(text, name == "end", offset_min, zone)
            if bounds[name] is None:
                more.append(SettingsError("invalidDateBoundary", 0 if name == "start" else 1, text))
    start, end = bounds.get("start"), bounds.get("end")
    severities = None if form.severities is None else frozenset(form.severities)
    files = None if form.files is None else frozenset(form.files)
    return Criteria(severities, start, end, start is not None or end is not None, match, ignore, files), bad + more


def updated_severities(checked: set[str], before: set[str], now: set[str]) -> set[str]:
    """Checked severities after files were added: those that are new count as checked, and none is lost."""
    return checked | (now - before)


def key_mask_pattern(keys: str) -> str | None:
    """A Java pattern for the values of keys that commas or blanks separate; group 1 is what stays, the value is the rest.

    ``=`` may stand off the key but not the value, ``:`` may be followed by spaces; quotes stay.
    """
    names = "|".join(escape(k.strip()) for k in re.split(r"[,\s\ufeff]+", keys) if k)
    if not names:
        return None
    head = rf"(?<![A-Za-z0-9_.\-])(?:{names})\s*(?:=|:\s*)"
    value = r"[^\s,;)\]}\"']+"
    start = rf"(?:\"(?=[^\"\n]+\")|'(?=[^'\n]+')|(?={value}))"
    return rf"(?iu)({head}{start})(?:(?<=\")[^\"\n]+|(?<=')[^'\n]+|{value})"
