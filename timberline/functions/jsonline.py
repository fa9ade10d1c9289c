"""One line of JSON Lines as a log record."""

from __future__ import annotations

import json
import math
import re

TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "t")
LEVEL_KEYS = ("level", "severity", "lvl")
MESSAGE_KEYS = ("msg", "message")
#: What numeric levels mean.
LEVELS = {10: "TRACE", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}
SPACE_OR_QUOTE = re.compile(r'[\s"\ufeff]')
LONE_SURROGATE = re.compile("[\ud800-\udfff]")
#: Integers with more digits than this are beyond what a double holds, so they are infinite.
MAX_DIGITS = 309


def double(x: float | int) -> float:
    """A number as a double; integers too large for one are infinite."""
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def _integer(digits: str) -> float | int:
    return int(digits) if len(digits) <= MAX_DIGITS + 1 else math.copysign(math.inf, -1 if digits[0] == "-" else 1)


def quoted(text: str) -> str:
    """A string as JSON; half a surrogate pair is written as an escape."""
    return LONE_SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def whole(text: str | None) -> str | None:
    """A text that can be written as UTF-8: half surrogate pairs become replacement characters."""
    return text if text is None or text.isascii() else LONE_SURROGATE.sub("\ufffd", text)


def number_text(x: float | int) -> str:
    """A number as the web's JSON writes it: the shortest digits, exponents only from 1e21 up and below 1e-6."""
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = double(x)
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    digits, _, power = f"{x!r}".lower().partition("e") if "e" in f"{x!r}" else (repr(x), "", "0")
    sign = "-" if digits.startswith("-") else ""
    whole, _, part = digits.lstrip("-").partition(".")
    part = "" if part == "0" else part
    d = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    d = d.rstrip("0") or "0"
    if 0 < point <= 21:
        body = d + "0" * (point - len(d)) if len(d) <= point else f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + d
    else:
        e = point - 1
        body = d[0] + (f".{d[1:]}" if len(d) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + body


def compact(v) -> str:
    """A value as compact JSON, with the web's key order and number texts."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{quoted(k)}:{compact(x)}" for k, x in ordered(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(compact, v)) + "]"
    if isinstance(v, bool) or v is None:
        return {True: "true", False: "false", None: "null"}[v]
    if isinstance(v, (int, float)):
        return number_text(v) if math.isfinite(double(v)) else "null"
    return quoted(v)


def ordered(d: dict) -> list[tuple]:
    """Items with keys that are array indices first, ascending; the others as they came."""
    index = [k for k in d if re.fullmatch(r"0|[1-9][0-9]{0,9}", k) and int(k) < 2**32 - 1]
    return [(k, d[k]) for k in [*sorted(index, key=int), *(k for k in d if k not in set(index))]]


def _refuse(name: str):
    raise ValueError(name)


def parse(line: str) -> dict | None:
    """The object that the whole line is, or None."""
    if not line.startswith("{"):
        return None
    try:
        v = json.loads(line, parse_constant=_refuse, parse_int=_integer)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(double(v))


def first_key(record: dict, keys: tuple[str, ...]) -> str | None:
    return next((k for k in keys if k in record), None)


def time_text(record: dict) -> tuple[str | None, str | None]:
    """(key, text) of the first time field present, if it is a string or a number."""
    k = first_key(record, TIME_KEYS)
    v = record.get(k) if k else None
    return k, v if isinstance(v, str) else number_text(v) if _number(v) else None


def level(record: dict) -> tuple[str | None, str | None]:
    """(key, severity before normalising) of the first level field, if usable."""
    k = first_key(record, LEVEL_KEYS)
    v = record.get(k) if k else None
    if isinstance(v, str) and v.strip():
        return k, v.strip()
    return (k, LEVELS.get(v, number_text(v))) if _number(v) else (None, None)


def message(record: dict, used: set[str]) -> str:
    """The message field, then what is left as key=value."""
    k = first_key(record, MESSAGE_KEYS)
    text = record[k] if k and isinstance(record[k], str) else None
    used = used | ({k} if text is not None else set())

    def show(v) -> str:
        if isinstance(v, str):
            return quoted(v) if SPACE_OR_QUOTE.search(v) else v
        return number_text(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else compact(v)

    return " ".join([*([text] if text else []), *(f"{n}={show(v)}" for n, v in ordered(record) if n not in used)])
