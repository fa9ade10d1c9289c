"""Masks as column expressions: addresses, process ids, values of keys, own patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.patterns import LIMIT_S, compile_python, user_patterns, within
from timberline.options import Mask
from timberline.settings import key_mask_pattern

TIMESTAMP, HOST, PID, MASKED = "<TIMESTAMP>", "<HOST>", "<PID>", "<MASKED>"
# What counts as an IPv4 address.
WORD_BEFORE, WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{WORD_BEFORE}{OCTET}(?:\.{OCTET}){{3}}{WORD_AFTER}"


def _ipv6() -> str:
    """Eight groups, or ``::`` for at least one of them, with at most seven colons; a zone may follow."""
    h = "[0-9a-fA-F]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}"]
    for left in range(7):
        right = 6 if left == 0 else 7 - left
        head = f"{h}(?::{h}){{{left - 1}}}" if left else ""
        forms.append(f"{head}::(?:{h}(?::{h}){{0,{right - 1}}})?")
    return rf"(?<![0-9a-zA-Z:])(?:{'|'.join(forms)})(?:%[0-9A-Za-z]+)?(?![0-9a-zA-Z:])"


IPV6 = _ipv6()
# What counts as a process id.
TAGGED_PID = r"([A-Za-z][A-Za-z0-9_.\-/]*)\[[1-9][0-9]{1,6}\](?=:)"
KEYWORD_PID = rf"(?i){WORD_BEFORE}(pid\s*[=:]\s*|pid\s+)[0-9]{{1,7}}{WORD_AFTER}"
SYSLOG_PID = r"^(\s*\S+\s+[A-Za-z][A-Za-z0-9_.\-/]*)\[[0-9]{1,7}\](?=:)"


def mask_hosts(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, IPV4, HOST), IPV6, HOST)


def mask_process_ids(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, TAGGED_PID, f"$1[{PID}]"), KEYWORD_PID, f"$1{PID}")


def mask_syslog_process_id(text: Column) -> Column:
    return F.regexp_replace(text, SYSLOG_PID, f"$1[{PID}]")


def mask_line(text: Column, mask: Mask) -> Column:
    text = mask_hosts(text) if mask.host else text
    return mask_process_ids(text) if mask.process_id else text


def by_line(text: Column, f) -> Column:
    """``f`` over each line of a text."""
    return F.array_join(F.transform(F.split(text, "\n", -1), f), "\n")


def mask_message(message: Column, timestamp_format: Column, mask: Mask) -> Column:
    """The lines of a shown message. After a syslog timestamp the first word is the host."""
    lines = F.split(message, "\n", -1)
    if not mask.text:
        return lines
    lines = F.transform(lines, lambda x: mask_line(x, mask))
    first = lines[0]
    first = F.regexp_replace(first, r"^\S+", HOST) if mask.host else first
    first = mask_syslog_process_id(first) if mask.process_id else first
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(timestamp_format == "syslog", F.concat(F.array(first), rest)).otherwise(lines)


def mask_copy_head(line: Column, raw: Column, timestamp_format: Column, prefix: Column, mask: Mask) -> Column:
    """An entry's first line for copying: its timestamp, wherever it stands, and what follows it in syslog."""
    at = F.when(timestamp_format == "json-lines", F.greatest(F.position(raw, line) - 1, F.lit(0)))
    at = at.otherwise(F.coalesce(prefix, F.lit(0)))
    head, rest = F.substr(line, F.lit(1), at), F.substr(line, at + F.length(raw) + 1)
    syslog = F.regexp_replace(rest, r"^(\s*)\S+", f"$1{HOST}") if mask.host else rest
    syslog = mask_syslog_process_id(syslog) if mask.process_id else syslog
    shown = F.lit(TIMESTAMP) if mask.timestamp else raw
    return F.when(raw.isNull(), line).otherwise(F.concat(head, shown, F.when(timestamp_format == "syslog", syslog).otherwise(rest)))


def mask_copy(lines: Column, raw: Column, timestamp_format: Column, prefix: Column, mask: Mask) -> Column:
    """The lines of an entry in their own layout, masked for copying."""
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.transform(F.concat(F.array(mask_copy_head(lines[0], raw, timestamp_format, prefix, mask)), rest), lambda x: mask_line(x, mask))


def mask_keys(text: Column, keys: str) -> Column:
    """Values of the named keys; blank keys mask nothing."""
    pattern = key_mask_pattern(keys)
    return text if pattern is None else by_line(text, lambda x: F.regexp_replace(x, pattern, f"$1{MASKED}"))


def mask_patterns(text: Column, patterns: tuple[str, ...], limit_s: float = LIMIT_S) -> Column:
    """A struct (text, failure): all matches of the users' own patterns (Python sources) masked, line by line.

    A literal replacement keeps backslashes plain. Where a pattern takes longer than ``limit_s`` on a text (see ``within``), or is none,
    the text stays as it was and ``failure`` says why: timeout or error.
    """

    @F.pandas_udf("text string, failure string")
    def run(s: pd.Series) -> pd.DataFrame:
        try:
            compiled, failure = user_patterns(patterns), None
        except Exception:
            compiled, failure = [], "error"

        def one(t):
            lines = t.split("\n")
            for p in compiled:
                lines = [within(limit_s, lambda limit, p=p, x=x: p.sub(lambda m: MASKED if m[0] else "", x, timeout=limit), "mask", p.pattern, x) for x in lines]
            return "\n".join(lines)

        out = []
        for t in s:
            try:
                out.append((None if t is None else one(t), failure))
            except TimeoutError:
                out.append((t, "timeout"))
        return pd.DataFrame(out, columns=["text", "failure"], dtype=object)

    return run(text) if patterns else F.struct(text.alias("text"), F.lit(None).cast("string").alias("failure"))


def user_pattern(pattern: str) -> str:
    """A user's mask pattern, checked; masks always find all matches, without regard to case."""
    return compile_python(pattern, "im").pattern
