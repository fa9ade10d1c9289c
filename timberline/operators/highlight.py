"""Highlights: where rules match in shown lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.patterns import LIMIT_S, user_patterns, within
from timberline.options import HighlightRule

RANGES = "array<struct<start:int,end:int,color:string>>"


def utf16(text: str, at: int) -> int:
    """An offset in 16-bit units, as editors count."""
    return at + sum(c > "￿" for c in text[:at])


def ranges(text: str, rules: list[tuple], limit_s: float = LIMIT_S) -> tuple[list[tuple[int, int, str]], str | None]:
    """(ranges, failure): non-empty matches of all rules (pattern, color); of two that overlap the earlier rule's stays.

    A text on which a pattern takes longer than ``limit_s`` (see ``within``) has no ranges, and failure is ``timeout``.
    """
    try:
        return within(limit_s, lambda limit: _ranges(text, rules, limit), "highlight", *(p.pattern for p, _ in rules), text), None
    except TimeoutError:
        return [], "timeout"


def _ranges(text: str, rules: list[tuple], limit_s: float) -> list[tuple[int, int, str]]:
    taken: list[tuple[int, int, str]] = []
    for pattern, color in rules:
        for m in pattern.finditer(text, timeout=limit_s):
            a, b = m.span()
            if a < b and all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, color))
    return [(utf16(text, a), utf16(text, b), c) for a, b, c in sorted(taken)]


def highlights(rows: DataFrame, rules: list[HighlightRule], limit_s: float = LIMIT_S) -> DataFrame:
    """(text, ranges, failure) for each distinct text with a highlight, or on which highlighting failed; join back by text.

    failure is null, ``timeout``, or ``error`` for every text where a rule's pattern is none.
    """

    @F.pandas_udf(f"ranges {RANGES}, failure string")
    def run(s: pd.Series) -> pd.DataFrame:
        try:
            compiled = list(zip(user_patterns(r.pattern for r in rules), (r.color for r in rules), strict=True))
        except Exception:
            return pd.DataFrame({"ranges": [[] for _ in s], "failure": "error"})
        found = [ranges(t, compiled, limit_s) for t in s]
        return pd.DataFrame({"ranges": [[{"start": a, "end": b, "color": c} for a, b, c in r] for r, _ in found], "failure": pd.Series([f for _, f in found], dtype=object)})

    texts = rows.select("text").where(F.col("text").isNotNull()).distinct()
    once = run.asNondeterministic()  # a time limit is; and Spark moves no copy of it, as a filter, below the distinct texts
    return texts.withColumn("_h", once("text")).select("text", "_h.ranges", "_h.failure").where((F.size("ranges") > 0) | F.col("failure").isNotNull())
