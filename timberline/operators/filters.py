"""Filters over entries: every given criterion must hold. They see unmasked text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from timberline.functions.patterns import LIMIT_S, UserPattern, user_patterns, within
from timberline.operators.parse import raw_text
from timberline.options import Criteria
from timberline.sources.storage import staged


def severity_in(severities) -> Column:
    """Unrecognised severity counts as the empty string; an empty set keeps nothing."""
    return F.coalesce(F.col("severity"), F.lit("")).isin(sorted(severities)) if severities else F.lit(False)


def in_range(start_ms: int | None, end_ms: int | None) -> Column:
    """Both bounds belong to the range; entries without a time are outside."""
    c = F.col("timestamp_ms").isNotNull()
    c = c & (F.col("timestamp_ms") >= start_ms) if start_ms is not None else c
    return c & (F.col("timestamp_ms") <= end_ms) if end_ms is not None else c


def _safe(patterns) -> tuple[list[UserPattern], list[str]]:
    """The patterns that run on the JVM, and those that need a time limit."""
    safe = [p for p in patterns if getattr(p, "java", None)]
    return safe, [p for p in patterns if not getattr(p, "java", None)]


def _may_hold(text: Column, patterns) -> Column | None:
    """Whether a text holds what every match of one of the patterns holds; None where one of them asks for nothing."""
    if not all(getattr(p, "literal", "") for p in patterns):
        return None
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p.literal.lower())) if p.caseless else F.contains(text, F.lit(p.literal)) for p in patterns))


def searched(text: Column, patterns: tuple[str, ...], limit_s: float = LIMIT_S, gate: Column | None = None) -> Column:
    """struct(found, failure): whether any of the users' patterns is found; on the JVM those that are safe there.

    The others run under a time limit, on texts that hold their literals. ``failure`` is ``timeout`` where a search takes
    longer than ``limit_s`` (and than four times that when it is tried again), ``error`` where a pattern is none. After the
    first failure a task searches no further text, as the result will not be used. Where ``gate`` is not true nothing is found.
    """
    safe, timed = _safe(patterns)
    gate = F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    here = gate & reduce(lambda a, b: a | b, (F.coalesce(text.rlike(p.java), F.lit(False)) for p in safe), F.lit(False))
    if not timed:
        return F.struct(here.alias("found"), F.lit(None).cast("string").alias("failure"))

    @F.pandas_udf("found boolean, failure string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled, failure = [], None
        try:
            compiled = user_patterns(timed)
        except Exception:
            failure = "error"
        for s in batches:
            out = []
            for t in s:
                found = False
                if t is not None and failure is None:
                    try:
                        found = any(within(limit_s, lambda limit, p=p: p.search(t, timeout=limit)) for p in compiled)
                    except TimeoutError:
                        failure = "timeout"
                out.append((found, None if t is None else failure))
            yield pd.DataFrame(out, columns=["found", "failure"], dtype=object)

    may = _may_hold(text, timed)
    there = run(F.when(gate & ~here if may is None else gate & ~here & may, text))
    return F.struct((here | F.coalesce(there["found"], F.lit(False))).alias("found"), there["failure"].alias("failure"))


def found_in(text: Column, patterns: tuple[str, ...], limit_s: float = LIMIT_S) -> Column:
    """Whether any of the users' patterns is found.

    A search that takes too long fails the query: unfiltered rows are never shown in its place. ``with_fallback`` has the
    other answer to it.
    """
    r = searched(text, patterns, limit_s)
    if not _safe(patterns)[1]:
        return r["found"]
    return F.when(r["failure"].isNull(), r["found"]).otherwise(F.raise_error(F.concat(F.lit("a pattern could not be searched for: regex timed out or failed: "), r["failure"])).cast("boolean"))


def _cheap(entries: DataFrame, c: Criteria) -> DataFrame:
    plain = []
    if c.files is not None:
        plain.append(F.col("file_index").isin(sorted(c.files)) if c.files else F.lit(False))
    if c.severities is not None:
        plain.append(severity_in(c.severities))
    if c.in_range:
        plain.append(in_range(c.start_ms, c.end_ms))
    return entries.where(reduce(lambda a, b: a & b, plain)) if plain else entries


def apply(entries: DataFrame, c: Criteria) -> DataFrame:
    """Cheap conjuncts first; pattern filters run on what they leave."""
    entries = _cheap(entries, c)
    if c.match:
        entries = entries.where(found_in(F.col("message"), c.match))
    if c.ignore:
        entries = entries.where(~found_in(raw_text(), c.ignore))
    return entries


def with_fallback(entries: DataFrame, c: Criteria, limit_s: float = LIMIT_S) -> tuple[DataFrame, str | None]:
    """(rows, failure): the entries that meet all criteria; or, if a pattern fails on any of them, those that meet the
    criteria without match and ignore, and the reason (``timeout`` or ``error``).

    Where all patterns are safe nothing can fail and the rows are lazy. Else the rows are written, once, with the
    failures counted on the way.
    """
    if not _safe(c.match)[1] and not _safe(c.ignore)[1]:
        return apply(entries, c), None
    cheap = _cheap(entries, c)
    e = cheap.withColumn("_match", searched(F.col("message"), c.match, limit_s) if c.match else _all_found())
    e = e.withColumn("_ignore", searched(raw_text(), c.ignore, limit_s, gate=F.col("_match.found")) if c.ignore else _all_found(False))
    failure, seen = F.coalesce("_match.failure", "_ignore.failure"), Observation()
    e = e.observe(seen, F.count_if(failure.isNotNull()).alias("n"), F.min(failure).alias("reason"))
    kept = staged(e.where(F.col("_match.found") & ~F.col("_ignore.found")).drop("_match", "_ignore"), "filtered")
    return (cheap, seen.get["reason"]) if seen.get["n"] else (kept, None)


def _all_found(found: bool = True) -> Column:
    return F.struct(F.lit(found).alias("found"), F.lit(None).cast("string").alias("failure"))
