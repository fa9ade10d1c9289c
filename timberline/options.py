"""Options and settings errors. All are frozen and cheap to ship to executors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd


@dataclass(frozen=True)
class SettingsError:
    """A setting item that was left out: a code, and what it takes to word a message."""

    code: str
    index: int
    detail: str = ""


@dataclass(frozen=True)
class TimestampFormat:
    """A named pattern; its groups y mo d h mi s (ms tzz tzs tzh tzm) or epochMs / epochSec (ms) give the instant.

    Or ``instants`` does, for what groups cannot say: it gets a DataFrame with a row for each match, the groups as texts
    (None where one took no part) beside ``text``, all of the match, and ``offset_min``, the source's offset. It returns
    a Series of milliseconds since 1970 by the same index; a missing one refuses the match, so that the next format or field
    is tried. It is called once a batch of lines and must not depend on what else is in the batch.
    """

    name: str
    pattern: str
    instants: Callable[[pd.DataFrame], pd.Series] | None = None


@dataclass(frozen=True)
class Rule:
    """The first rule whose pattern is found in a file's name gives its value."""

    pattern: str
    value: int


@dataclass(frozen=True)
class HighlightRule:
    name: str
    pattern: str
    color: str


@dataclass(frozen=True)
class ParseOptions:
    """reference_time_ms dates log lines without a year; set it for repeatable results.

    json_lines = False takes the log to hold text alone: a line that starts with a brace is not looked at as a JSON record,
    and no line leaves the JVM.
    """

    formats: tuple[TimestampFormat, ...] = ()
    severity_tokens: tuple[str, ...] = ()
    source_offset_min: int = 0
    assumed_year: int | None = None
    reference_time_ms: int = 1_735_689_600_000
    json_lines: bool = True


@dataclass(frozen=True)
class Mask:
    timestamp: bool = False
    host: bool = False
    process_id: bool = False

    @property
    def text(self) -> bool:
        return self.host or self.process_id


COPY_MASK = Mask(timestamp=True, host=True)


@dataclass(frozen=True)
class Criteria:
    """None means no such filter; an empty set of severities keeps nothing."""

    severities: frozenset[str] | None = None
    start_ms: int | None = None
    end_ms: int | None = None
    in_range: bool = False
    match: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    files: frozenset[int] | None = None


@dataclass(frozen=True)
class Display:
    """offset_min, or the name of a zone, for shown times."""

    offset_min: int = 0
    zone: str | None = None
    gap_threshold_ms: int = 30_000
    collapse_threshold: int = 3
    max_lines: int = 20_000
    mask: Mask = field(default_factory=Mask)
