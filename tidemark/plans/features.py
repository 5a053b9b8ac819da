"""Feature sets and their compilation: definitions, validation, grouping, names and order.

Pure Python; no session is needed until a compiled set meets a DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from ..errors import InvalidDefinition, TidemarkError
from ..events import GLOBAL, SOURCES, lower_ascii

#: Outputs that one group of compatible definitions may have.
MAX_GROUP_OUTPUTS = 16
DAY_MS = 86_400_000
MAX_OFFSET_MS = 14 * 3_600_000
_I64 = 2**63 - 1
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


class WarmupPolicy(Enum):
    FIRST_VALUE = "first_value"
    FULL_WINDOW = "full_window"


def parse_duration(text: str) -> int:
    """Milliseconds of ``<digits>(ms|s|m|h)``, outer blanks allowed."""
    m = re.fullmatch(r"\s*([0-9]+)(ms|s|m|h)\s*", text) if isinstance(text, str) else None
    if not m or (out := int(m[1]) * _UNITS[m[2]]) > _I64:
        raise TidemarkError(f"invalid duration {text!r}; expected digits and ms, s, m or h")
    return out


def parse_offset(text: str) -> int:
    """Milliseconds of ``UTC``, ``UTC+H[:MM]`` or ``+H[:MM]`` (or minus), at most 14 hours."""
    m = re.fullmatch(r"(?:UTC)?(?:([+-])([0-9]{1,2})(?::([0-9]{2}))?)?", text) if isinstance(text, str) and text else None
    if not m:
        raise TidemarkError(f"invalid UTC offset {text!r}")
    if not m[1]:
        return 0
    minutes = int(m[3] or 0)
    out = (int(m[2]) * 60 + minutes) * 60_000
    if minutes > 59 or out > MAX_OFFSET_MS:
        raise TidemarkError(f"invalid UTC offset {text!r}; at most 14:00")
    return -out if m[1] == "-" else out


#: Ranks of kinds and sources in the canonical order.
KIND_RANK = {"cvd": 0, "day_of_week": 1, "ema": 2, "obv_timed": 3, "sma": 4, "sma_timed": 5, "time_since_first_event_of_day": 6, "count_timed": 7}
SOURCE_RANK = {"price": 0, "trade_price": 1, "trade_volume": 2, "volume": 3}


@dataclass(frozen=True)
class FeatureDefinition:
    """One output cell: kind, what it reads and its window (samples, or ms with ``aggregation``)."""

    kind: str
    symbol: str | None = None
    source: str | None = None
    window: int | None = None
    aggregation: int | None = None
    offset: int | None = None
    warmup: WarmupPolicy | None = None

    @property
    def name(self) -> str:
        if self.kind == "day_of_week":
            return "clock:day_of_week"
        if self.kind == "time_since_first_event_of_day":
            return f"clock:time_since_first_event_of_day:{self.offset}ms"
        what = self.source if self.kind in ("sma", "ema", "sma_timed") else "trade"
        if self.aggregation is not None:
            return f"{self.symbol}:{what}:{self.kind}:{self.aggregation}ms:{self.window}ms"
        return f"{self.symbol}:{what}:{self.kind}:{self.window}"

    @property
    def group(self) -> tuple:
        """Definitions with one group key share their state; a timed count has one window a group."""
        own = self.window if self.kind == "count_timed" else None
        return (self.kind, self.symbol, self.source, self.aggregation, self.offset, self.warmup, own)

    @property
    def rank(self) -> tuple:
        return (self.symbol is not None, self.symbol or "", KIND_RANK[self.kind], SOURCE_RANK.get(self.source or "", -1), self.aggregation or 0, self.offset or 0)


def long_id(d: FeatureDefinition) -> str:
    """The id that spells out every field of a definition (symbol length in bytes)."""
    if d.kind == "day_of_week":
        return "day_of_week"
    if d.kind == "time_since_first_event_of_day":
        return f"time_since_first_event_of_day:utc_offset={d.offset}ms"
    head = f"{d.kind}:symbol={len((d.symbol or '').encode())}:{d.symbol}"
    src = f"field.{d.source}" if d.source in SOURCES else "event.trade"
    agg = f":aggregation={d.aggregation}ms" if d.aggregation is not None else ""
    unit = "ms" if d.aggregation is not None else ""
    return f"{head}:source={src}{agg}:window={d.window}{unit}:warmup={d.warmup.value}"


class FeatureSet:
    """Ordered feature definitions; builder calls may be chained."""

    def __init__(self) -> None:
        self._calls: list[list[FeatureDefinition]] = []

    @property
    def indicator_count(self) -> int:
        return len(self._calls)

    @property
    def output_count(self) -> int:
        return sum(map(len, self._calls))

    @property
    def definitions(self) -> list[FeatureDefinition]:
        return [d for c in self._calls for d in c]

    def _add(self, defs: list[FeatureDefinition]) -> FeatureSet:
        self._calls.append(defs)
        return self

    @staticmethod
    def _windows(windows: list) -> list:
        if not windows:
            raise TidemarkError("windows must not be empty")
        return list(windows)

    @staticmethod
    def _source(source: str) -> str:
        if source not in SOURCES:
            raise TidemarkError(f"invalid source {source!r}; expected one of {', '.join(SOURCES)}")
        return source

    def sma(self, symbol: str, windows: list[int], *, source: str = "price", warmup: WarmupPolicy = WarmupPolicy.FULL_WINDOW) -> FeatureSet:
        src = self._source(source)
        return self._add([FeatureDefinition("sma", lower_ascii(symbol), src, w, warmup=warmup) for w in self._windows(windows)])

    def ema(self, symbol: str, windows: list[int], *, source: str = "price", warmup: WarmupPolicy = WarmupPolicy.FULL_WINDOW) -> FeatureSet:
        src = self._source(source)
        return self._add([FeatureDefinition("ema", lower_ascii(symbol), src, w, warmup=warmup) for w in self._windows(windows)])

    def cvd(self, symbol: str, windows: list[int], *, warmup: WarmupPolicy = WarmupPolicy.FULL_WINDOW) -> FeatureSet:
        return self._add([FeatureDefinition("cvd", lower_ascii(symbol), None, w, warmup=warmup) for w in self._windows(windows)])

    def sma_timed(self, symbol: str, aggregation: str, windows: list[str], *, source: str = "price", warmup: WarmupPolicy = WarmupPolicy.FULL_WINDOW) -> FeatureSet:
        src, a = self._source(source), parse_duration(aggregation)
        return self._add([FeatureDefinition("sma_timed", lower_ascii(symbol), src, parse_duration(w), a, warmup=warmup) for w in self._windows(windows)])

    def obv_timed(self, symbol: str, aggregation: str, windows: list[str], *, warmup: WarmupPolicy = WarmupPolicy.FULL_WINDOW) -> FeatureSet:
        a = parse_duration(aggregation)
        return self._add([FeatureDefinition("obv_timed", lower_ascii(symbol), None, parse_duration(w), a, warmup=warmup) for w in self._windows(windows)])

    def trade_count_timed(self, symbol: str, aggregation: str, window: str, *, warmup: WarmupPolicy = WarmupPolicy.FULL_WINDOW) -> FeatureSet:
        return self._add([FeatureDefinition("count_timed", lower_ascii(symbol), None, parse_duration(window), parse_duration(aggregation), warmup=warmup)])

    def day_of_week(self) -> FeatureSet:
        return self._add([FeatureDefinition("day_of_week")])

    def time_since_first_event_of_day(self, tz: str = "UTC") -> FeatureSet:
        return self._add([FeatureDefinition("time_since_first_event_of_day", offset=parse_offset(tz))])


@dataclass(frozen=True)
class CompiledSet:
    """Cells in canonical order, and the groups that they form."""

    cells: tuple[FeatureDefinition, ...]
    groups: tuple[tuple[FeatureDefinition, ...], ...]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.cells]

    def index(self, name: str) -> int | None:
        return self.names.index(name) if name in self.names else None


def _check(i: int, d: FeatureDefinition) -> None:
    def bad(reason: str) -> None:
        raise InvalidDefinition(i, f"{d.kind}: {reason}")

    if d.kind not in KIND_RANK:
        bad("unknown kind")
    if d.kind in ("sma", "ema", "cvd"):
        if not isinstance(d.window, int) or isinstance(d.window, bool) or d.window < 1:
            bad("window must be at least 1")
        if d.kind == "ema" and d.window >= 2**64 - 1:
            bad("window is too large")
    if d.kind in ("sma", "ema", "sma_timed") and d.source not in SOURCES:
        bad("a scalar field source is required")
    if d.kind in ("cvd", "obv_timed", "count_timed") and d.source is not None:
        bad("the source must be trade events")
    if d.aggregation is not None:
        if d.aggregation < 1:
            bad("aggregation must be at least 1 ms")
        if d.window < d.aggregation:
            bad("window must not be shorter than the aggregation")
        if d.window % d.aggregation:
            bad("window must be a multiple of the aggregation")
        if d.window > _I64:
            bad("window is too long")
    if d.offset is not None and (abs(d.offset) > MAX_OFFSET_MS or d.offset % 60_000):
        bad("UTC offset must be whole minutes within 14 hours")


def compile_definitions(definitions: list[FeatureDefinition], canonical: bool = True) -> CompiledSet:
    """Validate, order and group.  Without ``canonical`` the groups keep first-seen order.

    Compatible definitions merge into one group (two warm-ups of one indicator do not, so
    they may reorder cells); outputs of a group are adjacent, in authored order."""
    for i, d in enumerate(definitions):
        _check(i, d)
    if canonical:
        definitions = sorted(definitions, key=lambda d: d.rank)
    seen_id: dict[str, int] = {}
    groups: dict[tuple, list[FeatureDefinition]] = {}
    for i, d in enumerate(definitions):
        if d.name in seen_id:
            raise InvalidDefinition(i, f"duplicate feature id {d.name}")
        seen_id[d.name] = i
        g = groups.setdefault(d.group, [])
        g.append(d)
        if len(g) > MAX_GROUP_OUTPUTS:
            raise InvalidDefinition(i, f"a group may have at most {MAX_GROUP_OUTPUTS} outputs")
    ordered = tuple(tuple(g) for g in groups.values())
    return CompiledSet(tuple(d for g in ordered for d in g), ordered)


def compile_set(fs: FeatureSet) -> CompiledSet:
    return compile_definitions(fs.definitions)


__all__ = ["GLOBAL", "CompiledSet", "FeatureDefinition", "FeatureSet", "WarmupPolicy", "compile_definitions", "compile_set", "long_id", "parse_duration", "parse_offset"]
