"""The engine one event at a time: state that fits a streaming state store.

Same definitions, names and results as the batch plans; the state is plain Python.
"""

from __future__ import annotations

from collections import deque
from itertools import islice

from .errors import InvalidEvent
from .events import KIND_ORDERBOOK, KIND_PRICE, KIND_TIME, KIND_TRADE, KIND_VOLUME, SIDE_BUY, SOURCES, lower_ascii
from .plans.features import DAY_MS, CompiledSet, FeatureDefinition, FeatureSet, WarmupPolicy, compile_set


class _Group:
    """State of one group of compatible definitions."""

    def __init__(self, defs: tuple[FeatureDefinition, ...]):
        self.defs, d = defs, defs[0]
        self.kind, self.symbol, self.full = d.kind, d.symbol, d.warmup is WarmupPolicy.FULL_WINDOW
        self.event, self.field = (KIND_TRADE, None) if d.source is None else SOURCES[d.source]
        self.count = 0
        self.first: int | None = None
        self.longest = max((x.window or 0) for x in defs)
        self.recent: deque = deque(maxlen=self.longest if self.kind in ("sma", "cvd") else None)
        self.ema: list[float | None] = [None] * len(defs)
        self.day: int | None = None
        self.day_first = 0

    def cells(self, kind: int, symbol: str | None, ts: int, price, volume, side) -> list[float | None] | None:
        """New values of the group's cells; None leaves them as they are."""
        if self.kind == "day_of_week":
            return [float((ts // DAY_MS + 4) % 7)]
        if self.kind == "time_since_first_event_of_day":
            day = (ts + self.defs[0].offset) // DAY_MS
            if day != self.day:
                self.day, self.day_first = day, ts
            return [float(max(0, ts - self.day_first))]
        hit = kind == self.event and symbol == self.symbol
        if self.kind in ("sma_timed", "obv_timed", "count_timed"):
            return self._timed(hit, ts, price, volume)
        if not hit or (self.kind == "cvd" and side is None):
            return None
        self.count += 1
        if self.kind == "ema":
            v = price if self.field == "price" else volume
            for i, d in enumerate(self.defs):
                a, last = 2.0 / (d.window + 1), self.ema[i]
                self.ema[i] = v if last is None else v * a + last * (1 - a)
            return [self._if_ready(d, x) for d, x in zip(self.defs, self.ema, strict=True)]
        if self.kind == "cvd":
            self.recent.append(volume if side == SIDE_BUY else -volume)
        else:
            self.recent.append(price if self.field == "price" else volume)
        out = []
        for d in self.defs:
            n = min(d.window, len(self.recent))
            total = sum(islice(self.recent, len(self.recent) - n, None))
            out.append(self._if_ready(d, total if self.kind == "cvd" else total / n))
        return out

    def _if_ready(self, d: FeatureDefinition, value: float | None) -> float | None:
        return value if not self.full or self.count >= d.window else None

    def _timed(self, hit: bool, ts: int, price, volume) -> list[float | None]:
        a = self.defs[0].aggregation
        b = ts - ts % a
        if hit:
            self.first = ts if self.first is None else self.first
            v = volume if self.field == "volume" else price
            if not self.recent or self.recent[-1][0] != b:
                self.recent.append([b, 0, 0.0, 0.0, None])  # bucket, rows, sum, volume, close
            r = self.recent[-1]
            r[1] += 1
            r[2] += v
            r[3] += volume if volume is not None else 0.0
            r[4] = v
        while len(self.recent) > 1 and self.recent[1][0] + self.longest <= b:
            self.recent.popleft()  # one older bucket stays: its close is the next one's reference
        out = []
        for d in self.defs:
            if self.first is None or (self.full and ts - self.first < d.window):
                out.append(None)
                continue
            live = [i for i, r in enumerate(self.recent) if r[0] + d.window > b]
            if self.kind == "count_timed":
                out.append(float(sum(self.recent[i][1] for i in live)))
            elif self.kind == "obv_timed":
                total = 0.0
                for i in live:
                    if i:
                        x, y = self.recent[i][4], self.recent[i - 1][4]
                        total += self.recent[i][3] * ((x > y) - (x < y))
                out.append(total)
            else:
                out.append(sum(self.recent[i][2] / self.recent[i][1] for i in live) / len(live) if live else None)
        return out


class Stepper:
    """``update`` one event, read ``values``; an order error leaves the state as it was."""

    def __init__(self, features: FeatureSet | CompiledSet):
        self.compiled = features if isinstance(features, CompiledSet) else compile_set(features)
        self.groups = [_Group(g) for g in self.compiled.groups]
        self.last: int | None = None
        self._values: list[float | None] = [None] * len(self.compiled.cells)

    def update(self, kind: int, symbol: str | None, ts: int, *, price=None, volume=None, side=None, bid=None, ask=None) -> int:
        """Take one event; how many groups it updated."""
        need = {KIND_PRICE: ("price",), KIND_VOLUME: ("volume",), KIND_TRADE: ("price", "volume"), KIND_ORDERBOOK: ("bid", "ask"), KIND_TIME: ()}
        if kind not in need:
            raise InvalidEvent(f"unknown event kind {kind}")
        have = {"price": price, "volume": volume, "bid": bid, "ask": ask}
        for c in need[kind]:
            if have[c] is None:
                raise InvalidEvent(f"event kind requires the `{c}` column")
        if side not in (None, 0, 1):
            raise InvalidEvent("side must be 0 or 1")
        if self.last is not None and ts < self.last:
            raise InvalidEvent(f"timestamp {ts} is before {self.last}")
        self.last = ts
        name = None if kind == KIND_TIME or symbol is None else lower_ascii(symbol)
        at = updated = 0
        for g in self.groups:
            new = g.cells(kind, name, ts, price, volume, side)
            if new is not None:
                self._values[at : at + len(new)] = new
                updated += 1
            at += len(g.defs)
        return updated

    def values(self) -> list[float | None]:
        return list(self._values)
