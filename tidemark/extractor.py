"""The extractor: a compiled feature set over a DataFrame of events, one wide row an event."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import TidemarkError
from .events import KIND_TRADE, SOURCES, as_events, lower_ascii, trades
from .functions.clock import day_of_week, with_time_since_first_event_of_day
from .operators.sample import classified, ema, frame_column
from .operators.snapshot import chunk_bounds, chunk_of, forward_fill
from .operators.timed import timed_cells
from .plans.features import CompiledSet, FeatureDefinition, FeatureSet, WarmupPolicy, compile_set
from .plans.validate import validate

_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_NUMBERS = (*_INTEGERS, "float", "double", "decimal")
TIMED = ("sma_timed", "obv_timed", "count_timed")


class FeatureExtractor:
    """Batch form of the engine; plans are immutable, so calls do not see each other's events."""

    def __init__(self, features: FeatureSet | CompiledSet, output_dtype: str = "float64"):
        if output_dtype not in ("float32", "float64"):
            raise TidemarkError(f"invalid output dtype {output_dtype!r}; expected float32 or float64")
        self.compiled = features if isinstance(features, CompiledSet) else compile_set(features)
        self.output_dtype = output_dtype

    def feature_names(self) -> list[str]:
        return self.compiled.names

    def n_features(self) -> int:
        return len(self.compiled.cells)

    def feature_index(self, name: str) -> int | None:
        return self.compiled.index(name)

    # -- entry points --

    def transform(self, events: DataFrame, check: bool = True) -> DataFrame:
        """``seq, symbol, ts`` and all cells, one row an event of any kind."""
        ev = as_events(events)
        if check:
            validate(ev)
        return self._cells(ev)

    def compute_features(self, df: DataFrame, *, seq: str = "seq", symbol: str = "symbol", time: str = "ts", price: str = "price", volume: str = "volume",
                         side: str | None = None, check: bool = True, strict_side: bool = False) -> DataFrame:
        """The same over a frame of trades; ``seq``, symbol and time keep the caller's names and spelling."""
        names = [seq, symbol, time, price, volume, *([side] if side else [])]
        if any(not isinstance(n, str) for n in names):
            raise TidemarkError("column names must be strings")
        if len(set(names)) != len(names):
            raise TidemarkError("column names must be distinct")
        if missing := [n for n in names if n not in df.columns]:
            raise TidemarkError(f"missing columns: {', '.join(missing)}")
        if clash := {seq, symbol, time} & set(self.feature_names()):
            raise TidemarkError(f"feature and column names collide: {', '.join(sorted(clash))}")
        types = dict(df.dtypes)
        for names, fit, what in (([time], _INTEGERS, "integers"), ([symbol], ("string",), "strings"), ([price, volume], _NUMBERS, "integers or floats"), ([side] if side else [], _INTEGERS, "side codes")):
            if wrong := [n for n in names if types[n].split("(")[0] not in fit]:
                raise TidemarkError(f"column {wrong[0]} must hold {what}")
        if deaf := [d.name for d in self.compiled.cells if d.source in SOURCES and SOURCES[d.source][0] != KIND_TRADE]:
            warnings.warn(f"trades never update these features: {', '.join(deaf)}", stacklevel=2)
        ev = trades(df.withColumn("_symbol", F.col(symbol)), seq, symbol, time, price, volume, side, keep=["_symbol"])
        if check:
            validate(ev, positive=True, strict_side=strict_side and side is not None)
        out = self._cells(ev, ["_symbol"])
        return out.select(F.col("seq").alias(seq), F.col("_symbol").alias(symbol), F.col("ts").alias(time), *[F.col(f"`{n}`") for n in self.feature_names()])

    def invocations(self, events: DataFrame) -> DataFrame:
        """``seq, updated``: how many groups each event updates."""
        hits = []
        for g in self.compiled.groups:
            d = g[0]
            if d.kind in ("sma", "ema"):
                hits.append((F.col("symbol") == d.symbol) & (F.col("kind") == SOURCES[d.source][0]))
            elif d.kind == "cvd":
                hits.append((F.col("symbol") == d.symbol) & classified())
            else:
                hits.append(F.lit(True))
        total = sum((F.coalesce(h, F.lit(False)).cast("long") for h in hits), F.lit(0).cast("long"))
        return as_events(events).select("seq", total.alias("updated"))

    def values(self, events: DataFrame) -> DataFrame:
        """The last row: the vector after all events."""
        out = self.transform(events)
        return out.orderBy(F.desc("seq")).limit(1).select(*[F.col(f"`{n}`") for n in self.feature_names()])

    # -- plan --

    def _cells(self, ev: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
        cells = self.compiled.cells
        sample = [d for d in cells if d.kind in ("sma", "cvd", "ema")]
        timed = [g for g in self.compiled.groups if g[0].kind in TIMED]
        work = ev
        filled: list[str] = []
        if sample or timed:
            work = work.withColumn("_ck", chunk_of(chunk_bounds(ev)))
        if sample:
            work = self._with_ema(work, [d for d in sample if d.kind == "ema"])
            kept = [F.col(f"`{c}`") for c in work.columns]
            frames: dict[tuple, str] = {}  # one window of a source and length serves all symbols
            for d in sample:
                if d.kind != "ema" and (f := self._frame(d)) not in frames:
                    frames[f] = f"_f{len(frames)}"
                    work = frame_column(work, frames[f], *f)
            work = work.select(*kept, *[self._hit(d, frames[self._frame(d)]).alias(d.name) for d in sample if d.kind != "ema"])
            filled = [d.name for d in sample]
            work = forward_fill(work, filled)
        work, by_name = timed_cells(work, timed) if timed else (work, {})
        for d in cells:
            if d.kind == "time_since_first_event_of_day":
                work = with_time_since_first_event_of_day(work, f"_since{d.offset}", d.offset)
        out = []
        for d in cells:
            if d.kind == "day_of_week":
                c = day_of_week(F.col("ts"))
            elif d.kind == "time_since_first_event_of_day":
                c = F.col(f"`_since{d.offset}`")
            else:
                c = by_name.get(d.name, F.col(f"`{d.name}`"))
            out.append((c.cast("float") if self.output_dtype == "float32" else c.cast("double")).alias(d.name))
        return work.select("seq", "symbol", "ts", *carry, *out)

    @staticmethod
    def _frame(d: FeatureDefinition) -> tuple:
        return d.kind, None if d.kind == "cvd" else SOURCES[d.source][1], d.window, d.warmup is WarmupPolicy.FULL_WINDOW

    @staticmethod
    def _hit(d: FeatureDefinition, frame: str) -> Column:
        hit = classified() if d.kind == "cvd" else F.col("kind") == SOURCES[d.source][0]
        return F.when(hit & (F.col("symbol") == d.symbol), F.col(frame))

    @staticmethod
    def _with_ema(work: DataFrame, defs: list[FeatureDefinition]) -> DataFrame:
        """One EMA column a cell; each source is one pass over its matching rows."""
        for source in dict.fromkeys(d.source for d in defs):
            mine = [d for d in defs if d.source == source]
            kind, column = SOURCES[source]
            symbols = sorted({d.symbol for d in mine})
            rows = work.filter((F.col("kind") == kind) & F.col("symbol").isin(symbols)).select("symbol", "seq", "_ck", F.col(column).alias("v"))
            spans = sorted({d.window for d in mine})
            got = ema(rows, ["symbol"], "v", spans).select(F.col("seq").alias("_s"), F.col("symbol").alias("_y"), "_n", *[f"ema_{n}" for n in spans])
            work = work.join(got, work["seq"] == got["_s"], "left")
            cols = {}
            for d in mine:
                value = F.when(F.col("_n") >= d.window, F.col(f"ema_{d.window}")) if d.warmup is WarmupPolicy.FULL_WINDOW else F.col(f"ema_{d.window}")
                cols[d.name] = F.when(F.col("_y") == d.symbol, value)
            work = work.withColumns(cols).drop("_s", "_y", "_n", *[f"ema_{n}" for n in spans])
        return work


def symbol_columns(names: list[str], symbol: str) -> list[str]:
    """The cells of one symbol among feature names."""
    return [n for n in names if n.startswith(lower_ascii(symbol) + ":")]
