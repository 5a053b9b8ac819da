"""The extractor on a stream, with batch results.

Whole-vector rows need the one global order, so all events share one key and its state is
one Stepper; ``by_symbol`` trades that for parallelism: each symbol is a key, rows carry that
symbol's cells, and clock ticks must be fanned out to every symbol upstream.

An event earlier than what was seen stops the query (``late='error'``) or is dropped and
counted in the state (``late='reject'``); a watermark would drop it silently.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidEvent, TidemarkError
from ..events import as_events
from ..plans.features import CompiledSet, FeatureSet, compile_set
from ..stepper import Stepper


_FIELDS = ("price", "volume", "side", "bid", "ask")
#: Rows that are Python objects at a time.
SLICE_ROWS = 10_000


def stream_features(events: DataFrame, features: FeatureSet | CompiledSet, late: str = "error", by_symbol: bool = False) -> DataFrame:
    """``seq, symbol, ts`` and all cells for each event of a streaming DataFrame (or a batch one)."""
    if late not in ("error", "reject"):
        raise TidemarkError("late must be 'error' or 'reject'")
    compiled = features if isinstance(features, CompiledSet) else compile_set(features)
    names = compiled.names
    schema = "seq long, symbol string, ts long, " + ", ".join(f"`{n}` double" for n in names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stepper, rejected = pickle.loads(state.get[0]) if state.exists else (Stepper(compiled), 0)
        held = pd.concat(list(batches), ignore_index=True)  # one micro-batch of one key, to be put in order
        order = held["seq"].to_numpy().argsort(kind="stable")
        for at in range(0, len(order), SLICE_ROWS):
            part = held.iloc[order[at : at + SLICE_ROWS]]
            part = part.astype(object).where(part.notna(), None)
            rows = []
            for seq, kind, symbol, ts, *fields in zip(*[part[c].tolist() for c in ("seq", "kind", "symbol", "ts", *_FIELDS)], strict=True):
                try:
                    stepper.update(int(kind), symbol, int(ts), **dict(zip(_FIELDS, fields, strict=True)))
                except InvalidEvent:
                    if late == "error":
                        raise
                    rejected += 1
                    continue
                rows.append([seq, symbol, ts, *stepper.values()])
            yield pd.DataFrame(rows, columns=["seq", "symbol", "ts", *names]).astype({n: "float64" for n in names})
        state.update((pickle.dumps((stepper, rejected)),))

    keyed = as_events(events).withColumn("_key", F.col("symbol") if by_symbol else F.lit(0))
    return keyed.groupBy("_key").applyInPandasWithState(step, schema, "s binary", "append", "NoTimeout")
