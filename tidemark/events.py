"""The event model: one row per input event, totally ordered by a unique ``seq``.

Columns: ``seq long, kind int, symbol string, ts long (epoch ms), price double, volume
double, side int, bid double, ask double``; what a kind does not use is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TidemarkError

KIND_PRICE, KIND_VOLUME, KIND_TRADE, KIND_ORDERBOOK, KIND_TIME = range(5)
SIDE_BUY, SIDE_SELL = 0, 1
#: The symbol of clock ticks; a symbol spelled like this is the same.
GLOBAL = "__global__"

SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("side", T.IntegerType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
    ]
)
#: source name -> (event kind, payload column)
SOURCES = {
    "price": (KIND_PRICE, "price"),
    "volume": (KIND_VOLUME, "volume"),
    "trade_price": (KIND_TRADE, "price"),
    "trade_volume": (KIND_TRADE, "volume"),
}
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(name: str) -> str:
    return name.translate(str.maketrans(_UP, _LOW))


def normalize_symbol(c: Column | str) -> Column:
    """ASCII lower case; other letters keep their case, unlike ``lower``."""
    return F.translate(F.col(c) if isinstance(c, str) else c, _UP, _LOW)


def to_millis(c: Column | str) -> Column:
    """Epoch milliseconds of a timestamp; TIMESTAMP_NTZ is read as UTC wall time."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_millis(c.cast("timestamp"))


def extract_field(source: str) -> Column:
    """The value that ``source`` takes from an event row, null where the kind is another."""
    kind, column = SOURCES[source]
    return F.when(F.col("kind") == kind, F.col(column))


def route(df: DataFrame, symbol: str | None = None, kind: int | None = None) -> DataFrame:
    """Events of a symbol and kind; None passes all (the routing of timed and clock features)."""
    if symbol is not None:
        df = df.filter(normalize_symbol("symbol") == lower_ascii(symbol))
    if kind is not None:
        df = df.filter(F.col("kind") == kind)
    return df


def as_events(df: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with exactly the event columns (and those of ``keep``): missing ones null, symbols normalised, clock ticks global."""
    cols = []
    for f in SCHEMA.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name == "symbol":
            c = F.when(F.col("kind") == KIND_TIME, F.lit(GLOBAL)).otherwise(normalize_symbol(c))
        cols.append(c.alias(f.name))
    return df.select(*cols, *keep)


def trades(df: DataFrame, seq: str = "seq", symbol: str = "symbol", time: str = "ts", price: str = "price", volume: str = "volume", side: str | None = None,
           keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Trade events from a frame with its own column names; ``side`` must hold integers, which are not rounded to codes."""
    if side and dict(df.dtypes)[side] not in ("tinyint", "smallint", "int", "bigint"):
        raise TidemarkError(f"column {side} must hold side codes")
    return as_events(
        df.select(
            F.col(seq).alias("seq"), F.lit(KIND_TRADE).alias("kind"), F.col(symbol).alias("symbol"), F.col(time).alias("ts"),
            F.col(price).alias("price"), F.col(volume).alias("volume"), (F.col(side) if side else F.lit(None)).cast("int").alias("side"), *keep,
        ), keep,
    )
