"""Readers that turn files into events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..events import KIND_TRADE, SIDE_BUY, SIDE_SELL, as_events, to_millis

TRADES_CSV = {"symbol": "string", "ts": "long", "price": "double", "volume": "double"}
EXCHANGE_CSV = {"symbol": "string", "trade_id": "long", "price": "double", "quantity": "double", "trade_time": "string", "buyer_market_maker": "boolean"}


def _csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns by their names in the header, whatever their order."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trade rows in file order; ``seq`` is the row's place in its file's order."""
    return _csv(spark, path, TRADES_CSV).withColumn("seq", F.monotonically_increasing_id())


def read_exchange_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exchange trades in any order; ``seq`` follows (trade time, trade id) per symbol file.

    Times carry their offset (``2026-06-16 09:32:28.834000 +00:00``).  A buyer who is the maker was hit by a seller."""
    df = _csv(spark, path, EXCHANGE_CSV)
    return exchange_trades(df.withColumn("trade_time", F.regexp_replace("trade_time", " ([+-])", "$1").cast("timestamp")))


def exchange_trades(df: DataFrame) -> DataFrame:
    side = F.when(F.col("buyer_market_maker"), SIDE_SELL).otherwise(SIDE_BUY)
    out = df.select(F.col("trade_id"), F.lit(KIND_TRADE).alias("kind"), "symbol", to_millis("trade_time").alias("ts"), "price", F.col("quantity").alias("volume"), side.alias("side"))
    return as_events(out.withColumn("seq", global_order(out, ["ts", "trade_id", "symbol"])))


#: Rows of one time stamp that an order can tell apart.
TIES = 1_000_000


def global_order(df: DataFrame, by: list[str]):
    """A unique, increasing number along ``by``: rank within the millisecond above the time itself.

    Order needs no global sort: time is the high part, and ties are ranked per time stamp.  More
    than ``TIES`` rows of one time stamp raise an error, for numbers would meet those of the next."""
    w = Window.partitionBy(by[0]).orderBy(*by[1:])
    rank = F.row_number().over(w)
    checked = F.when(rank < TIES, rank).otherwise(F.raise_error(F.lit(f"over {TIES - 1} rows of one time stamp")).cast("int"))
    return F.col(by[0]) * F.lit(TIES) + checked


def live_messages(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of text lines from a socket: the near end of a bridge to an exchange's feed."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def parse_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trade events of JSON messages, batch or stream; other messages and broken ones are left out.

    Fields: ``e`` the kind (trade), ``s`` symbol, ``t`` trade id, ``p`` price, ``q`` quantity, ``T`` trade time in ms, ``m`` whether
    the buyer is the maker.  ``seq`` is the trade's time above its id's last digits, so it follows the exchange's
    order within a symbol."""
    field = lambda k: F.get_json_object(F.col(column), f"$.{k}")  # noqa: E731  names differ by case only: T and t
    got = lines.filter(field("e") == "trade").select(
        (field("T").cast("long") * F.lit(TIES) + F.pmod(field("t").cast("long"), F.lit(TIES))).alias("seq"), F.lit(KIND_TRADE).alias("kind"), field("s").alias("symbol"),
        field("T").cast("long").alias("ts"), field("p").cast("double").alias("price"), field("q").cast("double").alias("volume"),
        F.when(field("m") == "true", SIDE_SELL).otherwise(SIDE_BUY).alias("side"),
    )
    return as_events(got)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with the event columns."""
    return as_events(spark.read.parquet(path))


def bind_events(df: DataFrame) -> DataFrame:
    """Trades from an application's event log ``(event_id, ts, user_id, event_type, value, props)``.

    symbol: event type; price: value; volume: ``k % 10 + 1`` and side: ``k % 3`` (2 is
    unclassified) with k from the properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    return as_events(
        df.select(
            F.col("event_id").alias("seq"), F.lit(KIND_TRADE).alias("kind"), F.col("event_type").alias("symbol"), to_millis("ts").alias("ts"), F.col("value").alias("price"),
            (k % 10 + 1).cast("double").alias("volume"), F.when(k % 3 < 2, k % 3).cast("int").alias("side"),
        )
    )


def bind_mixed(df: DataFrame) -> DataFrame:
    """The same rows with all event kinds: kind is ``event_id % 5``."""
    t = bind_events(df)
    kind = F.pmod(F.col("seq"), F.lit(5)).cast("int")
    rows = t.select(
        "seq", kind.alias("kind"), "symbol", "ts", F.when(kind.isin(0, 2), F.col("price")).alias("price"), F.when(kind.isin(1, 2), F.col("volume")).alias("volume"),
        F.when(kind == 2, F.col("side")).alias("side"), F.when(kind == 3, F.col("price") - 1).alias("bid"), F.when(kind == 3, F.col("price") + 1).alias("ask"),
    )
    return as_events(rows)
