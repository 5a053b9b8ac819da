"""Validation of input rows: what is wrong with an event, and whether order holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidEvent
from ..events import KIND_ORDERBOOK, KIND_PRICE, KIND_TIME, KIND_TRADE, KIND_VOLUME
from ..operators.snapshot import chunk_bounds, chunk_of


def _bad_number(c: str, positive: bool) -> Column:
    v = F.col(c)
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.coalesce(bad | (v <= 0) if positive else bad, F.lit(False))


def problem(positive: bool = False, strict_side: bool = False) -> Column:
    """The first fault of an event row as text, null if there is none."""
    k = F.col("kind")

    def needs(kinds: tuple[int, ...], c: str) -> Column:
        return k.isin(*kinds) & F.col(c).isNull()

    price, volume = (KIND_PRICE, KIND_TRADE), (KIND_VOLUME, KIND_TRADE)
    checks = [
        (F.col("seq").isNull(), "seq is null"),
        (k.isNull() | ~k.isin(KIND_PRICE, KIND_VOLUME, KIND_TRADE, KIND_ORDERBOOK, KIND_TIME), "unknown event kind"),
        ((k != KIND_TIME) & (F.col("symbol").isNull() | (F.col("symbol") == "")), "symbol must be a non-empty string"),
        (F.col("ts").isNull(), "timestamp is null"),
        (needs(price, "price"), "event kind requires the `price` column"),
        (needs(volume, "volume"), "event kind requires the `volume` column"),
        (needs((KIND_ORDERBOOK,), "bid"), "event kind requires the `bid` column"),
        (needs((KIND_ORDERBOOK,), "ask"), "event kind requires the `ask` column"),
        (k.isin(*price) & _bad_number("price", positive), "price must be finite" + " and positive" * positive),
        (k.isin(*volume) & _bad_number("volume", positive), "volume must be finite" + " and positive" * positive),
        (F.col("side").isNotNull() & ~F.col("side").isin(0, 1), "side must be 0 or 1"),
    ]
    if strict_side:
        checks.append(((k == KIND_TRADE) & F.col("side").isNull(), "side is null"))
    out = F.lit(None).cast("string")
    for cond, text in reversed(checks):
        out = F.when(cond, F.lit(text)).otherwise(out)
    return out


def order_violations(df: DataFrame, chunks: int | None = None) -> DataFrame:
    """``seq, ts, previous`` of rows whose time lies before an earlier row's, by chunks of ``seq``."""
    ck = df.select("seq", "ts").withColumn("_ck", chunk_of(chunk_bounds(df, chunks=chunks)))
    top = ck.groupBy("_ck").agg(F.max("ts").alias("t"))
    before = Window.orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    carry = top.select("_ck", F.max("t").over(before).alias("_carry"))
    inside = Window.partitionBy("_ck").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = ck.join(F.broadcast(carry), "_ck").withColumn("previous", F.greatest(F.max("ts").over(inside), F.col("_carry")))
    return seen.filter(F.col("previous") > F.col("ts")).select("seq", "ts", "previous")


def duplicate_seqs(df: DataFrame) -> DataFrame:
    return df.groupBy("seq").count().filter("count > 1")


def validate(df: DataFrame, positive: bool = False, strict_side: bool = False) -> None:
    """Raise InvalidEvent for the first bad row; the whole input is looked at before anything is computed."""
    bad = df.withColumn("_p", problem(positive, strict_side)).filter("_p is not null").orderBy("seq").select("seq", "_p").first()
    if bad:
        raise InvalidEvent(f"row {bad['seq']}: {bad['_p']}")
    twice = duplicate_seqs(df).orderBy("seq").first()
    if twice:
        raise InvalidEvent(f"row {twice['seq']}: seq is not unique")
    late = order_violations(df).orderBy("seq").first()
    if late:
        raise InvalidEvent(f"row {late['seq']}: timestamp {late['ts']} is before {late['previous']}")
