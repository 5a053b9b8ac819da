"""Clock features: functions of the event's time (epoch ms, UTC) alone or of its day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def floor_to(ts: Column, width: int) -> Column:
    """Start of the epoch-aligned slot that holds ``ts``; also right for negative times."""
    return ts - F.pmod(ts, F.lit(width).cast("long"))


def day_of_week(ts: Column) -> Column:
    """0 is Sunday."""
    days = (floor_to(ts, DAY_MS) / F.lit(DAY_MS)).cast("long")
    return F.pmod(days + 4, F.lit(7).cast("long")).cast("double")


def local_day(ts: Column, offset: int = 0) -> Column:
    return floor_to(ts + F.lit(offset).cast("long"), DAY_MS)


def with_time_since_first_event_of_day(df: DataFrame, name: str, offset: int = 0, ts: str = "ts") -> DataFrame:
    """``df`` with the milliseconds since the first event of the offset-local day.

    Times do not decrease along ``seq``, so the day's minimum is its first event's.  Rows are not moved: what
    is broadcast has one row a calendar day, 3.7 million in ten thousand years."""
    day = f"_day{offset}".replace("-", "m")
    first = df.groupBy(local_day(F.col(ts), offset).alias(day)).agg(F.min(ts).alias("_first"))
    joined = df.withColumn(day, local_day(F.col(ts), offset)).join(F.broadcast(first), day, "left")
    return joined.withColumn(name, F.greatest(F.col(ts) - F.col("_first"), F.lit(0).cast("long")).cast("double")).drop(day, "_first")
