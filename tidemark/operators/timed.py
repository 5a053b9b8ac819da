"""Timed features on a grid of buckets: moving average, on-balance volume, trade count.

A window of ``W`` ms at time t covers the ``W / A`` buckets up to the one that holds t.  Every
cell is the sum of complete earlier buckets and the current bucket as of the row.

Earlier buckets come from a table of one row a bucket and group.  Its range windows run by group
and stretch of time as long as the longest window, with the stretch before as a halo, so no
task holds a whole group.  The current bucket comes from windows by bucket and chunk of ``seq``; what
earlier chunks of the bucket hold is carried by a table of one row a bucket and chunk.  A day in one
bucket, or buckets of a millisecond, are many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..events import KIND_TRADE, SOURCES
from ..functions.clock import floor_to
from ..plans.features import FeatureDefinition, WarmupPolicy
from .snapshot import forward_fill


def _matches(d: FeatureDefinition) -> Column:
    kind = KIND_TRADE if d.source is None else SOURCES[d.source][0]
    return (F.col("symbol") == d.symbol) & (F.col("kind") == kind)


def _value(d: FeatureDefinition) -> Column:
    return F.when(_matches(d), F.col("price" if d.source is None else SOURCES[d.source][1]))


def timed_cells(df: DataFrame, groups: list[tuple[FeatureDefinition, ...]], seq: str = "seq", chunk: str = "_ck") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` (with its ``chunk`` column) with working columns, and the column of each cell's name.

    Groups with one aggregation share a grid."""
    cells: dict[str, Column] = {}
    by_width: dict[int, list[tuple[int, tuple[FeatureDefinition, ...]]]] = {}
    for g, defs in enumerate(groups):
        by_width.setdefault(defs[0].aggregation, []).append((g, defs))
    for width, members in by_width.items():
        df = _one_width(df, width, members, cells, seq, chunk)
    return df, cells


def _grid(wide: DataFrame, b: str, width: int, members: list, chunk: str) -> DataFrame:
    """``b`` and, by group, the close before the bucket, sums over the buckets before, and the group's start."""
    closes = [f"prev_{g}" for g, _ in members]
    wide = forward_fill(wide.withColumns({f"prev_{g}": F.col(f"close_{g}") for g, _ in members}), closes, b, chunk, before=True)
    fields = ("n", "mean", "vol", "close", "prev", "seq", "first")
    stacked = wide.select(b, F.explode(F.array(*[F.struct(F.lit(g).alias("g"), *[F.col(f"{x}_{g}").alias(x) for x in fields]) for g, _ in members])).alias("s")).select(b, "s.*")
    stacked = stacked.withColumn("obv", F.coalesce(F.signum(F.col("close") - F.col("prev")) * F.col("vol"), F.lit(0.0)))
    spans = sorted({d.window for _, defs in members for d in defs})
    home = F.floor(F.col(b) / F.lit(max(spans)))
    grid = stacked.withColumn("at", F.explode(F.array(home, home + 1)))
    prior = []
    for span in spans:
        if span > width:
            w = Window.partitionBy("g", "at").orderBy(b).rangeBetween(-(span - width), -width)
            prior += [F.coalesce(F.sum("n").over(w), F.lit(0)).alias(f"n_{span}"), F.coalesce(F.sum("obv").over(w), F.lit(0.0)).alias(f"obv_{span}"),
                      F.coalesce(F.sum("mean").over(w), F.lit(0.0)).alias(f"sum_{span}"), F.count("mean").over(w).alias(f"cnt_{span}")]
        else:
            prior += [F.lit(0).cast("long").alias(f"n_{span}"), F.lit(0.0).alias(f"obv_{span}"), F.lit(0.0).alias(f"sum_{span}"), F.lit(0).cast("long").alias(f"cnt_{span}")]
    grid = grid.select(b, "g", "prev", "at", *prior).filter(F.col("at") == home).drop("at")
    starts = stacked.groupBy("g").agg(F.min("seq").alias("seq0"), F.min("first").alias("ts0"))  # one row a group of the feature set
    grid = grid.join(F.broadcast(starts), "g")
    value_cols = [c for c in grid.columns if c not in (b, "g")]
    return grid.groupBy(b).agg(*[F.max(F.when(F.col("g") == g, F.col(c))).alias(f"_{width}_{g}_{c}") for g, _ in members for c in value_cols])


def _one_width(df: DataFrame, width: int, members: list, cells: dict[str, Column], seq: str, chunk: str) -> DataFrame:
    b = f"_b{width}"
    df = df.withColumn(b, floor_to(F.col("ts"), width))
    # all groups' statistics in one aggregation, by bucket and chunk
    aggs = []
    for g, defs in members:
        m, v = _matches(defs[0]), _value(defs[0])
        at = F.when(m, F.col(seq))
        aggs += [
            F.count(at).alias(f"n_{g}"), F.sum(v).alias(f"sum_{g}"), F.sum(F.when(m, F.col("volume"))).alias(f"vol_{g}"),
            F.max_by(v, at).alias(f"close_{g}"), F.min(at).alias(f"seq_{g}"), F.min(F.when(m, F.col("ts"))).alias(f"first_{g}"),
        ]
    part = df.groupBy(b, chunk).agg(*aggs)
    whole = []
    for g, _ in members:
        n, total = F.sum(f"n_{g}"), F.sum(f"sum_{g}")
        whole += [
            n.alias(f"n_{g}"), (total / F.when(n > 0, n)).alias(f"mean_{g}"), F.sum(f"vol_{g}").alias(f"vol_{g}"),
            F.max_by(f"close_{g}", F.when(F.col(f"n_{g}") > 0, F.col(chunk))).alias(f"close_{g}"), F.min(f"seq_{g}").alias(f"seq_{g}"), F.min(f"first_{g}").alias(f"first_{g}"),
        ]
    grid = _grid(part.groupBy(b).agg(F.min(chunk).alias(chunk), *whole), b, width, members, chunk)
    # what the chunks of a bucket before this one hold
    earlier = Window.partitionBy(b).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for g, _ in members:
        p = f"_{width}_{g}_"
        carry += [F.coalesce(F.sum(f"n_{g}").over(earlier), F.lit(0)).alias(p + "cn"), F.sum(f"sum_{g}").over(earlier).alias(p + "cs"), F.sum(f"vol_{g}").over(earlier).alias(p + "cv"),
                  F.last(f"close_{g}", ignorenulls=True).over(earlier).alias(p + "cc")]
    df = df.join(part.select(b, chunk, *carry).join(grid, b), [b, chunk])
    inside = Window.partitionBy(b, chunk).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for g, defs in members:
        d0 = defs[0]
        m, v = _matches(d0), _value(d0)
        p = f"_{width}_{g}_"
        n = F.col(p + "cn") + F.count(F.when(m, F.lit(1))).over(inside)
        started = F.col(seq) >= F.col(p + "seq0")
        for d in defs:
            ready = started if d.warmup is WarmupPolicy.FIRST_VALUE else started & (F.col("ts") - F.col(p + "ts0") >= F.lit(d.window))
            if d.kind == "count_timed":
                out = (F.col(f"{p}n_{d.window}") + n).cast("double")
            elif d.kind == "obv_timed":
                close = F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(p + "cc"))
                volume = zero(F.col(p + "cv")) + zero(F.sum(F.when(m, F.col("volume"))).over(inside))
                out = F.col(f"{p}obv_{d.window}") + zero(F.signum(close - F.col(p + "prev")) * volume)
            else:
                total = zero(F.col(p + "cs")) + zero(F.sum(v).over(inside))
                means = F.col(f"{p}sum_{d.window}") + zero(total / F.when(n > 0, n))
                some = F.col(f"{p}cnt_{d.window}") + (n > 0).cast("long")
                out = means / F.when(some > 0, some)
            cells[d.name] = F.when(ready, out)
    return df
