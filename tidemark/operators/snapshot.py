"""Forward fill over the global order without a single-task window.

Rows are cut into chunks at approximate quantiles of ``seq``; each chunk fills itself,
and what enters a chunk is the last value of the chunks before it, taken from a table of
one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Chunks a session's shuffle partition at least, and rows of a chunk on average at most.
CHUNKS_PER_PARTITION, CHUNK_ROWS = 2, 1_000_000


def chunk_bounds(df: DataFrame, seq: str = "seq", chunks: int | None = None) -> list[int]:
    """Inner chunk edges by approximate quantiles: chunks of ``CHUNK_ROWS`` rows, but some a shuffle partition."""
    n = chunks
    if n is None:
        n = max(CHUNKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // CHUNK_ROWS))
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(seq, [i / n for i in range(1, n)], max(1000, 4 * n)).alias("q")).first()["q"]
    return sorted(set(got or []))


def chunk_of(bounds: list[int], seq: str = "seq") -> Column:
    """The chunk of a row: how many edges lie at or below its ``seq``."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col(seq)))


def forward_fill(df: DataFrame, cells: list[str], seq: str = "seq", chunk: str = "_ck", before: bool = False) -> DataFrame:
    """``df`` (with its ``chunk`` column) with nulls of ``cells`` replaced by the last value before them;
    with ``before`` every value is replaced by the last one before its row."""
    if not cells:
        return df
    safe = [f"_c{i}" for i in range(len(cells))]
    tails = df.groupBy(chunk).agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(seq))).alias(s) for c, s in zip(cells, safe, strict=True)])
    # one row a chunk: this window is over that small table only
    earlier = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(chunk, *[F.last(s, ignorenulls=True).over(earlier).alias(s) for s in safe])
    inside = Window.partitionBy(chunk).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    joined = df.join(F.broadcast(carry), chunk, "left")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cells]
    return joined.select(*keep, *[F.coalesce(F.last(F.col(f"`{c}`"), ignorenulls=True).over(inside), F.col(s)).alias(c) for c, s in zip(cells, safe, strict=True)])
