"""Sample features: values that change on matching events only (SMA, CVD, EMA).

One window specification by (symbol, kind) serves every symbol and window length of the
set.  EMA is a linear recurrence: runs of rows are scanned from zero on their own, and
runs are chained by a table of one row a symbol and chunk, so a hot symbol is many tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..events import KIND_TRADE, SIDE_BUY, SIDE_SELL


def _ready(value: Column, count: Column, n: int, full: bool) -> Column:
    return F.when(count >= n, value) if full else value


def moving_average(value: Column, keys: list[Column | str], n: int, full: bool, seq: str = "seq") -> Column:
    """Mean of the last ``n`` rows of the same keys."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(-(n - 1), 0)
    return _ready(F.avg(value).over(w), F.count(value).over(w), n, full)


def volume_delta(keys: list[Column | str], n: int, full: bool, seq: str = "seq") -> Column:
    """Sum of the last ``n`` signed volumes of classified trades, null on other rows.

    ``keys`` must part classified trades from the rest (see :func:`classified`)."""
    signed = _signed()
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(-(n - 1), 0)
    return F.when(classified(), _ready(F.sum(signed).over(w), F.count(signed).over(w), n, full))


def _signed() -> Column:
    return F.when(F.col("side") == SIDE_BUY, F.col("volume")).when(F.col("side") == SIDE_SELL, -F.col("volume"))


def classified() -> Column:
    return (F.col("kind") == KIND_TRADE) & F.col("side").isNotNull()


#: Frames of more rows are put together from running sums: Spark adds up every row of a frame anew for each row.
LONG_FRAME = 256


def frame_column(df: DataFrame, name: str, kind: str, column: str | None, n: int, full: bool, seq: str = "seq") -> DataFrame:
    """``df`` with the moving average of ``column`` (kind ``sma``) or the volume delta (``cvd``) over ``n`` rows, of all symbols."""
    keys: list[Column | str] = ["symbol", "kind"] if kind == "sma" else ["symbol", "kind", classified()]
    if n <= LONG_FRAME:
        return df.withColumn(name, moving_average(F.col(column), keys, n, full, seq) if kind == "sma" else volume_delta(keys, n, full, seq))
    got = _long_frame(df, F.col(column) if kind == "sma" else _signed(), keys, n, seq)
    total = F.when(F.col("_fn") > 0, F.col("_fs"))
    value = _ready(total / F.col("_fn") if kind == "sma" else total, F.col("_fn"), n, full)
    return got.withColumn(name, value if kind == "sma" else F.when(classified(), value)).select(*[F.col(f"`{c}`") for c in df.columns], name)


def _long_frame(df: DataFrame, value: Column, keys: list[Column | str], n: int, seq: str) -> DataFrame:
    """``df`` with the sum and count of the last ``n`` values of its keys (``_fs``, ``_fn``), at a cost a row that does not depend on ``n``.

    Rows are cut into blocks of ``n``; a frame is the head of its row's block and the tail of the block before, both
    running sums from the block's end.  Nothing is subtracted, so no digits are lost and a NaN leaves with its frame."""
    parts = [f"_p{i}" for i in range(len(keys))]
    run = Window.partitionBy(*parts).orderBy(seq)
    out = df.withColumns({**{p: F.col(k) if isinstance(k, str) else k for p, k in zip(parts, keys, strict=True)}, "_v": value})
    out = out.withColumn("_r", F.row_number().over(run) - 1).withColumn("_k", F.floor(F.col("_r") / F.lit(n)))
    sums = {}
    for side, order in (("h", F.asc(seq)), ("t", F.desc(seq))):
        w = Window.partitionBy(*parts, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        sums |= {f"_{side}s": F.sum("_v").over(w), f"_{side}n": F.count("_v").over(w)}
    out = out.withColumns(sums)
    before = lambda c: F.when(F.col("_r") % n != n - 1, F.lag(c, n - 1).over(run))  # noqa: E731  the last row of a block has its frame in the block
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    return out.withColumns({"_fs": zero(F.col("_hs"), 0.0) + zero(before("_ts"), 0.0), "_fn": F.col("_hn") + zero(before("_tn"), 0)})


def ema(df: DataFrame, keys: list[str], value: str, spans: list[int], seq: str = "seq", chunk: str = "_ck", names: list[str] | None = None) -> DataFrame:
    """``df`` with ``_n`` (rows of the keys so far) and one EMA column a span.

    Within a chunk the recurrence starts from 0; with carry c into a chunk the true value at
    its i-th row is local + (1 - a)**i * c.  The carry into the first chunk is the first value."""
    names = names or [f"ema_{n}" for n in spans]
    alphas = [2.0 / (n + 1) for n in spans]
    schema = df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    local_fields = fields + ", _i long" + "".join(f", _l{k} double" for k in range(len(spans)))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable")
        v = pd.concat([pd.Series([0.0]), pdf[value]], ignore_index=True)
        out = pdf.assign(_i=range(1, len(pdf) + 1))
        for k, a in enumerate(alphas):
            out[f"_l{k}"] = v.ewm(alpha=a, adjust=False).mean().to_numpy()[1:] if a < 1 else pdf[value].to_numpy()
        return out

    part = df.groupBy(*keys, chunk).applyInPandas(local, local_fields)
    ends = part.groupBy(*keys, chunk).agg(
        F.count("*").alias("rows"), F.min_by(value, seq).alias("head"), *[F.max_by(f"_l{k}", seq).alias(f"l{k}") for k in range(len(spans))]
    )
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in keys)
    carry_fields = f"{key_fields}, `{chunk}` {schema[chunk].dataType.simpleString()}, _before long" + "".join(f", _b{k} double" for k in range(len(spans)))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row a chunk of one key."""
        pdf = pdf.sort_values(chunk)
        state, before, rows = [float(pdf["head"].iloc[0])] * len(alphas), 0, []
        ends_of = pdf[[f"l{k}" for k in range(len(alphas))]].to_numpy()
        for n, local_end in zip(pdf["rows"].tolist(), ends_of, strict=True):
            rows.append([before, *state])
            state = [x + (1 - a) ** n * s for x, a, s in zip(local_end, alphas, state, strict=True)]
            before += n
        got = pd.DataFrame(rows, columns=["_before", *[f"_b{k}" for k in range(len(alphas))]], index=pdf.index)
        return pd.concat([pdf[[*keys, chunk]], got], axis=1)

    carry = ends.groupBy(*keys).applyInPandas(chain, carry_fields)
    joined = part.join(carry, [*keys, chunk])
    cols = [F.col(f"`{f.name}`") for f in schema.fields]
    vals = [(F.col(f"_l{k}") + F.pow(F.lit(1 - a), F.col("_i")) * F.col(f"_b{k}")).alias(n) for k, (a, n) in enumerate(zip(alphas, names, strict=True))]
    return joined.select(*cols, (F.col("_before") + F.col("_i")).alias("_n"), *vals)
