"""The engine's own queries by name, over the ``events`` table, and their DuckDB SQL.

Binding: seq = event_id, symbol = event_type, price = value, volume = k % 10 + 1,
side = k % 3 with 2 unclassified, k from props.  Results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidDefinition
from .events import KIND_TRADE, extract_field, normalize_symbol, route
from .extractor import FeatureExtractor
from .functions import clock
from .operators import orderbook as ob
from .operators import sample
from .operators.snapshot import chunk_bounds, chunk_of, forward_fill
from .operators.transformers import ParallelTransformer, Pipeline, StandardScaler
from .plans.features import FeatureDefinition, FeatureSet, WarmupPolicy, compile_definitions, compile_set, long_id
from .plans.validate import order_violations, problem
from .sources.tables import bind_events, bind_mixed, exchange_trades, parse_messages
from .streaming.extractor import stream_features

SYMBOLS = ("click", "error", "purchase", "signup", "view")
FIRST, FULL = WarmupPolicy.FIRST_VALUE, WarmupPolicy.FULL_WINDOW
HOUR = 3_600_000


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_events(_raw(spark, sf_dir))


def _round(c: Column | str, name: str) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


# -- projections -------------------------------------------------------------


def event_projection(spark, sf_dir):
    return _trades(spark, sf_dir).select("seq", "kind", "symbol", "ts", "price", "volume", "side")


def event_field_extract(spark, sf_dir):
    return bind_mixed(_raw(spark, sf_dir)).select("seq", *[extract_field(s).alias(s) for s in ("price", "volume", "trade_price", "trade_volume")])


def symbol_normalize(spark, sf_dir):
    odd = F.concat(F.upper("event_type"), F.lit("ÄÉ"))
    return _raw(spark, sf_dir).select("event_id", normalize_symbol(odd).alias("symbol"))


def event_route_filter(spark, sf_dir):
    return route(bind_mixed(_raw(spark, sf_dir)), symbol="CLICK", kind=KIND_TRADE).select("seq", "ts", "price")


# -- sample features of all symbols ------------------------------------------


def _sma(spark, sf_dir, n, full, column="price", name="sma"):
    return _trades(spark, sf_dir).select("seq", _round(sample.moving_average(F.col(column), ["symbol", "kind"], n, full), name))


def sma_price_first_value(spark, sf_dir):
    return _sma(spark, sf_dir, 20, False)


def sma_full_window(spark, sf_dir):
    return _sma(spark, sf_dir, 20, True)


def sma_volume_source(spark, sf_dir):
    return _sma(spark, sf_dir, 10, True, "volume")


def sma_multi_window(spark, sf_dir):
    t = _trades(spark, sf_dir)
    return t.select("seq", *[_round(sample.moving_average(F.col("price"), ["symbol", "kind"], n, True), f"sma_{n}") for n in (5, 20, 100)])


def _ema(spark, sf_dir, full):
    t = _trades(spark, sf_dir)
    rows = t.select("seq", "symbol", F.col("price").alias("v")).withColumn("_ck", chunk_of(chunk_bounds(t)))
    out = sample.ema(rows, ["symbol"], "v", [10, 50])
    cells = [F.when(F.col("_n") >= n, F.col(f"ema_{n}")) if full else F.col(f"ema_{n}") for n in (10, 50)]
    return out.select("seq", *[_round(c, f"ema_{n}") for c, n in zip(cells, (10, 50), strict=True)])


def ema_full_window(spark, sf_dir):
    return _ema(spark, sf_dir, True)


def ema_first_value(spark, sf_dir):
    return _ema(spark, sf_dir, False)


def cvd_windows(spark, sf_dir):
    keys = ["symbol", "kind", sample.classified()]
    return _trades(spark, sf_dir).select("seq", *[_round(sample.volume_delta(keys, n, False), f"cvd_{n}") for n in (5, 50)])


def cvd_unclassified_ignored(spark, sf_dir):
    keys = ["symbol", "kind", sample.classified()]
    return _trades(spark, sf_dir).select("seq", "side", _round(sample.volume_delta(keys, 10, True), "cvd_10"))


# -- wide snapshots ----------------------------------------------------------


def _wide(events: DataFrame, fs: FeatureSet, names: list[str] | None = None) -> DataFrame:
    """Cells in canonical order under short names f0, f1, ... (or ``names``)."""
    ex = FeatureExtractor(fs)
    out = ex.transform(events, check=False)
    short = names or [f"f{i}" for i in range(ex.n_features())]
    return out.select("seq", *[_round(F.col(f"`{n}`"), s) for n, s in zip(ex.feature_names(), short, strict=True)])


def sma_timed(spark, sf_dir):
    return _wide(_trades(spark, sf_dir), FeatureSet().sma_timed("click", "1h", ["1h", "6h"], source="trade_price"), ["w1h", "w6h"])


def obv_timed(spark, sf_dir):
    return _wide(_trades(spark, sf_dir), FeatureSet().obv_timed("click", "1h", ["6h", "24h"]), ["w6h", "w24h"])


def trade_count_timed(spark, sf_dir):
    return _wide(_trades(spark, sf_dir), FeatureSet().trade_count_timed("click", "1h", "6h"), ["w6h"])


def timed_observe_other_symbols(spark, sf_dir):
    fs = FeatureSet().trade_count_timed("view", "10m", "1h", warmup=FIRST).trade_count_timed("purchase", "10m", "1h", warmup=FIRST)
    return _wide(_trades(spark, sf_dir), fs, ["purchase", "view"])


def timed_empty_window(spark, sf_dir):
    fs = FeatureSet().sma_timed("error", "1m", ["1m"], source="trade_price").obv_timed("error", "1m", ["1m"]).trade_count_timed("error", "1m", "1m")
    return _wide(_trades(spark, sf_dir), fs, ["obv", "sma", "count"])


def day_of_week(spark, sf_dir):
    return _trades(spark, sf_dir).select("seq", clock.day_of_week(F.col("ts")).alias("day_of_week"))


def _since(spark, sf_dir, offset):
    return clock.with_time_since_first_event_of_day(_trades(spark, sf_dir), "since", offset).select("seq", "since")


def time_since_first_event_utc(spark, sf_dir):
    return _since(spark, sf_dir, 0)


def time_since_first_event_offset(spark, sf_dir):
    return _since(spark, sf_dir, 5 * HOUR + HOUR // 2)


def snapshot_ffill(spark, sf_dir):
    t = _trades(spark, sf_dir)
    cells = t.select("seq", *[F.when(F.col("symbol") == s, F.col("price")).alias(s) for s in SYMBOLS]).withColumn("_ck", chunk_of(chunk_bounds(t)))
    return forward_fill(cells, list(SYMBOLS)).select("seq", *SYMBOLS)


def _features() -> FeatureSet:
    fs = FeatureSet()
    for s in SYMBOLS:
        fs.sma(s, [5, 20], source="trade_price").cvd(s, [10]).trade_count_timed(s, "1h", "6h")
    return fs.day_of_week().time_since_first_event_of_day()


def compute_features_wide(spark, sf_dir):
    raw = _trades(spark, sf_dir).select("seq", "symbol", "ts", "price", "volume", "side")
    ex = FeatureExtractor(_features())
    out = ex.compute_features(raw, side="side", check=False)
    return out.select("seq", "symbol", "ts", *[_round(F.col(f"`{n}`"), f"f{i}") for i, n in enumerate(ex.feature_names())])


def transform_mixed_kinds(spark, sf_dir):
    fs = FeatureSet()
    for s in SYMBOLS:
        fs.sma(s, [3], source="price", warmup=FIRST).sma(s, [3], source="volume", warmup=FIRST).sma(s, [3], source="trade_volume", warmup=FIRST)
    return _wide(bind_mixed(_raw(spark, sf_dir)), fs)


def validate_order(spark, sf_dir):
    """Order faults of the log read in the order of user, then event."""
    t = _raw(spark, sf_dir).select((F.col("user_id") * F.lit(1_000_000_000) + F.col("event_id")).alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return order_violations(t)


def validate_values(spark, sf_dir):
    t = bind_mixed(_raw(spark, sf_dir))
    odd = t.withColumn("price", F.when(F.col("seq") % 7 == 0, F.lit(None)).otherwise(F.col("price"))).withColumn("side", F.when(F.col("seq") % 11 == 0, F.lit(5)).otherwise(F.col("side")))
    return odd.select("seq", problem(positive=True).alias("fault"))


def standard_scaler(spark, sf_dir):
    out = StandardScaler([("price", "scaled")], 50.0, 12.5)(_trades(spark, sf_dir))
    return out.select("seq", _round("scaled", "scaled"))


def parallel_transformer(spark, sf_dir):
    two = ParallelTransformer([StandardScaler([("price", "a"), ("volume", "b")], 1.0, 2.0), StandardScaler([("price", "c")], 2.0, 4.0)])
    return two(_trades(spark, sf_dir)).select("seq", *[_round(c, c) for c in "abc"])


def transform_pipeline(spark, sf_dir):
    fs = FeatureSet().sma("click", [20], source="trade_price", warmup=FIRST)
    ex = FeatureExtractor(fs)
    run = Pipeline([StandardScaler([(ex.feature_names()[0], "x")], 50.0, 10.0), StandardScaler([("x", "y")], 1.0, 2.0)])
    return run(ex.transform(_trades(spark, sf_dir), check=False)).select("seq", _round("y", "y"))


# -- order books -------------------------------------------------------------


def _changes(spark, sf_dir) -> DataFrame:
    """One change an event, a book a user: side k % 2, price around 100, size value rounded, every seventh a delete."""
    k = F.get_json_object("props", "$.k").cast("long")
    bid = k % 2 == 0
    price = F.when(bid, 100 - k % 10).otherwise(101 + k % 10)
    size = F.when(F.col("event_id") % 7 == 0, F.lit(0)).otherwise(F.floor("value") + 1)
    return _raw(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("book"), F.col("event_id").alias("u"), F.when(bid, ob.BID).otherwise(ob.ASK).alias("side"),
        price.cast("decimal(18,8)").alias("price"), size.cast("decimal(18,8)").alias("size"),
    )


def _levels(spark, sf_dir) -> DataFrame:
    return ob.ladders_at(_changes(spark, sf_dir))


def _d(c: str, name: str | None = None) -> Column:
    return (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(name or c)


def book_best_levels(spark, sf_dir):
    return ob.best_levels(_levels(spark, sf_dir)).select("book", "u", *[_d(c) for c in ("bid_price", "bid_size", "ask_price", "ask_size")])


def book_mid_spread_bps(spark, sf_dir):
    return ob.quotes(ob.best_levels(_levels(spark, sf_dir))).select("book", "u", *[_d(c) for c in ("mid_price", "spread", "spread_bps")])


def book_weighted_mid(spark, sf_dir):
    return ob.quotes(ob.best_levels(_levels(spark, sf_dir))).select("book", "u", _d("weighted_mid_price"))


def book_microprice(spark, sf_dir):
    return ob.quotes(ob.best_levels(_levels(spark, sf_dir))).select("book", "u", _d("microprice"))


def book_top_n(spark, sf_dir):
    return ob.top_n(_levels(spark, sf_dir), 3).select("book", "u", "side", F.col("rank").cast("long").alias("rank"), _d("price"), _d("size"))


def book_level(spark, sf_dir):
    return ob.level_size(_levels(spark, sf_dir), ob.BID, 98).select("book", "u", _d("size"))


def book_depth_until_price(spark, sf_dir):
    return ob.depth_until_price(_levels(spark, sf_dir), ob.BID, 97).select("book", "u", _d("depth"))


def book_depth_until_size(spark, sf_dir):
    return ob.depth_until_total_size(_levels(spark, sf_dir), ob.ASK, 60).select("book", "u", _d("price_from"), _d("price_to"), _d("total_size"))


def book_volume_between(spark, sf_dir):
    return ob.volume_between_prices(_levels(spark, sf_dir), ob.ASK, 102, 106).select("book", "u", _d("volume"))


def book_imbalance(spark, sf_dir):
    return ob.imbalance(_levels(spark, sf_dir), 3).select("book", "u", _d("imbalance"))


def book_update_ids(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("book").agg(F.max("u").alias("last_update_id"))


def _snapshots(spark, sf_dir) -> DataFrame:
    return _changes(spark, sf_dir).filter("u % 10 = 3").select("book", "u")


def book_after_snapshots(spark, sf_dir):
    """Best levels of books that every update with a number ending in 3 replaces as a whole."""
    levels = ob.ladders_at(_changes(spark, sf_dir), snapshots=_snapshots(spark, sf_dir))
    return ob.best_levels(levels).select("book", "u", *[_d(c) for c in ("bid_price", "bid_size", "ask_price", "ask_size")])


def book_snapshot_ids(spark, sf_dir):
    return ob.update_ids(_changes(spark, sf_dir), _snapshots(spark, sf_dir))


def book_sync_state_machine(spark, sf_dir):
    """Each user's events as updates of one book, numbered with gaps, repeats, negative sizes, snapshots too old or cut off, and more
    updates than the buffer holds."""
    from pyspark.sql.window import Window

    c = _changes(spark, sf_dir)
    n, k = F.col("n"), lambda m: F.col("n") % m
    back = F.when((k(11) == 6) | (k(28) == 23), 3).when(k(28) == 9, 30).otherwise(0)
    size = F.when(k(13) == 8, -1 - F.col("size")).otherwise(F.col("size")).cast("decimal(18,8)")
    rows = c.withColumn("n", F.row_number().over(Window.partitionBy("book").orderBy("u")).cast("long")).select(
        "book", F.col("u").alias("seq"), F.when(k(14).isin(3, 9), "snapshot").otherwise("delta").alias("type"),
        (n + F.floor(n / 5) - back).cast("long").alias("update_id"), F.array(F.struct("side", "price", size.alias("size"))).alias("changes"),
    )
    return ob.synchronize(rows, ob.Policy.CONTIGUOUS, 8).select("book", "seq", "outcome", "state", "last_update_id", _d("best_bid"), _d("best_ask"))


# -- definitions, calls and sources ------------------------------------------


def feature_ids(spark, sf_dir):
    """Names, places and long ids of a compiled set."""
    fs = FeatureSet().time_since_first_event_of_day("UTC+5:30").sma("BTC", [20, 5]).ema("Eth", [10], source="trade_volume", warmup=FIRST).cvd("btc", [7])
    fs.sma_timed("btc", "1m", ["5m"], source="volume").obv_timed("ETH", "1s", ["1s", "10s"]).trade_count_timed("btc", "500ms", "2s", warmup=FIRST).day_of_week()
    cells = compile_set(fs).cells
    return spark.createDataFrame([(i, d.name, long_id(d)) for i, d in enumerate(cells)], "place long, name string, long_id string")


def definition_rules(spark, sf_dir):
    """Which definitions compile; index of the first bad one."""
    sma = lambda n: FeatureDefinition("sma", "a", "price", n, warmup=FULL)
    timed = lambda a, w: FeatureDefinition("sma_timed", "a", "price", w, a, warmup=FULL)
    cases = {
        "good": [sma(5), sma(7)], "empty window": [sma(5), sma(0)], "no source": [FeatureDefinition("ema", "a", None, 5, warmup=FULL)],
        "source of a trade feature": [FeatureDefinition("cvd", "a", "price", 5, warmup=FULL)], "twice": [sma(5), sma(6), sma(5)], "sixteen": [sma(n) for n in range(1, 17)],
        "seventeen": [sma(n) for n in range(1, 18)], "no aggregation": [timed(0, 10)], "window below aggregation": [timed(10, 5)], "not a multiple": [timed(10, 25)],
        "odd offset": [FeatureDefinition("time_since_first_event_of_day", offset=30_000)], "far offset": [FeatureDefinition("time_since_first_event_of_day", offset=15 * HOUR)],
        "unknown": [FeatureDefinition("rsi", "a", "price", 5, warmup=FULL)],
    }
    rows = []
    for name, defs in cases.items():
        try:
            compile_definitions(defs)
            rows.append((name, None))
        except InvalidDefinition as e:
            rows.append((name, e.index))
    return spark.createDataFrame(rows, "name string, bad_index long")


def feature_invocations(spark, sf_dir):
    fs = FeatureSet().sma("click", [3, 5], source="trade_price").ema("view", [3]).cvd("click", [4]).trade_count_timed("error", "1m", "5m").day_of_week()
    return FeatureExtractor(fs).invocations(bind_mixed(_raw(spark, sf_dir)))


def features_float32(spark, sf_dir):
    ex = FeatureExtractor(FeatureSet().sma("click", [4], source="trade_price"), output_dtype="float32")
    return ex.transform(_trades(spark, sf_dir), check=False).select("seq", F.round(F.col(f"`{ex.feature_names()[0]}`").cast("double"), 3).alias("sma"))


def feature_values(spark, sf_dir):
    """The vector after all events, and which cells are ready."""
    ex = FeatureExtractor(FeatureSet().sma("click", [4], source="trade_price").sma("view", [1_000_000], source="trade_price").day_of_week())
    out = ex.values(_trades(spark, sf_dir))
    return out.select(*[x for i, n in enumerate(ex.feature_names()) for x in (_round(F.col(f"`{n}`"), f"f{i}"), F.col(f"`{n}`").isNotNull().alias(f"ready{i}"))])


def exchange_order(spark, sf_dir):
    """Trades of many symbols at one time stamp: numbers follow time, trade id and symbol."""
    raw = _raw(spark, sf_dir).select(F.date_trunc("hour", "ts").alias("trade_time"), F.col("event_type").alias("symbol"), (F.col("event_id") % 7).alias("trade_id")).distinct()
    trades = raw.select("*", F.lit(1.0).alias("price"), F.lit(1.0).alias("quantity"), F.lit(True).alias("buyer_market_maker"))
    return exchange_trades(trades).select("seq", "symbol", "ts", "side")


def live_trade_messages(spark, sf_dir):
    """JSON messages of a feed, among others that are no trades."""
    t = _trades(spark, sf_dir)
    fields = {"e": F.when(F.col("seq") % 9 == 0, "depth").otherwise("trade"), "s": F.upper("symbol"), "t": F.col("seq"), "p": F.col("price").cast("string"), "q": F.col("volume").cast("string"),
              "T": F.col("ts"), "m": F.col("side") == 1}
    lines = t.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items() if k != "T"])).alias("a"), F.col("ts"))
    lines = lines.select(F.concat(F.expr("substring(a, 1, length(a) - 1)"), F.lit(',"T":'), F.col("ts").cast("string"), F.lit("}")).alias("value"))
    return parse_messages(lines.union(spark.sql("SELECT 'not json'"))).select("seq", "symbol", "ts", "price", "volume", "side")


# -- streaming ---------------------------------------------------------------


def streaming_features(spark, sf_dir):
    """The wide snapshot by the stateful processor, all events in one availableNow run."""
    import uuid

    from .streaming.run import stream_to_table

    ev = _trades(spark, sf_dir)
    fs = FeatureSet().sma("click", [5], source="trade_price").ema("view", [10], source="trade_price").trade_count_timed("click", "1h", "6h").day_of_week()
    out = stream_to_table(spark, ev, lambda s: stream_features(s, fs), f"stream_{uuid.uuid4().hex}")
    return out.select("seq", *[_round(F.col(f"`{n}`"), f"f{i}") for i, n in enumerate(FeatureExtractor(fs).feature_names())])


def streaming_late_rejected(spark, sf_dir):
    """Events in the order of user, then event: what is earlier than what was seen is left out."""
    import uuid

    from .streaming.run import stream_to_table

    raw = _raw(spark, sf_dir)
    ev = bind_events(raw.withColumn("event_id", F.col("user_id") * F.lit(1_000_000_000) + F.col("event_id")))
    out = stream_to_table(spark, ev, lambda s: stream_features(s, FeatureSet().day_of_week(), late="reject"), f"stream_{uuid.uuid4().hex}")
    return out.select("seq", F.col("`clock:day_of_week`").alias("day_of_week"))


_NAMES = """event_projection event_field_extract symbol_normalize event_route_filter sma_price_first_value sma_full_window sma_multi_window sma_volume_source
ema_full_window ema_first_value cvd_windows cvd_unclassified_ignored sma_timed obv_timed trade_count_timed timed_observe_other_symbols timed_empty_window
day_of_week time_since_first_event_utc time_since_first_event_offset snapshot_ffill compute_features_wide transform_mixed_kinds validate_order validate_values
standard_scaler parallel_transformer transform_pipeline book_best_levels book_mid_spread_bps book_top_n book_level book_depth_until_price book_depth_until_size
book_volume_between book_weighted_mid book_microprice book_imbalance book_update_ids book_sync_state_machine book_after_snapshots book_snapshot_ids
feature_ids definition_rules feature_invocations features_float32 feature_values exchange_order live_trade_messages streaming_features streaming_late_rejected""".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES}

# -- DuckDB ------------------------------------------------------------------

_EV = """ev AS (
  SELECT event_id AS seq, event_type AS symbol, epoch_us(ts) // 1000 AS ts, value AS price, (k % 10 + 1)::DOUBLE AS volume,
         CASE WHEN k % 3 < 2 THEN (k % 3)::INT END AS side
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)
)"""
_MIX = f"""{_EV}, mx AS (
  SELECT seq, (seq % 5)::INT AS kind, symbol, ts, CASE WHEN seq % 5 IN (0, 2) THEN price END AS price,
         CASE WHEN seq % 5 IN (1, 2) THEN volume END AS volume, CASE WHEN seq % 5 = 2 THEN side END AS side FROM ev
)"""
_R = "round({0}, 6) + 0.0"


def _sma_sql(n, full, col="price", name="sma"):
    v = f"avg({col}) OVER w"
    v = f"CASE WHEN count(*) OVER w >= {n} THEN {v} END" if full else v
    return f"WITH {_EV} SELECT seq, {_R.format(v)} AS {name} FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS {n - 1} PRECEDING)"


def _ema_sql(full):
    def val(n):
        v = f"e{n}"
        return _R.format(f"CASE WHEN r >= {n} THEN {v} END" if full else v) + f" AS ema_{n}"

    a10, a50 = 2 / 11, 2 / 51
    return f"""WITH RECURSIVE {_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS r FROM ev),
x AS (SELECT symbol, r, seq, price AS e10, price AS e50 FROM o WHERE r = 1
  UNION ALL SELECT o.symbol, o.r, o.seq, o.price * {a10!r} + x.e10 * {1 - a10!r}, o.price * {a50!r} + x.e50 * {1 - a50!r} FROM x JOIN o ON o.symbol = x.symbol AND o.r = x.r + 1)
SELECT seq, {val(10)}, {val(50)} FROM x"""


def _cvd_sql(cols, extra=""):
    def val(n, full):
        v = f"sum(CASE WHEN side = 0 THEN volume ELSE -volume END) OVER (PARTITION BY symbol ORDER BY seq ROWS {n - 1} PRECEDING)"
        c = f"count(*) OVER (PARTITION BY symbol ORDER BY seq ROWS {n - 1} PRECEDING)"
        return f"{_R.format(f'CASE WHEN {c} >= {n} THEN {v} END' if full else v)} AS cvd_{n}"

    inner = f"SELECT seq, {', '.join(val(n, full) for n, full in cols)} FROM ev WHERE side IS NOT NULL"
    return f"WITH {_EV}, c AS ({inner}) SELECT ev.seq, {extra}{', '.join(f'c.cvd_{n}' for n, _ in cols)} FROM ev LEFT JOIN c USING (seq)"


def _timed_sql(cells):
    """cells: (name, kind, symbol, A, W, full); each by joining a row with the symbol's trades in its window."""
    ctes, sels, joins = [_EV], [], []
    for i, (name, kind, sym, a, w, full) in enumerate(cells):
        ctes.append(f"m{i} AS (SELECT seq, ts, price, volume, ts - ((ts % {a}) + {a}) % {a} AS b FROM ev WHERE symbol = '{sym}')")
        ctes.append(f"f{i} AS (SELECT min(seq) AS s0, min(ts) AS t0 FROM m{i})")
        # one row a bucket as of each event: the current bucket up to seq, earlier ones whole
        ctes.append(f"k{i} AS (SELECT b, count(*) AS n, avg(price) AS mean, sum(volume) AS vol, arg_max(price, seq) AS close FROM m{i} GROUP BY b)")
        ctes.append(f"p{i} AS (SELECT *, lag(close) OVER (ORDER BY b) AS prev FROM k{i})")
        ctes.append(f"e{i} AS (SELECT seq, ts, ts - ((ts % {a}) + {a}) % {a} AS b FROM ev)")
        ctes.append(f"""q{i} AS (SELECT e.seq, coalesce(sum(p.n), 0) AS n, coalesce(sum(coalesce(sign(p.close - p.prev) * p.vol, 0)), 0) AS obv, coalesce(sum(p.mean), 0) AS sm, count(p.mean) AS c
  FROM e{i} e LEFT JOIN p{i} p ON p.b < e.b AND p.b > e.b - {w} GROUP BY e.seq)""")
        ctes.append(f"""c{i} AS (SELECT e.seq, count(m.seq) AS n, sum(m.volume) AS vol, avg(m.price) AS mean, arg_max(m.price, m.seq) AS close
  FROM e{i} e LEFT JOIN m{i} m ON m.b = e.b AND m.seq <= e.seq GROUP BY e.seq)""")
        ctes.append(f"z{i} AS (SELECT e.seq, p.close AS prev FROM e{i} e ASOF LEFT JOIN k{i} p ON e.b > p.b)")
        v = {
            "count": f"(q{i}.n + c{i}.n)::DOUBLE",
            "obv": f"q{i}.obv + coalesce(sign(c{i}.close - z{i}.prev) * c{i}.vol, 0)",
            "sma": f"(q{i}.sm + coalesce(c{i}.mean, 0)) / nullif(q{i}.c + (c{i}.n > 0)::INT, 0)",
        }[kind]
        ready = f"ev.seq >= f{i}.s0" + (f" AND ev.ts - f{i}.t0 >= {w}" if full else "")
        sels.append(f"{_R.format(f'CASE WHEN {ready} THEN {v} END')} AS {name}")
        joins.append(f"JOIN q{i} ON q{i}.seq = ev.seq JOIN c{i} ON c{i}.seq = ev.seq JOIN z{i} ON z{i}.seq = ev.seq CROSS JOIN f{i}")
    return ctes, sels, joins


def _timed_query(cells):
    ctes, sels, joins = _timed_sql(cells)
    return f"WITH {', '.join(ctes)} SELECT ev.seq, {', '.join(sels)} FROM ev {' '.join(joins)}"


def _since_sql(offset):
    day = f"ts + {offset} - ((ts + {offset}) % 86400000 + 86400000) % 86400000"
    return f"WITH {_EV} SELECT seq, (ts - min(ts) OVER (PARTITION BY {day}))::DOUBLE AS since FROM ev"


_DOW = "(((ts - ((ts % 86400000) + 86400000) % 86400000) // 86400000 + 4) % 7)::DOUBLE"


def _ffill(v):
    return f"last_value({v} IGNORE NULLS) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)"


def _wide_sql():
    timed = [(f"t_{s}", "count", s, HOUR, 6 * HOUR, True) for s in SYMBOLS]
    ctes, sels, joins = _timed_sql(timed)
    a = []
    for s in SYMBOLS:
        w = lambda n: f"(PARTITION BY symbol ORDER BY seq ROWS {n - 1} PRECEDING)"
        for n in (5, 20):
            a.append(f"CASE WHEN symbol = '{s}' AND count(*) OVER {w(n)} >= {n} THEN avg(price) OVER {w(n)} END AS s{n}_{s}")
    ctes.append(f"sm AS (SELECT seq, symbol, ts, {', '.join(a)} FROM ev)")
    cv = "sum(CASE WHEN side = 0 THEN volume ELSE -volume END) OVER (PARTITION BY symbol ORDER BY seq ROWS 9 PRECEDING)"
    ctes.append(f"cv AS (SELECT seq, symbol, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY seq ROWS 9 PRECEDING) >= 10 THEN {cv} END AS v FROM ev WHERE side IS NOT NULL)")
    ctes.append(f"ti AS (SELECT ev.seq, {', '.join(sels)} FROM ev {' '.join(joins)})")
    out = [f"{_DOW} AS f0", "(ts - min(ts) OVER (PARTITION BY ts - ((ts % 86400000) + 86400000) % 86400000))::DOUBLE AS f1"]
    i = 2
    for s in SYMBOLS:
        vals = [_ffill(f"CASE WHEN cvs = '{s}' THEN cvv END"), _ffill(f"s5_{s}"), _ffill(f"s20_{s}"), f"t_{s}"]
        for v in vals:
            out.append(f"{_R.format(v)} AS f{i}")
            i += 1
    ctes.append("j AS (SELECT sm.*, cv.symbol AS cvs, cv.v AS cvv, ti.* EXCLUDE (seq) FROM sm LEFT JOIN cv USING (seq) JOIN ti USING (seq))")
    return f"WITH {', '.join(ctes)} SELECT seq, symbol, ts, {', '.join(out)} FROM j"


def _mixed_sql():
    parts, out, i = [], [], 0
    for k, col, tag in ((0, "price", "price"), (2, "volume", "tv"), (1, "volume", "vol")):
        parts.append(f"{tag} AS (SELECT seq, avg({col}) OVER (PARTITION BY symbol ORDER BY seq ROWS 2 PRECEDING) AS {tag} FROM mx WHERE kind = {k})")
    for s in SYMBOLS:
        for tag in ("price", "tv", "vol"):
            out.append(f"{_R.format(_ffill(f'CASE WHEN symbol = {chr(39)}{s}{chr(39)} THEN {tag}_v END'))} AS f{i}")
            i += 1
    j = "j AS (SELECT mx.seq, mx.symbol, price.price AS price_v, tv.tv AS tv_v, vol.vol AS vol_v FROM mx LEFT JOIN price USING (seq) LEFT JOIN tv USING (seq) LEFT JOIN vol USING (seq))"
    return f"WITH {_MIX}, {', '.join(parts)}, {j} SELECT seq, {', '.join(out)} FROM j"


_BOOK = """ch AS (
  SELECT user_id::VARCHAR AS book, event_id AS u, CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
         CASE WHEN k % 2 = 0 THEN 100 - k % 10 ELSE 101 + k % 10 END AS price, CASE WHEN event_id % 7 = 0 THEN 0 ELSE floor(value) + 1 END AS size
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)
), sp AS (
  SELECT book, u AS f, side, price, size, coalesce(lead(u) OVER (PARTITION BY book, side, price ORDER BY u), 9000000000) AS t FROM ch
), lv AS (
  SELECT p.book, p.u, s.side, s.price::DOUBLE AS price, s.size::DOUBLE AS size FROM ch p JOIN sp s ON p.book = s.book AND p.u >= s.f AND p.u < s.t WHERE s.size <> 0
), rk AS (
  SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS depth FROM lv
  WINDOW w AS (PARTITION BY book, u, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING)
), bb AS (
  SELECT book, u, max(price) FILTER (side = 'bid') AS bp, arg_max(size, price) FILTER (side = 'bid') AS bs,
         min(price) FILTER (side = 'ask') AS ap, arg_min(size, price) FILTER (side = 'ask') AS az FROM lv GROUP BY ALL
)"""


def _book(select):
    return f"WITH {_BOOK} {select}"


def _r(e, name):
    return f"{_R.format(e)} AS {name}"


def _streaming_sql():
    ctes, sels, joins = _timed_sql([("cnt", "count", "click", HOUR, 6 * HOUR, True)])
    w, a = "(PARTITION BY symbol ORDER BY seq ROWS 4 PRECEDING)", 2 / 11
    ctes += [
        f"ti AS (SELECT ev.seq, {', '.join(sels)} FROM ev {' '.join(joins)})",
        f"sm AS (SELECT seq, CASE WHEN symbol = 'click' AND count(*) OVER {w} >= 5 THEN avg(price) OVER {w} END AS s5 FROM ev)",
        "o AS (SELECT seq, price, row_number() OVER (ORDER BY seq) AS r FROM ev WHERE symbol = 'view')",
        f"x AS (SELECT seq, r, price AS e FROM o WHERE r = 1 UNION ALL SELECT o.seq, o.r, o.price * {a!r} + x.e * {1 - a!r} FROM x JOIN o ON o.r = x.r + 1)",
        "j AS (SELECT ev.seq, ev.ts, s5, cnt, CASE WHEN r >= 10 THEN e END AS e10 FROM ev JOIN sm USING (seq) JOIN ti USING (seq) LEFT JOIN x USING (seq))",
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT seq, {_DOW} AS f0, {_r(_ffill('s5'), 'f1')}, cnt AS f2, {_r(_ffill('e10'), 'f3')} FROM j"


_SYNC = r"""
WITH RECURSIVE c AS (
  SELECT user_id::VARCHAR AS book, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
         (CASE WHEN k % 2 = 0 THEN 100 - k % 10 ELSE 101 + k % 10 END)::DOUBLE AS price, (CASE WHEN event_id % 7 = 0 THEN 0 ELSE floor(value) + 1 END)::DOUBLE AS size
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)
), e AS (
  SELECT book, seq, n, CASE WHEN n % 14 IN (3, 9) THEN 'snapshot' ELSE 'delta' END AS type,
         n + n // 5 - CASE WHEN n % 11 = 6 OR n % 28 = 23 THEN 3 WHEN n % 28 = 9 THEN 30 ELSE 0 END AS id,
         {'id': 0::BIGINT, 'side': side, 'price': price, 'size': CASE WHEN n % 13 = 8 THEN -1 - size ELSE size END} AS ch
  FROM c
), s(book, n, seq, outcome, state, lu, ls, hist, lv) AS (
  SELECT DISTINCT book, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'awaiting_snapshot', NULL::BIGINT, NULL::BIGINT,
         []::STRUCT(id BIGINT, side VARCHAR, price DOUBLE, size DOUBLE)[], []::STRUCT(id BIGINT, side VARCHAR, price DOUBLE, size DOUBLE)[] FROM e
  UNION ALL
  SELECT book, n, seq, outcome,
         CASE WHEN outcome = 'buffer_capacity_exceeded' OR (outcome = 'sequence_gap' AND state = 'live') THEN 'require_resync'
              WHEN snap AND outcome IN ('applied', 'resynchronized') THEN 'live' ELSE state END,
         CASE WHEN outcome NOT IN ('applied', 'resynchronized') THEN lu WHEN snap THEN coalesce(newer[-1].id, id) ELSE id END,
         CASE WHEN snap AND outcome IN ('applied', 'resynchronized') THEN id ELSE ls END,
         CASE WHEN snap AND outcome IN ('applied', 'resynchronized') THEN newer WHEN NOT snap AND outcome IN ('applied', 'buffered', 'sequence_gap') THEN list_append(hist, now) ELSE hist END,
         CASE WHEN outcome NOT IN ('applied', 'resynchronized') THEN lv ELSE
           list_filter(list_concat(CASE WHEN snap THEN [now] ELSE list_append(lv, now) END, CASE WHEN snap THEN newer ELSE [] END), lambda x, i: x.size <> 0 AND
             len(list_filter(list_concat(CASE WHEN snap THEN [now] ELSE list_append(lv, now) END, CASE WHEN snap THEN newer ELSE [] END)[i + 1:], lambda y: y.side = x.side AND y.price = x.price)) = 0) END
  FROM (
    SELECT *, CASE
        WHEN now.size < 0 OR now.price < 0 THEN 'invalid_update'
        WHEN snap AND ls IS NOT NULL AND id <= ls THEN 'stale_snapshot'
        WHEN snap AND len(list_filter(newer, lambda x, i: x.id <> id + i)) > 0 THEN 'snapshot_history_gap'
        WHEN snap THEN CASE WHEN state = 'require_resync' THEN 'resynchronized' ELSE 'applied' END
        WHEN id <= top THEN 'ignored_stale'
        WHEN id <> top + 1 THEN CASE WHEN len(hist) >= 8 THEN 'buffer_capacity_exceeded' ELSE 'sequence_gap' END
        WHEN len(hist) >= 8 THEN 'buffer_capacity_exceeded'
        WHEN state <> 'live' THEN 'buffered' ELSE 'applied' END AS outcome
    FROM (
      SELECT s.book, e.n, e.seq, s.state, s.lu, s.ls, s.hist, s.lv, e.id, e.type = 'snapshot' AS snap, struct_pack(id := e.id, side := ch.side, price := ch.price, size := ch.size) AS now,
             coalesce(hist[-1].id, CASE WHEN s.state = 'live' THEN s.lu END) AS top, list_filter(s.hist, lambda x: x.id > e.id) AS newer
      FROM s JOIN e ON e.book = s.book AND e.n = s.n + 1
    )
  )
)
SELECT book, seq, outcome, state, lu AS last_update_id, list_max(list_transform(list_filter(lv, lambda x: x.side = 'bid'), lambda x: x.price)) AS best_bid,
       list_min(list_transform(list_filter(lv, lambda x: x.side = 'ask'), lambda x: x.price)) AS best_ask
FROM s WHERE n > 0
"""

ORACLE_SQL: dict[str, str] = {
    "event_projection": f"WITH {_EV} SELECT seq, 2 AS kind, symbol, ts, price, volume, side FROM ev",
    "event_field_extract": f"WITH {_MIX} SELECT seq, CASE WHEN kind = 0 THEN price END AS price, CASE WHEN kind = 1 THEN volume END AS volume, CASE WHEN kind = 2 THEN price END AS trade_price, CASE WHEN kind = 2 THEN volume END AS trade_volume FROM mx",
    "symbol_normalize": "SELECT event_id, translate(upper(event_type) || 'ÄÉ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS symbol FROM events",
    "event_route_filter": f"WITH {_MIX} SELECT seq, ts, price FROM mx WHERE kind = 2 AND symbol = 'click'",
    "sma_price_first_value": _sma_sql(20, False),
    "sma_full_window": _sma_sql(20, True),
    "sma_volume_source": _sma_sql(10, True, "volume"),
    "sma_multi_window": f"WITH {_EV} SELECT seq, "
    + ", ".join(f"{_R.format(f'CASE WHEN count(*) OVER w{n} >= {n} THEN avg(price) OVER w{n} END')} AS sma_{n}" for n in (5, 20, 100))
    + " FROM ev WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY seq ROWS {n - 1} PRECEDING)" for n in (5, 20, 100)),
    "ema_full_window": _ema_sql(True),
    "ema_first_value": _ema_sql(False),
    "cvd_windows": _cvd_sql([(5, False), (50, False)]),
    "cvd_unclassified_ignored": _cvd_sql([(10, True)], "ev.side, "),
    "sma_timed": _timed_query([("w1h", "sma", "click", HOUR, HOUR, True), ("w6h", "sma", "click", HOUR, 6 * HOUR, True)]),
    "obv_timed": _timed_query([("w6h", "obv", "click", HOUR, 6 * HOUR, True), ("w24h", "obv", "click", HOUR, 24 * HOUR, True)]),
    "trade_count_timed": _timed_query([("w6h", "count", "click", HOUR, 6 * HOUR, True)]),
    "timed_observe_other_symbols": _timed_query([("purchase", "count", "purchase", HOUR // 6, HOUR, False), ("view", "count", "view", HOUR // 6, HOUR, False)]),
    "timed_empty_window": _timed_query([(n, n, "error", 60_000, 60_000, True) for n in ("obv", "sma", "count")]),
    "day_of_week": f"WITH {_EV} SELECT seq, {_DOW} AS day_of_week FROM ev",
    "time_since_first_event_utc": _since_sql(0),
    "time_since_first_event_offset": _since_sql(5 * HOUR + HOUR // 2),
    "snapshot_ffill": f"WITH {_EV} SELECT seq, " + ", ".join(f"{_ffill(f'CASE WHEN symbol = {chr(39)}{s}{chr(39)} THEN price END')} AS \"{s}\"" for s in SYMBOLS) + " FROM ev",
    "compute_features_wide": _wide_sql(),
    "transform_mixed_kinds": _mixed_sql(),
    "validate_order": "WITH t AS (SELECT user_id * 1000000000 + event_id AS seq, epoch_us(ts) // 1000 AS ts FROM events), p AS (SELECT *, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM t) SELECT * FROM p WHERE previous > ts",
    "validate_values": f"WITH {_MIX} SELECT seq, CASE WHEN kind IN (0, 2) AND (seq % 7 = 0 OR price IS NULL) THEN 'event kind requires the `price` column' WHEN kind IN (0, 2) AND price <= 0 THEN 'price must be finite and positive' WHEN seq % 11 = 0 THEN 'side must be 0 or 1' END AS fault FROM mx",
    "standard_scaler": f"WITH {_EV} SELECT seq, {_r('(price - 50.0::DOUBLE) / 12.5::DOUBLE', 'scaled')} FROM ev",
    "parallel_transformer": f"WITH {_EV} SELECT seq, {_r('(price - 1) / 2', 'a')}, {_r('(volume - 1) / 2', 'b')}, {_r('(price - 2) / 4', 'c')} FROM ev",
    "transform_pipeline": f"WITH {_EV}, s AS (SELECT seq, CASE WHEN symbol = 'click' THEN avg(price) OVER (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING) END AS v FROM ev), f AS (SELECT seq, {_ffill('v')} AS v FROM s) SELECT seq, {_r('((v - 50) / 10 - 1) / 2', 'y')} FROM f",
    "book_best_levels": _book("SELECT book, u, bp AS bid_price, bs AS bid_size, ap AS ask_price, az AS ask_size FROM bb"),
    "book_mid_spread_bps": _book(f"SELECT book, u, {_r('(bp + ap) / 2', 'mid_price')}, {_r('abs(ap - bp)', 'spread')}, {_r('abs(ap - bp) / ((bp + ap) / 2) * 10000', 'spread_bps')} FROM bb"),
    "book_weighted_mid": _book(f"SELECT book, u, {_r('(bp * bs + ap * az) / (bs + az)', 'weighted_mid_price')} FROM bb"),
    "book_microprice": _book(f"SELECT book, u, {_r('(bp * az + ap * bs) / (bs + az)', 'microprice')} FROM bb"),
    "book_top_n": _book("SELECT book, u, side, rank::BIGINT AS rank, price, size FROM rk WHERE rank <= 3"),
    "book_level": _book("SELECT book, u, size FROM lv WHERE side = 'bid' AND price = 98"),
    "book_depth_until_price": _book("SELECT book, u, coalesce(sum(size) FILTER (side = 'bid' AND price >= 97), 0)::DOUBLE AS depth FROM lv GROUP BY ALL"),
    "book_depth_until_size": _book("SELECT book, u, min(price) AS price_from, min(price) FILTER (depth >= 60) AS price_to, min(depth) FILTER (depth >= 60) AS total_size FROM rk WHERE side = 'ask' GROUP BY ALL HAVING min(depth) FILTER (depth >= 60) IS NOT NULL"),
    "book_volume_between": _book("SELECT book, u, coalesce(sum(size) FILTER (side = 'ask' AND price >= 102 AND price < 106), 0)::DOUBLE AS volume FROM lv GROUP BY ALL"),
    "book_imbalance": _book(f"SELECT book, u, {_r('(b - a) / nullif(b + a, 0)', 'imbalance')} FROM (SELECT book, u, coalesce(sum(size) FILTER (side = 'bid' AND rank <= 3), 0) AS b, coalesce(sum(size) FILTER (side = 'ask' AND rank <= 3), 0) AS a FROM rk GROUP BY ALL)"),
    "book_update_ids": "SELECT user_id::VARCHAR AS book, max(event_id) AS last_update_id FROM events GROUP BY 1",
    "book_sync_state_machine": _SYNC,
    "book_after_snapshots": """WITH ch AS (
  SELECT user_id::VARCHAR AS book, event_id AS u, CASE WHEN k % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
         (CASE WHEN k % 2 = 0 THEN 100 - k % 10 ELSE 101 + k % 10 END)::DOUBLE AS price, (CASE WHEN event_id % 7 = 0 THEN 0 ELSE floor(value) + 1 END)::DOUBLE AS size
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)
), ep AS (
  SELECT *, count(*) FILTER (u % 10 = 3) OVER (PARTITION BY book ORDER BY u) AS ep FROM ch
), pt AS (
  -- every update sees, of its own epoch, the last change of each price so far
  SELECT p.book, p.u, c.side, c.price, arg_max(c.size, c.u) AS size FROM ep p JOIN ep c ON c.book = p.book AND c.ep = p.ep AND c.u <= p.u GROUP BY ALL
)
SELECT book, u, max(price) FILTER (side = 'bid') AS bid_price, arg_max(size, price) FILTER (side = 'bid') AS bid_size,
       min(price) FILTER (side = 'ask') AS ask_price, arg_min(size, price) FILTER (side = 'ask') AS ask_size FROM pt WHERE size <> 0 GROUP BY ALL""",
    "book_snapshot_ids": "SELECT user_id::VARCHAR AS book, max(event_id) AS last_update_id, max(event_id) FILTER (event_id % 10 = 3) AS last_snapshot_update_id FROM events GROUP BY 1",
    "feature_ids": """SELECT place::BIGINT AS place, name, long_id FROM (VALUES
(0, 'clock:day_of_week', 'day_of_week'),
(1, 'clock:time_since_first_event_of_day:19800000ms', 'time_since_first_event_of_day:utc_offset=19800000ms'),
(2, 'btc:trade:cvd:7', 'cvd:symbol=3:btc:source=event.trade:window=7:warmup=full_window'),
(3, 'btc:price:sma:20', 'sma:symbol=3:btc:source=field.price:window=20:warmup=full_window'),
(4, 'btc:price:sma:5', 'sma:symbol=3:btc:source=field.price:window=5:warmup=full_window'),
(5, 'btc:volume:sma_timed:60000ms:300000ms', 'sma_timed:symbol=3:btc:source=field.volume:aggregation=60000ms:window=300000ms:warmup=full_window'),
(6, 'btc:trade:count_timed:500ms:2000ms', 'count_timed:symbol=3:btc:source=event.trade:aggregation=500ms:window=2000ms:warmup=first_value'),
(7, 'eth:trade_volume:ema:10', 'ema:symbol=3:eth:source=field.trade_volume:window=10:warmup=first_value'),
(8, 'eth:trade:obv_timed:1000ms:1000ms', 'obv_timed:symbol=3:eth:source=event.trade:aggregation=1000ms:window=1000ms:warmup=full_window'),
(9, 'eth:trade:obv_timed:1000ms:10000ms', 'obv_timed:symbol=3:eth:source=event.trade:aggregation=1000ms:window=10000ms:warmup=full_window')) t(place, name, long_id)""",
    "definition_rules": """SELECT name, bad_index::BIGINT AS bad_index FROM (VALUES ('good', NULL), ('empty window', 1), ('no source', 0), ('source of a trade feature', 0), ('twice', 2), ('sixteen', NULL),
('seventeen', 16), ('no aggregation', 0), ('window below aggregation', 0), ('not a multiple', 0), ('odd offset', 0), ('far offset', 0), ('unknown', 0)) t(name, bad_index)""",
    "feature_invocations": f"WITH {_MIX} SELECT seq, (2 + (symbol = 'click' AND kind = 2)::INT + (symbol = 'view' AND kind = 0)::INT + (symbol = 'click' AND kind = 2 AND side IS NOT NULL)::INT)::BIGINT AS updated FROM mx",
    "features_float32": f"WITH {_EV}, s AS (SELECT seq, CASE WHEN symbol = 'click' AND count(*) OVER w >= 4 THEN avg(price) OVER w END AS v FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS 3 PRECEDING)) SELECT seq, round({_ffill('v')}::FLOAT::DOUBLE, 3) AS sma FROM s",
    "feature_values": f"""WITH {_EV}, t AS (SELECT *, max(ts) OVER () AS now FROM ev), l AS (SELECT price FROM ev WHERE symbol = 'click' ORDER BY seq DESC LIMIT 4)
SELECT (SELECT {_DOW.replace('ts', 'max(ts)')} FROM ev) AS f0, true AS ready0, round((SELECT avg(price) FROM l), 6) + 0.0 AS f1, true AS ready1, NULL::DOUBLE AS f2, false AS ready2""",
    "exchange_order": """WITH t AS (SELECT DISTINCT epoch_us(date_trunc('hour', ts)) // 1000 AS ts, event_type AS symbol, event_id % 7 AS trade_id FROM events)
SELECT ts * 1000000 + row_number() OVER (PARTITION BY ts ORDER BY trade_id, symbol) AS seq, symbol, ts, 1 AS side FROM t""",
    "live_trade_messages": f"WITH {_EV} SELECT ts * 1000000 + seq % 1000000 AS seq, symbol, ts, price, volume, CASE WHEN side = 1 THEN 1 ELSE 0 END AS side FROM ev WHERE seq % 9 <> 0",
    "streaming_features": _streaming_sql(),
    "streaming_late_rejected": f"WITH e AS (SELECT user_id * 1000000000 + event_id AS seq, epoch_us(ts) // 1000 AS ts FROM events), p AS (SELECT *, max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e) SELECT seq, {_DOW} AS day_of_week FROM p WHERE top IS NULL OR ts >= top",
}
