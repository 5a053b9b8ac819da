"""Golden cases on the stepper, and batch and stream plans against it."""

import random

import pytest

from tidemark.errors import InvalidEvent, TidemarkError
from tidemark.events import KIND_ORDERBOOK, KIND_PRICE, KIND_TIME, KIND_TRADE, KIND_VOLUME, SCHEMA
from tidemark.extractor import FeatureExtractor
from tidemark.plans.features import FeatureSet, WarmupPolicy
from tidemark.stepper import Stepper
from tidemark.streaming.extractor import stream_features

FIRST, FULL = WarmupPolicy.FIRST_VALUE, WarmupPolicy.FULL_WINDOW


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (g is None or g == pytest.approx(w, rel=1e-9, abs=1e-9))


def prices(fs, values):
    st, out = Stepper(fs), []
    for i, v in enumerate(values):
        st.update(KIND_PRICE, "a", i, price=v)
        out.append(st.values())
    return out


def test_sma():
    assert [r[0] for r in prices(FeatureSet().sma("a", [3], warmup=FIRST), [3, 6, 9])] == [3, 4.5, 6]
    assert prices(FeatureSet().sma("a", [2, 3]), [2, 4, 6]) == [[None, None], [3, None], [5, 4]]
    assert prices(FeatureSet().sma("a", [2, 5], warmup=FIRST), [1, 2, 3, 4, 5])[-1] == [4.5, 3]


def test_ema():
    got = prices(FeatureSet().ema("a", [3, 5], warmup=FIRST), [10, 20, 30])
    assert [r[0] for r in got] == [10, 15, 22.5]
    assert [r[1] for r in got] == pytest.approx([10, 40 / 3, 170 / 9], abs=1e-12)
    assert [[v is None for v in r] for r in prices(FeatureSet().ema("a", [2, 3]), [10, 20, 30])] == [[True, True], [False, True], [False, False]]


def test_cvd_ignores_unclassified_and_foreign_trades():
    st = Stepper(FeatureSet().cvd("AAPL", [1, 2], warmup=FIRST))
    for s, v, side in (("AAPL", 10, 0), ("AAPL", 3, 1), ("AAPL", 50, None), ("GOOGL", 80, 0), ("AAPL", 2, 0)):
        st.update(KIND_TRADE, s, 0, price=1, volume=v, side=side)
    assert st.values() == [2, -1]


def timed(fs, events):
    """events: (price, ts), (price, volume, ts) or ts alone for a tick."""
    st, out = Stepper(fs), []
    for e in events:
        if isinstance(e, int):
            st.update(KIND_TIME, None, e)
        elif len(e) == 2:
            st.update(KIND_TRADE, "a", e[1], price=e[0], volume=1.0)
        else:
            st.update(KIND_TRADE, "a", e[2], price=e[0], volume=e[1])
        out.append(st.values())
    return out


def sma_t(windows, warmup=FIRST):
    return FeatureSet().sma_timed("a", "1s", windows, source="trade_price", warmup=warmup)


def test_timed_sma():
    assert timed(sma_t(["1s"]), [(10, 0), (20, 500)])[-1] == [15]
    assert timed(sma_t(["2s"]), [(10, 999), (20, 1000)])[-1] == [15]
    assert timed(sma_t(["1s"]), [(10, 0), (20, 1000), (40, 1500)])[-1] == [30]
    assert timed(sma_t(["1s", "3s"]), [(10, 0), (20, 1000), (30, 2000), (40, 2500), (50, 3000)])[-1] == [50, 35]
    assert [r[0] for r in timed(sma_t(["2s"], FULL), [(10, 0), (20, 1000), 1999, 2000, 3000])] == [None, None, None, 20, None]


def test_timed_obv():
    obv = lambda w, p=FIRST: FeatureSet().obv_timed("a", "1s", w, warmup=p)
    assert timed(obv(["4s"]), [(100, 10, 0), (101, 7, 1000), (101, 99, 2000), (99, 3, 3000)])[-1] == [4]
    assert [r[0] for r in timed(obv(["2s"]), [(100, 10, 0), (102, 2, 900), (100, 5, 1000), (104, 3, 1500)])][-2:] == [-5, 8]
    assert timed(obv(["2s"]), [(100, 1, 0), (90, 1, 900), (92, 5, 1000)])[-1] == [5]
    assert timed(obv(["1s", "3s"]), [(100, 10, 0), (101, 7, 1000), (102, 5, 2000), (99, 2, 3000)])[-1] == [-2, 10]
    assert [r[0] for r in timed(obv(["2s"], FULL), [(100, 10, 0), (101, 7, 1000), 1999, 2000, 3000])][-3:] == [None, 7, 0]


def test_timed_count():
    n = lambda w, p=FIRST: FeatureSet().trade_count_timed("a", "1s", w, warmup=p)
    assert timed(n("3s"), [(1, 0), (1, 1000), (1, 1500), (1, 2000)])[-1] == [4]
    assert [r[0] for r in timed(n("2s", FULL), [(1, 0), (1, 1000), 1999, 2000, 3000])][-3:] == [None, 1, 0]


def test_clock():
    st = Stepper(FeatureSet().day_of_week().time_since_first_event_of_day())
    seen = []
    for t in (1609459200000, 1609459205000, 1609545600000, 1609545601000):
        st.update(KIND_TIME, None, t)
        seen.append(st.values())
    assert seen == [[5, 0], [5, 5000], [6, 0], [6, 1000]]


def test_step_errors_leave_state():
    st = Stepper(FeatureSet().sma("a", [1]))
    st.update(KIND_PRICE, "A", 5, price=1.0)
    with pytest.raises(InvalidEvent):
        st.update(KIND_PRICE, "a", 4, price=9.0)
    with pytest.raises(InvalidEvent, match="price"):
        st.update(KIND_PRICE, "a", 6)
    assert st.values() == [1.0]
    assert st.update(KIND_PRICE, "b", 5, price=2.0) == 0


def features():
    fs = FeatureSet()
    for y in ("BTC", "eth"):
        fs.sma(y, [2, 5], source="trade_price").sma(y, [3]).ema(y, [3, 7], source="trade_volume").cvd(y, [2, 4])
        fs.sma_timed(y, "10ms", ["10ms", "30ms"], source="trade_price").obv_timed(y, "10ms", ["20ms", "50ms"]).trade_count_timed(y, "10ms", "30ms")
        fs.sma_timed(y, "25ms", ["100ms"], source="volume", warmup=FIRST).obv_timed(y, "25ms", ["100ms"], warmup=FIRST).ema(y, [1, 4], warmup=FIRST)
    return fs.day_of_week().time_since_first_event_of_day("+02:00").time_since_first_event_of_day()


def stream(seed, n=300):
    rng, ts, rows = random.Random(seed), -500, []
    for i in range(n):
        ts += rng.choice([0, 0, 1, 3, 7, 40, 450_000])
        k, sy = rng.choice([0, 1, 2, 2, 2, 2, 3, 4]), rng.choice(["BTC", "ETH", "xrp"])
        rows.append(
            (i * 3 + 1, k, None if k == KIND_TIME else sy, ts, rng.choice([1.5, 2.0, 2.0, 3.0]) if k in (KIND_PRICE, KIND_TRADE) else None,
             float(rng.randint(1, 5)) if k in (KIND_VOLUME, KIND_TRADE) else None, rng.choice([0, 1, None]) if k == KIND_TRADE else None,
             1.0 if k == KIND_ORDERBOOK else None, 2.0 if k == KIND_ORDERBOOK else None)
        )
    return rows


def expected(fs, rows):
    st, out = Stepper(fs), {}
    for r in rows:
        st.update(r[1], r[2], r[3], price=r[4], volume=r[5], side=r[6], bid=r[7], ask=r[8])
        out[r[0]] = st.values()
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7)])
def test_batch_equals_steps(spark, seed, parts):
    rows, fs = stream(seed), features()
    ex = FeatureExtractor(fs)
    got = {r["seq"]: r for r in ex.transform(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
    want = expected(fs, rows)
    assert got.keys() == want.keys()
    for seq, values in want.items():
        close([got[seq][n] for n in ex.feature_names()], values)


def test_stream_equals_steps(spark):
    from tidemark.streaming.run import stream_to_table

    rows = stream(3, 120)
    fs = FeatureSet().sma("btc", [2], source="trade_price").ema("eth", [3], source="trade_price").obv_timed("btc", "10ms", ["50ms"]).day_of_week()
    out = stream_to_table(spark, spark.createDataFrame(rows, SCHEMA), lambda s: stream_features(s, fs), "parity-" + str(random.random()))
    names = FeatureExtractor(fs).feature_names()
    got = {r["seq"]: [None if r[n] is None or r[n] != r[n] else r[n] for n in names] for r in out.collect()}
    for seq, values in expected(fs, rows).items():
        close(got[seq], values)


def test_compute_features(spark):
    rows = [(0, "BTC", 1000, 10.0, 1), (1, "ETH", 1000, 20.0, 2), (2, "BTC", 1001, 11.0, 3)]
    df = spark.createDataFrame(rows, "id long, sym string, t long, px double, qty int")
    fs = FeatureSet().trade_count_timed("BTC", "1ms", "10s", warmup=FIRST).trade_count_timed("ETH", "1ms", "10s", warmup=FIRST)
    ex = FeatureExtractor(fs)
    how = {"seq": "id", "symbol": "sym", "time": "t", "price": "px", "volume": "qty"}
    out = ex.compute_features(df, **how).orderBy("id")
    assert out.columns == ["id", "sym", "t", *ex.feature_names()]
    assert [tuple(r)[1:] for r in out.collect()] == [("BTC", 1000, 1.0, None), ("ETH", 1000, 1.0, 1.0), ("BTC", 1001, 2.0, 1.0)]
    assert ex.compute_features(df.limit(0), **how).count() == 0
    assert dict(FeatureExtractor(fs, "float32").compute_features(df, **how).dtypes)[ex.feature_names()[0]] == "float"
    with pytest.raises(TidemarkError, match="distinct"):
        ex.compute_features(df, seq="id", symbol="sym", time="t", price="px", volume="px")
    with pytest.raises(TidemarkError, match="missing"):
        ex.compute_features(df)


@pytest.mark.parametrize(
    "row,text",
    [
        ((1, "", 0, 1.0, 1.0), "non-empty"), ((1, None, 0, 1.0, 1.0), "non-empty"), ((1, "a", 0, float("nan"), 1.0), "finite"),
        ((1, "a", 0, float("inf"), 1.0), "finite"), ((1, "a", 0, 1.0, 0.0), "positive"), ((1, "a", None, 1.0, 1.0), "timestamp"), ((1, "a", -9, 1.0, 1.0), "before"),
        ((0, "a", 0, 1.0, 1.0), "unique"),
    ],
)
def test_bad_rows(spark, row, text):
    df = spark.createDataFrame([(0, "a", 0, 1.0, 1.0), row], "seq long, symbol string, ts long, price double, volume double")
    with pytest.raises(InvalidEvent, match=text):
        FeatureExtractor(FeatureSet().day_of_week()).compute_features(df)


def test_input_types_and_deaf_features(spark):
    ex = FeatureExtractor(FeatureSet().day_of_week())
    df = spark.createDataFrame([(0, "a", 0, 1.0, 1, 0, 0.5, "1", True)], "seq long, symbol string, ts long, price double, volume int, side int, half double, text string, flag boolean")
    assert ex.compute_features(df, side="side").count() == 1
    for how, what in (({"side": "half"}, "side codes"), ({"price": "text"}, "integers or floats"), ({"volume": "flag"}, "integers or floats"), ({"time": "half"}, "integers"), ({"symbol": "ts", "time": "seq", "seq": "side"}, "strings")):
        with pytest.raises(TidemarkError, match=what):
            ex.compute_features(df, **how)
    with pytest.warns(UserWarning, match="a:price:sma:5"):
        FeatureExtractor(FeatureSet().sma("a", [5])).compute_features(df)
    with pytest.raises(InvalidEvent, match="side must be 0 or 1"):
        ex.compute_features(df.withColumn("side", df["side"] + 2), side="side")


def test_state_goes_on_after_a_restart(spark):
    """Two runs over halves of the events give what one run gives."""
    from tidemark.streaming.run import stream_to_table

    rows = stream(5, 120)
    fs = FeatureSet().sma("btc", [2], source="trade_price").ema("eth", [3], source="trade_price").trade_count_timed("btc", "10ms", "50ms").day_of_week()
    name, names = "restart-" + str(random.random()), FeatureExtractor(fs).feature_names()
    for part in (rows[:70], rows[70:]):
        out = stream_to_table(spark, spark.createDataFrame(part, SCHEMA), lambda s: stream_features(s, fs), name)
    got = {r["seq"]: [None if r[n] is None or r[n] != r[n] else r[n] for n in names] for r in out.collect()}
    assert len(got) == len(rows)
    for seq, values in expected(fs, rows).items():
        close(got[seq], values)


def test_invocations_equal_the_stepper(spark):
    rows, fs = stream(6, 150), features()
    st, want = Stepper(fs), {}
    for seq, kind, symbol, ts, price, volume, side, bid, ask in rows:
        want[seq] = st.update(kind, symbol, ts, price=price, volume=volume, side=side, bid=bid, ask=ask)
    assert {r["seq"]: r["updated"] for r in FeatureExtractor(fs).invocations(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_many_chunks(spark):
    """Chunks by binary search, and timed cells over many of them."""
    from pyspark.sql import functions as F

    from tidemark.operators import snapshot

    bounds = [3, 10, 11, 40]
    got = {r["seq"]: r["c"] for r in spark.range(60).select(F.col("id").alias("seq")).select("seq", snapshot.chunk_of(bounds).alias("c")).collect()}
    assert got == {i: sum(b <= i for b in bounds) for i in range(60)}
    rows, fs = stream(7, 300), features()
    old, snapshot.CHUNK_ROWS = snapshot.CHUNK_ROWS, 25
    try:
        ex = FeatureExtractor(fs)
        got = {r["seq"]: r for r in ex.transform(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        snapshot.CHUNK_ROWS = old
    for seq, values in expected(fs, rows).items():
        close([got[seq][n] for n in ex.feature_names()], values)


@pytest.mark.parametrize("long", [0, 2])
def test_long_frames_equal_the_stepper(spark, long):
    """Frames put together from running sums, of every length around a block's edges."""
    from tidemark.operators import sample

    rows, fs = stream(9, 200), FeatureSet()
    for y in ("BTC", "eth"):
        fs.sma(y, [1, 2, 3, 7, 40, 1000], source="trade_price").sma(y, [3, 5]).cvd(y, [2, 4, 11, 500]).sma(y, [6, 900], source="volume", warmup=FIRST).cvd(y, [3, 600], warmup=FIRST)
    old, sample.LONG_FRAME = sample.LONG_FRAME, long
    try:
        ex = FeatureExtractor(fs)
        got = {r["seq"]: r for r in ex.transform(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        sample.LONG_FRAME = old
    for seq, values in expected(fs, rows).items():
        close([got[seq][n] for n in ex.feature_names()], values)


def test_a_frame_costs_the_same_at_any_length(spark):
    """60,000 rows of one symbol in frames of up to a million rows; adding up each frame anew would take minutes."""
    import time

    from pyspark.sql import functions as F

    df = spark.range(60_000).select(F.col("id").alias("seq"), F.lit(KIND_PRICE).alias("kind"), F.lit("a").alias("symbol"), F.col("id").alias("ts"), F.lit(1.5).alias("price"))
    ex, began = FeatureExtractor(FeatureSet().sma("a", [30_000, 1_000_000], warmup=FIRST)), time.perf_counter()
    assert {tuple(r) for r in ex.transform(df, check=False).select(*[F.col(f"`{n}`") for n in ex.feature_names()]).distinct().collect()} == {(1.5, 1.5)}
    assert time.perf_counter() - began < 30


def test_stream_holds_one_stretch_at_a_time(spark, monkeypatch):
    """A table of several stretches, in any order of rows, gives the steps' results; none of its micro-batches holds the whole."""
    from pathlib import Path

    from tidemark.streaming import run

    monkeypatch.setattr(run, "BATCH_ROWS", 25)
    rows = stream(11, 60)
    fs = FeatureSet().ema("eth", [3], source="trade_price", warmup=FIRST).day_of_week()
    name, names = "stretches-" + str(random.random()), FeatureExtractor(fs).feature_names()
    mixed = random.Random(1).sample(rows, len(rows))
    used, given = [], run.work_dir
    monkeypatch.setattr(run, "work_dir", lambda s, n: used.append(given(s, n)) or used[-1])
    out = run.stream_to_table(spark, spark.createDataFrame(mixed, SCHEMA).repartition(3), lambda s: stream_features(s, fs), name)
    got = {r["seq"]: [None if r[n] is None or r[n] != r[n] else r[n] for n in names] for r in out.collect()}
    assert len(got) == len(rows)
    for seq, values in expected(fs, rows).items():
        close(got[seq], values)
    batches = [f for f in (Path(used[0].removeprefix("file://")) / "state" / "commits").iterdir() if f.name.isdigit()]
    assert len(batches) >= 3
