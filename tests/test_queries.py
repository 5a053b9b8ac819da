"""Every query that has SQL against DuckDB, the others run; transformers and sources."""

import pytest

from tidemark.errors import TidemarkError
from tidemark.operators.transformers import ParallelTransformer, Pipeline, StandardScaler, to_ml
from tidemark.queries import ORACLE_SQL, QUERIES
from tidemark.sources.tables import exchange_trades


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == 1000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1000
    assert set(e.oracle_sql()) <= set(e.queries())


def test_transformers(spark):
    df = spark.createDataFrame([(10.0, None), (4.0, 1.0)], "a double, b double")
    assert [r["x"] for r in StandardScaler([("a", "x")], 2.0, 4.0)(df).collect()] == [2.0, 0.5]
    two = ParallelTransformer([StandardScaler([("a", "p"), ("b", "q")], 1.0, 1.0), StandardScaler([("a", "r")], 2.0, 2.0)])(df)
    assert [tuple(r) for r in two.select("p", "q", "r").collect()] == [(9.0, None, 4.0), (3.0, 0.0, 1.0)]
    assert Pipeline()(df) is df
    with pytest.raises(TidemarkError):
        StandardScaler([], 0.0, 0.0)
    assert [r["b"] != r["b"] for r in to_ml(df, ["b"]).collect()] == [True, False]


def test_exchange_trades(spark):
    df = spark.sql("SELECT timestamp_millis(m) AS trade_time, 'X' AS symbol, t AS trade_id, 1.0D AS price, 2.0D AS quantity, b AS buyer_market_maker FROM VALUES (5, 2, true), (5, 1, false), (3, 9, true) v(m, t, b)")
    got = exchange_trades(df).orderBy("seq").select("ts", "side", "symbol").collect()
    assert [tuple(r) for r in got] == [(3, 1, "x"), (5, 0, "x"), (5, 1, "x")]


def test_csv_files(spark, tmp_path):
    """Trades and exchange rows from files, with a time zone of their own, give the features of the rows themselves."""
    from tidemark.extractor import FeatureExtractor
    from tidemark.plans.features import FeatureSet, WarmupPolicy
    from tidemark.sources.tables import read_exchange_csv, read_trades_csv

    (tmp_path / "trades.csv").write_text("symbol,ts,price,volume\n" + "".join(f"{s},{1783893600000 - 30 + 10 * i},{100 + i},{1 + i % 3}\n" for i, s in enumerate(["BTCUSDT", "ETHUSDT"] * 4)))
    fs = FeatureSet().trade_count_timed("BTCUSDT", "10ms", "40ms", warmup=WarmupPolicy.FIRST_VALUE).sma("ethusdt", [2], source="trade_price").time_since_first_event_of_day("UTC+02:00")
    got = FeatureExtractor(fs).compute_features(read_trades_csv(spark, str(tmp_path / "trades.csv"))).orderBy("seq").collect()
    names = FeatureExtractor(fs).feature_names()
    assert [r["symbol"] for r in got][:2] == ["BTCUSDT", "ETHUSDT"]
    assert [[r[n] for n in names] for r in got[:4]] == [[0.0, 1.0, None], [10.0, 1.0, None], [20.0, 2.0, None], [0.0, 2.0, 102.0]]  # a new local day

    (tmp_path / "x.csv").write_text("time,symbol,trade_id,price,quantity,trade_time,buyer_market_maker\n"
                                    "2026-06-16 09:32:28.834000 +00:00,BTCUSDT,7,66672.01,0.5,2026-06-16 11:32:28.834000 +02:00,false\n"
                                    "2026-06-16 09:32:25.783000 +00:00,BTCUSDT,6,66672,0.25,2026-06-16 09:32:25.783000 +00:00,true\n")
    got = read_exchange_csv(spark, str(tmp_path / "x.csv")).orderBy("seq").collect()
    assert [(r["ts"], r["price"], r["volume"], r["side"]) for r in got] == [(1781602345783, 66672.0, 0.25, 1), (1781602348834, 66672.01, 0.5, 0)]


def test_order_has_room_for_ties(spark, monkeypatch):
    from tidemark.sources import tables

    df = spark.sql("SELECT timestamp_millis(5) AS trade_time, 'X' AS symbol, id AS trade_id, 1.0D AS price, 2.0D AS quantity, true AS buyer_market_maker FROM range(20)")
    monkeypatch.setattr(tables, "TIES", 10)
    with pytest.raises(Exception, match="rows of one time stamp"):
        exchange_trades(df).collect()


def test_live_messages_as_a_stream(spark, tmp_path):
    from tidemark.sources.tables import parse_messages

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"e":"trade","s":"BTC","t":9,"p":"1.5","q":"2","T":1000,"m":true}\n{"e":"depth"}\nbroken\n{"e":"trade","s":"ETH","t":1,"p":"3","q":"4","T":1001,"m":false}\n')
    lines = spark.readStream.text(str(tmp_path / "in"))
    query = parse_messages(lines).writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("live").orderBy("seq").collect()
    assert [(r["seq"], r["symbol"], r["ts"], r["price"], r["volume"], r["side"]) for r in got] == [(1_000_000_009, "btc", 1000, 1.5, 2.0, 1), (1_001_000_001, "eth", 1001, 3.0, 4.0, 0)]
