import pytest

from tidemark.errors import InvalidDefinition, TidemarkError
from tidemark.plans.features import FeatureDefinition, FeatureSet, WarmupPolicy, compile_definitions, compile_set, long_id, parse_duration, parse_offset

FIRST = WarmupPolicy.FIRST_VALUE


@pytest.mark.parametrize("text,ms", [("10ms", 10), (" 2s ", 2000), ("3m", 180_000), ("1h", 3_600_000), ("0s", 0)])
def test_durations(text, ms):
    assert parse_duration(text) == ms


@pytest.mark.parametrize("text", ["", "1", "s", "-1s", "1.5s", "1 s", "1d", "99999999999999999999h", None])
def test_bad_durations(text):
    with pytest.raises(TidemarkError):
        parse_duration(text)


@pytest.mark.parametrize("text,ms", [("UTC", 0), ("UTC+2", 7_200_000), ("+02:00", 7_200_000), ("-5:30", -19_800_000), ("UTC+14:00", 50_400_000)])
def test_offsets(text, ms):
    assert parse_offset(text) == ms


@pytest.mark.parametrize("text", ["UTC+14:30", "é", "+-1", "++1", "utc", "UTC +1", "+1:60", ""])
def test_bad_offsets(text):
    with pytest.raises(TidemarkError):
        parse_offset(text)


def test_names():
    fs = FeatureSet().sma("BTC", [2], source="trade_price").ema("BTC", [3]).cvd("BTC", [4]).sma_timed("BTC", "10ms", ["20ms"]).obv_timed("BTC", "10ms", ["20ms"])
    fs.trade_count_timed("BTC", "1s", "2s").day_of_week().time_since_first_event_of_day("+02:00")
    assert compile_set(fs).names == [
        "clock:day_of_week", "clock:time_since_first_event_of_day:7200000ms", "btc:trade:cvd:4", "btc:price:ema:3", "btc:trade:obv_timed:10ms:20ms",
        "btc:trade_price:sma:2", "btc:price:sma_timed:10ms:20ms", "btc:trade:count_timed:1000ms:2000ms",
    ]
    assert fs.indicator_count == 8 and fs.output_count == 8


def test_sources_are_ordered_and_windows_keep_their_order():
    fs = FeatureSet()
    for s in ("volume", "trade_volume", "trade_price", "price"):
        fs.sma("a", [9, 3], source=s)
    assert compile_set(fs).names == [f"a:{s}:sma:{n}" for s in ("price", "trade_price", "trade_volume", "volume") for n in (9, 3)]


def test_symbols_fold_ascii_only():
    assert compile_set(FeatureSet().sma("ÄBc", [1])).names == ["Äbc:price:sma:1"]


def test_compatible_definitions_merge_and_warmups_split():
    assert len(compile_set(FeatureSet().sma("a", [2]).sma("a", [3])).groups) == 1
    assert len(compile_set(FeatureSet().sma("a", [2]).sma("a", [3], warmup=FIRST)).groups) == 2
    with pytest.raises(InvalidDefinition, match="duplicate"):
        compile_set(FeatureSet().sma("a", [2]).sma("a", [2], warmup=FIRST))


@pytest.mark.parametrize(
    "build",
    [
        lambda f: f.sma("a", [0]), lambda f: f.ema("a", [2**64 - 1]), lambda f: f.cvd("a", [-1]), lambda f: f.sma_timed("a", "0ms", ["1ms"]),
        lambda f: f.sma_timed("a", "10ms", ["5ms"]), lambda f: f.obv_timed("a", "10ms", ["15ms"]), lambda f: f.sma("a", list(range(1, 18))),
    ],
)
def test_invalid_definitions(build):
    with pytest.raises(InvalidDefinition):
        compile_set(build(FeatureSet()))


def test_builder_errors():
    with pytest.raises(TidemarkError, match="windows must not be empty"):
        FeatureSet().sma("a", [])
    with pytest.raises(TidemarkError, match="source"):
        FeatureSet().sma("a", [1], source="bid")
    with pytest.raises(InvalidDefinition, match="UTC offset"):
        compile_definitions([FeatureDefinition("time_since_first_event_of_day", offset=61_000)])


def test_long_id():
    d = FeatureDefinition("sma", "btcusd", "trade_price", 20, warmup=WarmupPolicy.FULL_WINDOW)
    assert long_id(d) == "sma:symbol=6:btcusd:source=field.trade_price:window=20:warmup=full_window"


def test_uncanonical_groups_keep_first_seen_order():
    d = [FeatureDefinition("sma", "b", "price", 2), FeatureDefinition("sma", "a", "price", 2), FeatureDefinition("sma", "b", "price", 3)]
    assert compile_definitions(d, canonical=False).names == ["b:price:sma:2", "b:price:sma:3", "a:price:sma:2"]
