from decimal import Decimal as D

import pytest

from tidemark.operators import orderbook as ob
from tidemark.operators.orderbook import ASK, BID, OrderBook, Outcome, Policy, State


def book(policy=Policy.CONTIGUOUS, size=10):
    b = OrderBook(policy, size)
    b.apply_snapshot(100, [(D(99), D(2)), (D(98), D(3)), (D(97), D(5))], [(D(101), D(6)), (D(102), D(4)), (D(103), D(10))])
    return b


def delta(*changes):
    return [(s, D(p), D(z)) for s, p, z in changes]


def test_queries():
    b = book()
    assert (b.mid_price(), b.spread(), b.spread_bps()) == (100, 2, 200)
    assert (b.weighted_mid_price(), b.microprice()) == (D("100.5"), D("99.5"))
    assert (b.imbalance(1), b.imbalance(0)) == (D("-0.5"), None)
    assert (b.depth_until_price(BID, D(98)), b.depth_until_price(ASK, D(102))) == (5, 10)
    assert b.depth_until_total_size(BID, D(4)) == (99, 98, 5)
    assert b.depth_until_total_size(ASK, D(7)) == (101, 102, 10)
    assert [b.depth_until_total_size(BID, D(x)) for x in (0, -1, 11)] == [None] * 3
    assert (b.volume_between_prices(BID, D(97), D(99)), b.volume_between_prices(ASK, D(101), D(103))) == (8, 10)
    with pytest.raises(ob.InvalidPriceRange):
        b.volume_between_prices(BID, D(99), D(99))
    assert (b.level(BID, D(98)), b.level(BID, D(1))) == (3, None)
    e = OrderBook()
    assert e.best_bid() is e.mid_price() is e.microprice() is e.imbalance(3) is e.spread_bps() is None


def test_live_updates():
    b = book()
    assert b.apply_delta(101, delta((BID, 99, 0), (ASK, 101, 1))) is Outcome.APPLIED
    assert b.best_bid() == (98, 3) and b.best_ask() == (101, 1)
    assert b.apply_delta(101, []) is Outcome.IGNORED_STALE
    with pytest.raises(ob.InvalidUpdate):
        b.apply_delta(102, delta((BID, 1, 1), (BID, -1, 1)))
    assert b.level(BID, D(1)) is None and b.last_update_id == 101


def test_gap_and_resync():
    b = book()
    with pytest.raises(ob.SequenceGap) as e:
        b.apply_delta(103, delta((BID, 50, 1)))
    assert (e.value.expected, e.value.received, b.state) == (101, 103, State.REQUIRE_RESYNC)
    assert b.apply_delta(104, delta((BID, 51, 1))) is Outcome.BUFFERED
    with pytest.raises(ob.SnapshotHistoryGap):
        b.apply_snapshot(101, [], [])
    assert b.apply_snapshot(102, [(D(10), D(1))], []) is Outcome.RESYNCHRONIZED
    assert b.top_n(BID, 9) == [(51, 1), (50, 1), (10, 1)] and b.last_update_id == 104
    with pytest.raises(ob.StaleSnapshot):
        b.apply_snapshot(102, [], [])


def test_awaiting_and_capacity():
    b = OrderBook(buffer_size=2)
    assert b.apply_delta(5, delta((BID, 1, 1))) is Outcome.BUFFERED
    with pytest.raises(ob.SequenceGap):
        b.apply_delta(7, [])
    assert b.state is State.AWAITING_SNAPSHOT
    with pytest.raises(ob.BufferCapacityExceeded):
        b.apply_delta(8, [])
    assert b.state is State.REQUIRE_RESYNC
    m = OrderBook(Policy.MONOTONIC, 3)
    assert m.apply_snapshot(0, [], []) is Outcome.APPLIED
    assert m.apply_delta(5, delta((BID, 0, 1))) is Outcome.APPLIED
    assert m.apply_delta(9, delta((BID, 2, 1))) is Outcome.APPLIED
    assert m.apply_snapshot(6, [(D(1), D(1))], []) is Outcome.APPLIED
    assert m.top_n(BID, 9) == [(2, 1), (1, 1)]


def test_synchronize_runs_books_apart(spark):
    lv = "array<struct<side:string,price:decimal(18,8),size:decimal(18,8)>>"
    one = [(BID, D(1), D(1)), (ASK, D(3), D(1))]
    rows = [("x", 1, "snapshot", 1, one), ("x", 2, "delta", 3, []), ("y", 1, "delta", 1, None), ("x", 3, "snapshot", 2, one)]
    df = spark.createDataFrame(rows, f"book string, seq long, type string, update_id long, changes {lv}").repartition(3)
    got = {(r["book"], r["seq"]): (r["outcome"], r["state"]) for r in ob.synchronize(df).collect()}
    assert got == {("x", 1): ("applied", "live"), ("x", 2): ("sequence_gap", "require_resync"), ("y", 1): ("buffered", "awaiting_snapshot"), ("x", 3): ("resynchronized", "live")}


def test_relational_queries_equal_the_book(spark):
    import random

    rng, b, rows, want = random.Random(4), OrderBook(Policy.MONOTONIC, 10**9), [], {}
    b.apply_snapshot(0, [], [])
    for u in range(1, 121):
        side = rng.choice([BID, ASK])
        c = (side, D(rng.randint(90, 99) if side == BID else rng.randint(100, 109)), D(rng.randint(0, 5)))
        b.apply_delta(u, [c])
        rows.append(("x", u, *c))
        want[u] = (b.best_bid(), b.best_ask(), b.microprice(), b.imbalance(2), b.depth_until_total_size(ASK, D(6)), b.depth_until_price(BID, D(95)))
    ch = spark.createDataFrame(rows, "book string, u long, side string, price decimal(18,8), size decimal(18,8)")
    lv = ob.levels_at(ch, ch.select("book", "u"), 16).cache()
    quotes = {r["u"]: r for r in ob.quotes(ob.best_levels(lv)).collect()}
    imb = {r["u"]: r["imbalance"] for r in ob.imbalance(lv, 2).collect()}
    dts = {r["u"]: (r["price_from"], r["price_to"], r["total_size"]) for r in ob.depth_until_total_size(lv, ASK, 6).collect()}
    dup = {r["u"]: r["depth"] for r in ob.depth_until_price(lv, BID, 95).collect()}
    for u, (bid, ask, micro, im, d, p) in want.items():
        if not bid and not ask:
            continue
        q = quotes[u]
        assert (q["bid_price"], q["ask_price"]) == (bid and bid[0], ask and ask[0])
        assert q["microprice"] == (None if micro is None else pytest.approx(float(micro)))
        assert imb[u] == (None if im is None else pytest.approx(float(im)))
        assert dts.get(u) == d and dup[u] == p


def test_last_change_and_snapshots_in_the_relation(spark):
    """Several changes of one price in one update count by their ordinal; a snapshot replaces the book."""
    import random

    rng = random.Random(8)
    b, rows, snaps, want = OrderBook(Policy.MONOTONIC, 10**9), [], [], {}
    b.apply_snapshot(0, [], [])
    for u in range(1, 90):
        changes = []
        for _ in range(rng.randint(1, 6)):
            side = rng.choice([BID, ASK])
            changes.append((side, D(rng.randint(96, 99) if side == BID else rng.randint(100, 103)), D(rng.randint(0, 4))))
        if u % 20 == 0:
            final = {(s, p): z for s, p, z in changes}
            b.apply_snapshot(u, [(p, z) for (s, p), z in final.items() if s == BID], [(p, z) for (s, p), z in final.items() if s == ASK])
            snaps.append(("x", u))
        else:
            b.apply_delta(u, changes)
        rows += [("x", u, *c, i) for i, c in enumerate(changes)]
        want[u] = {(s, p, z) for s, side in ((BID, b.bids), (ASK, b.asks)) for p, z in side.items()}
    ch = spark.createDataFrame(rows, "book string, u long, side string, price decimal(18,8), size decimal(18,8), ordinal int").repartition(7, "ordinal")
    sn = spark.createDataFrame(snaps, "book string, u long")
    got = {}
    for r in ob.levels_at(ch, ch.select("book", "u").distinct(), 16, sn).collect():
        got.setdefault(r["u"], set()).add((r["side"], r["price"], r["size"]))
    assert got == {u: v for u, v in want.items() if v}
    assert [tuple(r) for r in ob.update_ids(ch, sn).collect()] == [("x", 89, 80)]


def test_update_ids_far_apart(spark):
    """Resting levels, points and snapshots whose update ids lie any distance apart."""
    import random

    rng, rows, snaps, points, want = random.Random(5), [], [], [], {}
    for name, step in (("near", 1), ("far", 3_000_000_000)):
        b = OrderBook(Policy.MONOTONIC, 10**9)
        b.apply_snapshot(0, [], [])
        for i in range(1, 301):
            u, side = i * step, rng.choice([BID, ASK])
            c = (side, D(rng.randint(90, 99) if side == BID else rng.randint(100, 109)), D(rng.randint(0, 3)))
            if i % 110 == 0:
                b.apply_snapshot(u, *[[c[1:]] if side == s else [] for s in (BID, ASK)])
                snaps.append((name, u))
            else:
                b.apply_delta(u, [c])
            rows.append((name, u, *c))
            if i % 3:
                points.append((name, u))
                want[name, u] = {(s, p, z) for s, levels in ((BID, b.bids), (ASK, b.asks)) for p, z in levels.items()}
    points.append(("far", 10**13))
    want["far", 10**13] = {(s, p, z) for s, levels in ((BID, b.bids), (ASK, b.asks)) for p, z in levels.items()}
    ch = spark.createDataFrame(rows, "book string, u long, side string, price decimal(18,8), size decimal(18,8)")
    lv = ob.levels_at(ch, spark.createDataFrame(points, "book string, u long"), 16, spark.createDataFrame(snaps, "book string, u long"))
    got = {}
    for r in lv.collect():
        got.setdefault((r["book"], r["u"]), []).append((r["side"], r["price"], r["size"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    plain = ob.levels_at(ch, spark.createDataFrame(points, "book string, u long"), 16)
    assert {r["u"] for r in ob.best_levels(plain).filter("book = 'far'").collect()} == {u for n, u in want if n == "far"}


@pytest.mark.parametrize("with_snapshots", [False, True])
def test_large_books_in_parts(spark, monkeypatch, with_snapshots):
    """A book over ``BOOK_ROWS`` rows is cut by update id; levels and snapshots before a part enter it."""
    import random

    rng, rows, snaps, want = random.Random(6), [], [], {}
    for name, n in (("large", 600), ("middle", 250), ("small", 20)):
        b = OrderBook(Policy.MONOTONIC, 10**9)
        b.apply_snapshot(0, [], [])
        for u in range(1, n):
            changes = []
            for _ in range(rng.randint(1, 2)):
                side = rng.choice([BID, ASK])
                changes.append((side, D(rng.randint(60, 99) if side == BID else rng.randint(100, 139)), D(rng.randint(0, 4))))
            if with_snapshots and u % 170 == 5:
                final = {(s, p): z for s, p, z in changes}
                b.apply_snapshot(u, *[[(p, z) for (s, p), z in final.items() if s == side] for side in (BID, ASK)])
                snaps.append((name, u))
            else:
                b.apply_delta(u, changes)
            rows += [(name, u, *c, i) for i, c in enumerate(changes)]
            want[name, u] = {(s, p, z) for s, side in ((BID, b.bids), (ASK, b.asks)) for p, z in side.items()}
    ch = spark.createDataFrame(rows, "book string, u long, side string, price decimal(18,8), size decimal(18,8), ordinal int").repartition(5, "size")
    sn = spark.createDataFrame(snaps, "book string, u long") if with_snapshots else None
    monkeypatch.setattr(ob, "BOOK_ROWS", 150)
    every = ob.levels_at(ch, snapshots=sn).collect()
    third = ob.levels_at(ch, ch.select("book", "u").filter("u % 3 = 1").distinct(), 8, sn).collect()
    for got, seen in ((every, want), (third, {k: v for k, v in want.items() if k[1] % 3 == 1})):
        by: dict = {}
        for r in got:
            by.setdefault((r["book"], r["u"]), []).append((r["side"], r["price"], r["size"]))
        assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in seen.items() if v}
        parts = {n: {r["_chunk"] for r in got if r["book"] == n} for n in ("large", "middle", "small")}
        assert len(parts["large"]) > 3 and len(parts["middle"]) > 1 and len(parts["small"]) == 1


@pytest.mark.parametrize("name", ["best_levels", "mid_spread_bps", "weighted_mid", "microprice", "top_n", "level", "depth_until_price", "depth_until_size", "volume_between", "imbalance"])
def test_changes_move_once(spark, sf, name):
    """The levels of a book come from one exchange of its changes, and nothing is sorted after that but spans by book."""
    from tidemark.queries import QUERIES

    plan = QUERIES[f"book_{name}"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("Exchange ") == 1
    assert "Join" not in plan


def test_levels_without_a_price_come_last(spark):
    rows = [("x", 1, ASK, None, D(7)), ("x", 2, ASK, D(101), D(2)), ("x", 3, ASK, D(101), D(0)), ("x", 4, BID, D(99), None)]
    lv = ob.ladders_at(spark.createDataFrame(rows, "book string, u long, side string, price decimal(18,8), size decimal(18,8)"))
    best = {r["u"]: (r["ask_price"], r["ask_size"]) for r in ob.best_levels(lv).collect()}
    assert best == {1: (None, None), 2: (101, 2), 3: (None, None), 4: (None, None)}
    assert {(r["u"], r["rank"], r["price"]) for r in ob.top_n(lv, 2).collect()} == {(1, 1, None), (2, 1, 101), (2, 2, None), (3, 1, None), (4, 1, None)}


@pytest.mark.parametrize("name", ["imbalance", "mid_spread_bps", "microprice", "top_n", "volume_between"])
def test_what_moves_does_not_follow_update_ids(spark, sf, tmp_path, name):
    """Update ids a thousand times as far apart: as many rows shuffled, one a change, and the same levels."""
    from pyspark.sql import functions as F

    from tidemark.queries import QUERIES

    far, sc = spark.read.parquet(f"{sf}/events.parquet").withColumn("event_id", F.col("event_id") * 1000), spark.sparkContext
    far.write.parquet(f"{tmp_path}/events.parquet")
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (got.apply(i) for i in range(got.size()))}

    def run(path, scale):
        before = stages()
        rows = sorted(tuple(r[c] // scale if c == "u" else r[c] for c in r.asDict()) for r in QUERIES[f"book_{name}"](spark, path).collect())
        return rows, sum(n for k, n in stages().items() if k not in before)

    near, moved = run(sf, 1)
    # beside the changes, one row a task for the count that looks for large books
    assert far.count() <= moved <= far.count() + 50
    spread, again = run(str(tmp_path), 1000)
    assert again <= far.count() + 50
    assert repr(spread) == repr(near) and near
