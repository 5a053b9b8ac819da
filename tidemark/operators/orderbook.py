"""L2 order books: the synchronising state machine, and queries over level relations.

``OrderBook`` is the state machine for one book; ``synchronize`` runs it for many books of
an update log.  Logs without gaps need no state machine: ``ladders_at`` gives the visible
levels at chosen updates, ``levels_at`` the same as a relation ``(book, u, side, price,
size)`` with sides ``bid`` and ``ask``; the query functions work on either.
"""

from __future__ import annotations

from collections import deque
from decimal import Decimal
from enum import Enum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..errors import TidemarkError

BID, ASK = "bid", "ask"


class Policy(Enum):
    MONOTONIC = "monotonic"
    CONTIGUOUS = "contiguous"


class State(Enum):
    AWAITING_SNAPSHOT = "awaiting_snapshot"
    LIVE = "live"
    REQUIRE_RESYNC = "require_resync"


class Outcome(Enum):
    APPLIED = "applied"
    BUFFERED = "buffered"
    IGNORED_STALE = "ignored_stale"
    RESYNCHRONIZED = "resynchronized"


class BookError(TidemarkError):
    code = "error"


class InvalidUpdate(BookError):
    code = "invalid_update"


class SequenceGap(BookError):
    code = "sequence_gap"

    def __init__(self, expected: int, received: int):
        super().__init__(f"expected update {expected}, received {received}")
        self.expected, self.received = expected, received


class BufferCapacityExceeded(BookError):
    code = "buffer_capacity_exceeded"


class StaleSnapshot(BookError):
    code = "stale_snapshot"


class SnapshotHistoryGap(BookError):
    code = "snapshot_history_gap"


class InvalidPriceRange(BookError):
    code = "invalid_price_range"


class OrderBook:
    """One book.  Deltas are (side, price, size) changes; size 0 deletes a level."""

    def __init__(self, policy: Policy = Policy.CONTIGUOUS, buffer_size: int = 1000):
        self.policy, self.buffer_size = policy, buffer_size
        self.state = State.AWAITING_SNAPSHOT
        self.bids: dict[Decimal, Decimal] = {}
        self.asks: dict[Decimal, Decimal] = {}
        self.history: deque = deque()
        self.last_update_id: int | None = None
        self.last_snapshot_update_id: int | None = None

    def _side(self, side: str) -> dict[Decimal, Decimal]:
        if side not in (BID, ASK):
            raise InvalidUpdate(f"unknown side {side!r}")
        return self.bids if side == BID else self.asks

    def _put(self, changes) -> None:
        for side, price, size in changes:
            levels = self._side(side)
            if size == 0:
                levels.pop(price, None)
            else:
                levels[price] = size

    @staticmethod
    def _valid(levels) -> None:
        if any(p < 0 or s < 0 for p, s in levels):
            raise InvalidUpdate("prices and sizes must not be negative")

    def _room(self) -> None:
        if len(self.history) >= self.buffer_size:
            self.state = State.REQUIRE_RESYNC
            raise BufferCapacityExceeded(f"over {self.buffer_size} updates since the last snapshot")

    def apply_delta(self, update_id: int, changes) -> Outcome:
        changes = list(changes)
        self._valid((p, s) for _, p, s in changes)
        for side, _, _ in changes:
            self._side(side)
        contiguous = self.policy is Policy.CONTIGUOUS
        if self.history:
            newest = self.history[-1][0]
            if update_id <= newest:
                return Outcome.IGNORED_STALE
            if contiguous and update_id != newest + 1:
                return self._gap(newest + 1, update_id, changes)
        if self.state is not State.LIVE:
            self._room()
            self.history.append((update_id, changes))
            return Outcome.BUFFERED
        if self.last_update_id is not None and update_id <= self.last_update_id:
            return Outcome.IGNORED_STALE
        if contiguous and self.last_update_id is not None and update_id != self.last_update_id + 1:
            return self._gap(self.last_update_id + 1, update_id, changes)
        self._room()
        self._put(changes)
        self.last_update_id = update_id
        self.history.append((update_id, changes))
        return Outcome.APPLIED

    def _gap(self, expected: int, update_id: int, changes) -> Outcome:
        self._room()
        self.history.append((update_id, changes))
        if self.state is State.LIVE:
            self.state = State.REQUIRE_RESYNC
        raise SequenceGap(expected, update_id)

    def apply_snapshot(self, last_update_id: int, bids, asks) -> Outcome:
        bids, asks = list(bids), list(asks)
        self._valid(bids + asks)
        if self.last_snapshot_update_id is not None and last_update_id <= self.last_snapshot_update_id:
            raise StaleSnapshot(f"snapshot {last_update_id} is not newer than {self.last_snapshot_update_id}")
        newer = [h for h in self.history if h[0] > last_update_id]
        if self.policy is Policy.CONTIGUOUS:
            for i, (u, _) in enumerate(newer):
                if u != last_update_id + 1 + i:
                    raise SnapshotHistoryGap(f"expected update {last_update_id + 1 + i} after the snapshot, have {u}")
        resync = self.state is State.REQUIRE_RESYNC
        self.bids, self.asks = {}, {}
        self._put([(BID, p, s) for p, s in bids] + [(ASK, p, s) for p, s in asks])
        self.last_update_id = self.last_snapshot_update_id = last_update_id
        self.history = deque(newer)
        for u, changes in newer:
            self._put(changes)
            self.last_update_id = u
        self.state = State.LIVE
        return Outcome.RESYNCHRONIZED if resync else Outcome.APPLIED

    # -- queries --

    def top_n(self, side: str, n: int) -> list[tuple[Decimal, Decimal]]:
        return sorted(self._side(side).items(), reverse=side == BID)[:n]

    def best_bid(self):
        return next(iter(self.top_n(BID, 1)), None)

    def best_ask(self):
        return next(iter(self.top_n(ASK, 1)), None)

    def _best(self):
        b, a = self.best_bid(), self.best_ask()
        return (b, a) if b and a else None

    def mid_price(self):
        return (x[0][0] + x[1][0]) / 2 if (x := self._best()) else None

    def spread(self):
        return abs(x[1][0] - x[0][0]) if (x := self._best()) else None

    def spread_bps(self):
        mid = self.mid_price()
        return self.spread() / mid * 10000 if mid else None

    def level(self, side: str, price: Decimal):
        return self._side(side).get(price)

    def depth_until_price(self, side: str, price: Decimal):
        return sum((s for p, s in self._side(side).items() if (p >= price if side == BID else p <= price)), Decimal(0))

    def depth_until_total_size(self, side: str, size: Decimal):
        if size <= 0:
            return None
        total, first = Decimal(0), None
        for p, s in self.top_n(side, len(self._side(side))):
            first = p if first is None else first
            total += s
            if total >= size:
                return first, p, total
        return None

    def volume_between_prices(self, side: str, low: Decimal, high: Decimal):
        if low >= high:
            raise InvalidPriceRange("from must be below to")
        return sum((s for p, s in self._side(side).items() if low <= p < high), Decimal(0))

    def weighted_mid_price(self):
        """Each price by its own size."""
        if not (x := self._best()):
            return None
        (bp, bs), (ap, az) = x
        return (bp * bs + ap * az) / (bs + az)

    def microprice(self):
        """Each price by the opposite size."""
        if not (x := self._best()):
            return None
        (bp, bs), (ap, az) = x
        return (bp * az + ap * bs) / (bs + az)

    def imbalance(self, n: int):
        b, a = (sum((s for _, s in self.top_n(side, n)), Decimal(0)) for side in (BID, ASK))
        return (b - a) / (b + a) if b + a else None


#: Result of ``synchronize``: one row an update, in arrival order.
SYNC_FIELDS = "book string, seq long, outcome string, state string, last_update_id long, best_bid decimal(18,8), best_ask decimal(18,8)"


def synchronize(updates: DataFrame, policy: Policy = Policy.CONTIGUOUS, buffer_size: int = 1000) -> DataFrame:
    """Run the state machine per book.

    ``updates``: book string, seq long (arrival), type string (delta or snapshot), update_id
    long, changes array<struct<side,price,size>> (a snapshot's levels likewise).  Work is
    parallel by book; within one the machine is sequential by nature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        book, rows = OrderBook(policy, buffer_size), []
        for r in pdf.sort_values("seq").itertuples():
            ch = [(c["side"], c["price"], c["size"]) for c in (r.changes if r.changes is not None else ())]
            try:
                if r.type == "snapshot":
                    out = book.apply_snapshot(int(r.update_id), [(p, s) for d, p, s in ch if d == BID], [(p, s) for d, p, s in ch if d == ASK]).value
                else:
                    out = book.apply_delta(int(r.update_id), ch).value
            except BookError as e:
                out = e.code
            b, a = book.best_bid(), book.best_ask()
            rows.append((r.book, r.seq, out, book.state.value, book.last_update_id, b and b[0], a and a[0]))
        got = pd.DataFrame(rows, columns=["book", "seq", "outcome", "state", "last_update_id", "best_bid", "best_ask"])
        return got.astype({"last_update_id": "Int64"})

    return updates.groupBy("book").applyInPandas(run, SYNC_FIELDS)


# -- relational form --


#: Points of a book that share a list of levels; a level that rests long is once in each of these lists.
BIN_POINTS = 32
#: Rows of a book up to which one task takes it whole; books with more are cut by update id.
BOOK_ROWS = 50_000

_CHANGE, _POINT, _SNAPSHOT = 0, 1, 2


def _is(side: str) -> Column:
    return F.col("side") == side


def _rung(side: str, *also: Column) -> Column:
    """A level in the order of its side, best first; one without a price comes last."""
    price = F.col("price")
    return F.struct(price.isNull().alias("_none"), (-price if side == BID else price).alias("_order"), price, F.col("size"), *also)


def _cuts(rows: DataFrame) -> DataFrame | None:
    """``book, _cuts`` of the books over ``BOOK_ROWS`` rows: update ids that cut them in parts of about as many.  Of larger inputs the books with
    over a thousandth of all rows, which are fewer than a thousand."""
    total = rows.count()
    if total <= BOOK_ROWS:
        return None
    often = rows.stat.freqItems(["book"], max(0.001, BOOK_ROWS / total)).first()[0]  # these and others
    often = rows.filter(F.col("book").isin(list(often)))
    large = {r["book"]: r["n"] for r in often.groupBy("book").agg(F.count("*").alias("n")).collect() if r["n"] > BOOK_ROWS}
    if not large:
        return None
    n = -(-max(large.values()) // BOOK_ROWS)
    got = often.filter(F.col("book").isin(list(large))).groupBy("book").agg(F.percentile_approx("u", [i / n for i in range(1, n)], max(1000, 4 * n)).alias("q")).collect()
    return rows.sparkSession.createDataFrame([(r["book"], sorted(set(r["q"]))) for r in got], StructType([rows.schema["book"], StructField("_cuts", ArrayType(LongType()))]))


def _carried(rows: DataFrame, tie: Column) -> DataFrame:
    """Of books in parts: for each part the last change of each price, and the last snapshot, before it; those that a snapshot between has ended are left out."""
    key = ["book", "_kind", "side", "price"]
    ends = rows.filter(f"_cuts is not null and _kind <> {_POINT}").groupBy(*key, "_chunk").agg(F.max(F.struct("u", tie.alias("t"), "size")).alias("e"), F.first("_cuts").alias("_cuts"))
    stops = ends.filter(f"_kind = {_SNAPSHOT}").groupBy("book").agg(F.sort_array(F.collect_list(F.struct("_chunk", F.col("e.u").alias("u")))).alias("_stops"))
    after = lambda s: (s["_chunk"] > F.col("_chunk")) | ((s["_chunk"] == F.col("_chunk")) & (s["u"] > F.col("e.u")))
    until = F.coalesce(F.lead("_chunk").over(Window.partitionBy(*key).orderBy("_chunk")), F.size("_cuts"))
    ends = ends.withColumn("_until", until).join(F.broadcast(stops), "book", "left")
    ends = ends.withColumn("_until", F.least("_until", F.get(F.filter("_stops", after), F.lit(0))["_chunk"]))
    ends = ends.filter(f"_until > _chunk and (_kind = {_SNAPSHOT} or e.size <> 0)")
    return ends.select(*key, "e.u", "e.size", F.explode(F.sequence(F.col("_chunk") + 1, F.col("_until"))).alias("_chunk"))


def ladders_at(changes: DataFrame, points: DataFrame | None = None, bin_width: int = BIN_POINTS, snapshots: DataFrame | None = None) -> DataFrame:
    """The visible levels at each point as two arrays, best level first: ``book, _chunk, u, bids, asks``, for points with a level.

    ``changes``: book, u, side, price, size and perhaps ordinal.  Of several changes of a price in one update the one of the highest ``ordinal``
    counts; the largest size where changes have no ordinal (their order is not known then).
    ``points``: book, u; without them every update is one.  ``snapshots``: book, u of updates that replace the whole book; changes at such an
    update are its levels, and those before it end there.

    Rows move once, to the book or, of a book over ``BOOK_ROWS`` rows, to its part (``_chunk``), which the levels before it enter as rows.  There
    the points are numbered; ``bin_width`` of them share a list of all levels that any of them sees, from which each point takes its own.  Update
    ids may be as far apart as they like.  All functions below take this form, for which nothing moves or is sorted again."""
    tie = "ordinal" if "ordinal" in changes.columns else "size"
    rows = changes.select("book", "u", F.lit(_CHANGE).alias("_kind"), "side", "price", "size", *(["ordinal"] if tie == "ordinal" else []))
    for kind, df in ((_POINT, points), (_SNAPSHOT, snapshots)):
        if df is not None:
            rows = rows.unionByName(df.select("book", "u", F.lit(kind).alias("_kind")), allowMissingColumns=True)
    rows = rows.filter("book is not null and u is not null")
    cuts, at = _cuts(rows), F.col("u")
    if cuts is None:
        rows = rows.withColumn("_chunk", F.lit(0))
    else:
        chunk = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("u"))), F.lit(0))
        rows = rows.join(F.broadcast(cuts), "book", "left").withColumn("_chunk", F.when(F.col("_cuts").isNotNull(), chunk).otherwise(0))
        rows = rows.withColumn("_in", F.lit(False)).unionByName(_carried(rows, F.col(tie)).withColumn("_in", F.lit(True)), allowMissingColumns=True).drop("_cuts")
        at = F.when(~F.col("_in"), F.col("u"))  # what enters a part stands before all of it
    is_point = F.col("_kind") == (_CHANGE if points is None else _POINT)
    if cuts is not None:
        is_point = is_point & ~F.col("_in")
    is_snapshot = F.col("_kind") == _SNAPSHOT

    part = ["book", "_chunk"]
    so_far = Window.partitionBy(*part).orderBy(at)
    seen = F.dense_rank().over(so_far) if points is None else F.sum(is_point.cast("int")).over(so_far)
    rows = rows.withColumn("_bin", F.greatest(F.floor((seen - 1) / F.lit(bin_width)), F.lit(0)).cast("int"))
    rows = rows.withColumn("_stop", F.max("_bin").over(Window.partitionBy(*part)))
    epoch = []
    if snapshots is not None:
        far = F.lit(2**31 - 1)
        following = F.coalesce(F.lead("_bin").over(Window.partitionBy(*part, "_kind").orderBy("u")), far)
        rows = rows.withColumn("_next", F.when(is_snapshot, F.struct("u", following.alias("bin"))))
        first = F.coalesce(F.min(F.when(is_snapshot, F.col("_bin"))).over(Window.partitionBy(*part)), far)
        rows = rows.withColumn("_now", F.max("_next").over(so_far)).withColumn("_stop", F.least("_stop", F.coalesce("_now.bin", first)))
        rows, epoch = rows.withColumn("_epoch", F.col("_now.u")).drop("_next", "_now"), ["_epoch"]
    price = Window.partitionBy(*part, "_kind", "side", "price").orderBy("u", tie, "size")
    rows = rows.select("*", F.lead("u").over(price).alias("_to"), F.lead("_bin").over(price).alias("_to_bin"))

    rests = (F.col("_kind") == _CHANGE) & (F.col("size") != 0)
    rows = rows.withColumns({"_rests": F.coalesce(rests, F.lit(False)), "_is_point": is_point})
    rows = rows.filter(f"(_is_point or _rests) and (_kind <> {_CHANGE} or _to is null or _to <> u)")
    bins = F.when(F.col("_rests"), F.sequence("_bin", F.least(F.coalesce("_to_bin", "_stop"), "_stop"))).otherwise(F.array("_bin"))
    rows = rows.withColumn("_here", F.explode(bins))
    span = [F.col("u").alias("_from"), F.col("_to"), *epoch]
    own = F.when(F.col("_is_point") & (F.col("_here") == F.col("_bin")), F.struct("u", *epoch))
    sides = [F.sort_array(F.collect_list(F.when(F.col("_rests") & _is(s), _rung(s, *span)))).alias(f"_{s}s") for s in (BID, ASK)]
    lists = rows.groupBy(*part, "_here").agg(*sides, F.collect_set(own).alias("_points"))

    def visible(s: Column) -> Column:
        now = (s["_from"] <= F.col("_p.u")) & (s["_to"].isNull() | (F.col("_p.u") < s["_to"]))
        return now & s["_epoch"].eqNullSafe(F.col("_p._epoch")) if epoch else now

    each = lists.select(*part, F.explode("_points").alias("_p"), "_bids", "_asks").filter(F.exists("_bids", visible) | F.exists("_asks", visible))
    return each.select(*part, "_p.u", F.filter("_bids", visible).alias("bids"), F.filter("_asks", visible).alias("asks"))


def levels_at(changes: DataFrame, points: DataFrame | None = None, bin_width: int = BIN_POINTS, snapshots: DataFrame | None = None) -> DataFrame:
    """The levels of :func:`ladders_at` as the relation ``book, _chunk, u, side, price, size``."""

    def of(side: str) -> Column:
        return F.transform(f"{side}s", lambda s: F.struct(F.lit(side).alias("side"), s["price"].alias("price"), s["size"].alias("size")))

    return ladders_at(changes, points, bin_width, snapshots).select("book", "_chunk", "u", F.inline(F.concat(of(BID), of(ASK))))


def _point(levels: DataFrame) -> list[str]:
    """The columns of one point; the chunk, where there is one, follows from the others and tells how rows are parted."""
    return [c for c in ("book", "_chunk", "u") if c in levels.columns]


def _ladders(levels: DataFrame) -> DataFrame:
    """The form with two arrays, of a relation too."""
    if "bids" in levels.columns:
        return levels
    return levels.groupBy(*_point(levels)).agg(*[F.sort_array(F.collect_list(F.when(_is(s), _rung(s)))).alias(f"{s}s") for s in (BID, ASK)])


def _total(ladders: DataFrame, rungs: Column) -> Column:
    """Sum of the sizes."""
    kind = _sum_type(ladders)
    return F.aggregate(rungs, F.lit(0).cast(kind), lambda a, s: (a + s["size"]).cast(kind))


def _sum_type(ladders: DataFrame) -> DataType:
    return ladders.select(F.get("bids", F.lit(0))["size"].alias("size")).agg(F.sum("size")).schema[0].dataType


def update_ids(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``last_update_id`` and ``last_snapshot_update_id`` (null before any snapshot) by book."""
    last = changes.select("book", "u", F.lit(None).cast("long").alias("s")).union(snapshots.select("book", "u", F.col("u").alias("s")))
    return last.groupBy("book").agg(F.max("u").alias("last_update_id"), F.max("s").alias("last_snapshot_update_id"))


def best_levels(levels: DataFrame) -> DataFrame:
    """``bid_price, bid_size, ask_price, ask_size`` by book and u; null for a missing side."""
    first = [(s, F.get(f"{s}s", F.lit(0))) for s in (BID, ASK)]
    return _ladders(levels).select("book", "u", *[c for s, x in first for c in (x["price"].alias(f"{s}_price"), F.when(x["price"].isNotNull(), x["size"]).alias(f"{s}_size"))])


def quotes(best: DataFrame) -> DataFrame:
    """Mid, spread, spread in basis points, weighted mid and microprice from best levels."""
    bp, bs, ap, az = (F.col(c).cast("double") for c in ("bid_price", "bid_size", "ask_price", "ask_size"))
    mid = (bp + ap) / 2
    return best.select(
        "*", mid.alias("mid_price"), F.abs(ap - bp).alias("spread"), F.when(mid != 0, F.abs(ap - bp) / F.when(mid != 0, mid) * 10000).alias("spread_bps"),
        ((bp * bs + ap * az) / (bs + az)).alias("weighted_mid_price"), ((bp * az + ap * bs) / (bs + az)).alias("microprice"),
    )


def ranked(levels: DataFrame) -> DataFrame:
    """Levels with their priority ``rank`` from 1 and cumulative size ``depth`` on their side."""
    order = F.when(_is(BID), -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*_point(levels), "side").orderBy(order)
    return levels.select("*", F.row_number().over(w).alias("rank"), F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))


def top_n(levels: DataFrame, n: int) -> DataFrame:
    """The first ``n`` levels of each side with their ``rank`` from 1."""

    def first(side: str) -> Column:
        return F.transform(F.slice(f"{side}s", 1, n), lambda s, i: F.struct(F.lit(side).alias("side"), s["price"].alias("price"), s["size"].alias("size"), (i + 1).alias("rank")))

    return _ladders(levels).select("book", "u", F.inline(F.concat(first(BID), first(ASK))))


def level_size(levels: DataFrame, side: str, price) -> DataFrame:
    return _ladders(levels).select("book", "u", F.explode(F.filter(f"{side}s", lambda s: s["price"] == price)).alias("_s")).select("book", "u", "_s.size")


def depth_until_price(levels: DataFrame, side: str, price) -> DataFrame:
    """Sum of sizes from the best level through ``price``; 0 where there is none."""
    ladders = _ladders(levels)
    within = F.filter(f"{side}s", lambda s: s["price"] >= price if side == BID else s["price"] <= price)
    return ladders.select("book", "u", _total(ladders, within).alias("depth"))


def depth_until_total_size(levels: DataFrame, side: str, size) -> DataFrame:
    """``price_from, price_to, total_size`` of the first levels that hold ``size``; no row where they cannot."""
    ladders, rungs = _ladders(levels), F.col(f"{side}s")
    if size <= 0:
        ladders = ladders.filter(F.lit(False))
    kind, best = _sum_type(ladders), F.get(rungs, F.lit(0))["price"]
    price = ladders.select(best.alias("p")).schema[0].dataType
    start = F.struct(F.lit(0).cast(kind).alias("total"), F.lit(None).cast(price).alias("price"))
    reached = F.aggregate(rungs, start, lambda a, s: F.when(a["total"] >= size, a).otherwise(F.struct((a["total"] + s["size"]).cast(kind).alias("total"), s["price"].alias("price"))))
    held = F.filter(F.array(reached), lambda a: a["total"] >= size)
    return ladders.select("book", "u", F.inline(F.transform(held, lambda a: F.struct(best.alias("price_from"), a["price"].alias("price_to"), a["total"].alias("total_size")))))


def volume_between_prices(levels: DataFrame, side: str, low, high) -> DataFrame:
    if low >= high:
        raise InvalidPriceRange("from must be below to")
    ladders = _ladders(levels)
    inside = F.filter(f"{side}s", lambda s: (s["price"] >= low) & (s["price"] < high))
    return ladders.select("book", "u", _total(ladders, inside).alias("volume"))


def imbalance(levels: DataFrame, n: int) -> DataFrame:
    """``(bids - asks) / (bids + asks)`` over the top n levels of each side; null where their sum is 0."""
    ladders = _ladders(levels)
    sums = ladders.select("book", "u", *[_total(ladders, F.slice(f"{s}s", 1, n)).cast("double").alias(f"_{s}") for s in (BID, ASK)])
    b, a = F.col("_bid"), F.col("_ask")
    return sums.select("book", "u", ((b - a) / F.when(b + a != 0, b + a)).alias("imbalance"))
