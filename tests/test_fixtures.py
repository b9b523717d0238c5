"""Hand-made cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.operators import bars as B
from tidemark.operators import book as K
from tidemark.operators import events as E
from tidemark.operators import flow as O
from tidemark.operators import joins as J
from tidemark.operators import profile as P
from tidemark.operators import risk as R
from tidemark.operators import screens as S
from tidemark.sinks import tables as W

BOOK = [
    (1, "insert", 1, "B", 10, 100), (2, "insert", 2, "B", 10, 50), (3, "insert", 3, "B", 9, 30),
    (4, "insert", 4, "S", 11, 40), (5, "trade", 1, "B", 10, 20), (6, "trade", 4, "S", 11, 20),
    (7, "cancel", 2, "B", 10, 50), (8, "cancel", 3, "B", 9, 10), (9, "cancel", 9, "B", 9, 5),
]


def book(spark):
    return spark.createDataFrame([(1, 1, *r) for r in BOOK],
                                 "SecuCode long, TradingDay long, seq long, kind string, order_id long, side string, price long, qty long")


def test_book(spark):
    cancels = {r.order_id: (r.price, r.level, r.queue) for r in K.cancel_locations(book(spark)).collect()}
    assert cancels == {2: (10, 1, 2), 3: (9, 2, 1), 9: (0, -1, -1)}
    levels = {(r.side, r.price): (r.volume, r.orders) for r in K.depth(K.live_orders(book(spark))).collect()}
    assert levels == {("B", 10): (80, 1), ("B", 9): (20, 1), ("S", 11): (20, 1)}


def test_book_ignores_repeats_and_early_events(spark):
    extra = [(0, "cancel", 1, "B", 10, 70), (10, "insert", 1, "B", 12, 5), (11, "cancel", 1, "B", 10, 500)]
    rows = spark.createDataFrame([(1, 1, *r) for r in BOOK + extra], book(spark).schema)
    live = {r.order_id: r.live for r in K.live_orders(rows).collect()}
    assert live == {1: 0, 2: 0, 3: 20, 4: 20}


def test_own_best_orders_keep_a_level_alive(spark):
    """A chain of own-best orders keeps a level alive after its first order is gone."""
    rows = [
        (1, "insert", 1, "B", 10, 5), (2, "insert", 2, "B", None, 5), (3, "cancel", 1, "B", 10, 5),
        (4, "insert", 3, "B", 8, 5), (5, "insert", 4, "B", None, 5), (6, "cancel", 2, "B", None, 5),
        (7, "insert", 5, "B", None, 5), (8, "cancel", 4, "B", None, 5), (9, "cancel", 5, "B", None, 5),
        (10, "insert", 6, "B", None, 5),
    ]
    df = spark.createDataFrame([(1, 1, *r) for r in rows], book(spark).schema)
    found = K.best_prices(df).orderBy("seq").collect()
    assert {r.order_id: r.price for r in found if r.kind == "insert"} == {1: 10, 2: 10, 3: 8, 4: 10, 5: 10, 6: 8}
    assert [r.best_bid for r in found] == [10] * 8 + [8, 8] and {r.best_ask for r in found} == {0}


class PlainBook:
    """A book kept event by event, as lists."""

    def __init__(self):
        self.orders = {}  # id: [side, price, qty, number]

    def best(self, side):
        prices = [o[1] for o in self.orders.values() if o[0] == side]
        return (max if side == "B" else min)(prices) if prices else 0

    def levels(self, side, n):
        prices = sorted({o[1] for o in self.orders.values() if o[0] == side}, reverse=side == "B")[:n]
        at = lambda p: [o for o in self.orders.values() if o[0] == side and o[1] == p]
        return [(float(p), sum(o[2] for o in at(p)), len(at(p))) for p in prices]

    def apply(self, number, kind, oid, side, price, qty, seen):
        """Level and queue of a cancel, the price of an insert."""
        if kind == "insert":
            if oid in seen:
                return None
            seen.add(oid)
            price = self.best(side) if price is None else price
            self.orders[oid] = [side, price, qty, number]
            return price
        if oid not in self.orders:
            return (0, -1, -1)
        own = self.orders[oid]
        better = {o[1] for o in self.orders.values() if o[0] == own[0] and (o[1] > own[1] if own[0] == "B" else o[1] < own[1])}
        ahead = sum(o[0] == own[0] and o[1] == own[1] and o[3] < own[3] for o in self.orders.values())
        own[2] -= min(qty, own[2])
        if own[2] == 0:
            del self.orders[oid]
        return (own[1], len(better) + 1, ahead + 1)


@pytest.mark.parametrize("seed", range(2))
def test_the_book_against_one_kept_event_by_event(spark, seed):
    """Few prices, many orders, repeated inserts, events of unknown orders, own-best orders: best prices, places and depth."""
    import random

    rng, rows = random.Random(seed), []
    for seq in range(1, 700):
        oid = rng.randint(1, 220)
        kind = rng.choice(["insert", "insert", "trade", "cancel"])
        price = None if kind == "insert" and rng.random() < 0.2 else rng.randint(1, rng.choice([3, 40]))
        rows.append((seq, kind, oid, "B" if oid % 3 else "S", price, rng.randint(1, 9)))
    plain, seen, best, places, prices, depth = PlainBook(), set(), {}, {}, {}, {}
    for number, (seq, kind, oid, side, price, qty) in enumerate(rows, 1):
        got = plain.apply(number, kind, oid, side, price, qty, seen)
        best[seq] = (plain.best("B"), plain.best("S"))
        depth[number] = (plain.levels("B", 3), plain.levels("S", 3))
        if kind == "cancel":
            places[seq] = got
        elif kind == "insert" and got is not None:
            prices[seq] = got
    df = spark.createDataFrame([(1, 1, *r) for r in rows], book(spark).schema).repartition(3)
    found = K.best_prices(df).collect()
    assert {r.seq: (r.best_bid, r.best_ask) for r in found} == best
    assert {r.seq: r.price for r in found if r.seq in prices} == prices
    assert {r.seq: (r.price, r.level, r.queue) for r in K.cancel_locations(df).collect()} == places
    at = K.positioned(df)
    got = {r["_pos"]: ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in K.depth_at(at, at.where("_pos % 5 = 0"), 3).collect()}
    assert got == {n: depth[n] for n in depth if n % 5 == 0}


def test_a_hot_level_of_many_orders(spark):
    """Twenty thousand orders on one level, cancelled from the back: the queue place is the order's own turn."""
    n = 20_000
    base = spark.range(n).select(F.lit(1).cast("long").alias("SecuCode"), F.lit(1).cast("long").alias("TradingDay"), (F.col("id") + 1).alias("seq"),
                                 F.lit("insert").alias("kind"), "id", F.lit("B").alias("side"), F.lit(10).cast("long").alias("price"), F.lit(5).cast("long").alias("qty"))
    gone = base.withColumn("seq", F.lit(2 * n + 1) - F.col("seq")).withColumn("kind", F.lit("cancel"))
    events = base.unionByName(gone).withColumnRenamed("id", "order_id")
    wrong = K.cancel_locations(events).where("price <> 10 or level <> 1 or queue <> order_id + 1")
    assert wrong.isEmpty()


def deals(spark, rows):
    return spark.createDataFrame(rows, "SecuCode long, TradingDay long, Price long, Volume long, Side int")


@pytest.mark.parametrize("volumes,ratio,want", [
    ({1: 5, 2: 10, 3: 40, 4: 25, 5: 20}, 0.7, (3, 3, 5)), ({1: 10, 2: 30, 3: 10}, 0.7, (2, 1, 2))])
def test_value_area(spark, volumes, ratio, want):
    vap = P.volume_at_price(deals(spark, [(1, 1, p, v, 0) for p, v in volumes.items()]))
    pairs = spark.createDataFrame([(1, 1, 1)], "SecuCode long, target long, TradingDay long")
    r = P.value_areas(P.pooled_profiles(vap, pairs), ratio).first()
    assert (r.poc, r.val, r.vah) == want


def test_value_area_against_the_two_pointer_walk(spark):
    import random
    rng = random.Random(5)
    rows, want = [], {}
    for code in range(120):
        v = {p: rng.randint(1, 6) for p in range(rng.randint(1, 12))}
        rows += [(code, 1, p, q, 0) for p, q in v.items()]
        poc = min(p for p in v if v[p] == max(v.values()))
        low = high = poc
        got, goal = v[poc], 0.7 * sum(v.values())
        while got < goal:
            a, b = v.get(low - 1, -1), v.get(high + 1, -1)
            if a >= b:
                low, got = low - 1, got + a
            else:
                high, got = high + 1, got + b
        want[code] = (poc, low, high)
    vap = P.volume_at_price(deals(spark, rows))
    pairs = vap.select("SecuCode", F.lit(1).cast("long").alias("target"), "TradingDay").distinct()
    got = {r.SecuCode: (r.poc, r.val, r.vah) for r in P.value_areas(P.pooled_profiles(vap, pairs)).collect()}
    assert got == want


def test_right_closed_bars(spark):
    base = 1_700_000_040_000_000 // 60_000_000 * 60_000_000
    rows = [(base, 1, 10, 1), (base + 30_000_000, 2, 12, 2), (base + 60_000_000, 3, 11, 3), (base + 60_001_000, 4, 9, 4)]
    df = spark.createDataFrame([("a", *r) for r in rows], "symbol string, ts_us long, seq long, price long, volume long")
    got = [(r.ts - base // 1_000_000, r.open, r.high, r.low, r.close, r.volume)
           for r in B.tick_bars(df, ["symbol"], "ts_us", "seq", 60).orderBy("ts").collect()]
    assert got == [(0, 10, 10, 10, 10, 1), (60, 12, 12, 11, 11, 5), (120, 9, 9, 9, 9, 4)]


@pytest.mark.parametrize("bucket", ["t div 2", "t div 100"])
def test_chandelier_exit(spark, bucket):
    bars = [(1, True, 10.0, 9.5), (2, False, 12.0, 11.0), (3, False, 12.0, 9.9), (4, False, 13.0, 8.0), (5, True, 9.0, 8.5)]
    df = spark.createDataFrame([("a", t, e, h, c, 1.0, 2.0) for t, e, h, c in bars],
                               "symbol string, t long, entry boolean, high double, close double, atr double, k_atr double")
    out = S.chandelier_exits(df, ["symbol"], "t", bucket).orderBy("t").collect()
    assert [r.exit for r in out] == [False, False, True, False, False]


def test_next_valid_time(spark):
    rows = [(1, 0), (2, -1), (3, -11), (4, 1), (5, -1)]
    df = spark.createDataFrame([(1, t, t, s) for t, s in rows], "SecuCode long, DealTime long, DealID long, Side int")
    got = [r.next_time for r in E.next_trade_time(df, ["SecuCode"]).orderBy("DealTime").collect()]
    assert got == [4, 4, 4, E.END_OF_DAY, E.END_OF_DAY]


def test_default_tiers(spark):
    df = spark.createDataFrame([(v,) for v in (999, 1000, 8000, 50000)], "v long")
    tier = C.size_tier(F.col("v"), *[F.lit(x) for x in C.DEFAULT_TIERS])
    assert [r.t for r in df.select(tier.alias("t")).collect()] == ["Small", "Medium", "Large", "Mega"]


def test_as_of_and_calendar(spark):
    left = spark.createDataFrame([("A", 20160101)], "k string, t long")
    right = spark.createDataFrame([("A", 20151231, 1), ("A", 20160331, 2)], "k string, t long, v int")
    ahead = J.as_of(left, right, ["k"], "t", "r", "t div 500", "forward", False).first()
    back = J.as_of(left, right, ["k"], "t", "r", "t div 500").first()
    assert (ahead.r.t, back.r.t) == (20160331, 20151231)
    same = spark.createDataFrame([("A", 20160331)], "k string, t long")
    assert J.as_of(same, right, ["k"], "t", "r", "t div 500", "forward", False).first().r is None
    assert J.as_of(same, right, ["k"], "t", "r", "t div 500", "forward", True).first().r.v == 2
    assert J.as_of(same, right, ["k"], "t", "r", "t div 500", "backward", False).first().r.v == 1
    calendar = spark.createDataFrame([(10,), (11,)], "d long")
    days = spark.createDataFrame([(9,), (12,)], "d long")
    roll = lambda forward: {r.d: r.trading_day for r in J.roll_calendar(days, calendar, "d", forward).collect()}
    assert roll(True)[9] == 10 and roll(False)[12] == 11


def test_value_at_risk(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(-5, 15)], "k string, r double")
    row = R.value_at_risk(df, ["k"]).first()
    assert (row["var"], row["cvar"]) == (-4.0, -5.0)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "d long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "d long, v string")
    once = W.upserted(old, new, ["d"])
    twice = W.upserted(once, new, ["d"])
    want = {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_walk_forward_windows(spark):
    bars = spark.createDataFrame([("a", t) for t in range(100, 141)], "symbol string, t long")
    got = {}
    for r in J.in_slices(bars, "symbol", "t", 24, 6, 1).collect():
        got.setdefault(r.slice_no, []).append(r.t)
    want = J.walk_forward_slices(100, 140, 24, 6)
    assert {k: (min(v), max(v)) for k, v in got.items()} == dict(enumerate(want))


def test_tier_sizes_keep_every_order(spark):
    rows = [(1, 1, 10, 100 + i % 3, 0, i, 1000, i, 93000000) for i in range(50)]
    df = spark.createDataFrame(rows, "SecuCode long, TradingDay long, Price long, Volume long, Side int, BuyID long, SellID long, DealID long, DealTime long")
    got = {(r.order_side, r.volume): (r.orders, r.volume_mean) for r in O.order_tier_sizes(df).collect()}
    total = sum(100 + i % 3 for i in range(50))
    assert {k: n for k, (n, _) in got.items() if k[0] == "buy"} == {("buy", 100): 17, ("buy", 101): 17, ("buy", 102): 16}
    assert got["buy", 100][1] == total / 50 and got["sell", total] == (1, total)


def test_order_keys_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(-3, 5), (-3, 7), (2, None)], "a long, b long")
    key = C.order_key((F.col("a"), 9), (F.col("b"), 3))
    got = [r[0] for r in df.select(key.alias("k")).collect()]
    assert got[0] < got[1] and got[2] is None
    for bad in (-1, 1000):
        with pytest.raises(Exception, match="beyond 3 digits"):
            spark.createDataFrame([(1, bad)], "a long, b long").select(key).collect()


def test_own_best_orders_count_with_the_price_they_got(spark):
    rows = [(1, 1, 1, "insert", 1, "B", 10, 20), (1, 1, 2, "insert", 2, "B", None, 20)]
    df = spark.createDataFrame(rows, "SecuCode long, TradingDay long, seq long, kind string, order_id long, side string, price long, qty long")
    assert [r.bid_price for r in K.book_totals(df).orderBy("seq").collect()] == [10.0, 10.0]


def test_cancels_are_located_in_the_book(spark):
    rows = [(1, 1, 1, "insert", 1, "B", 10, 20), (1, 1, 2, "insert", 2, "B", 11, 20), (1, 1, 3, "insert", 3, "B", 10, 5),
            (1, 1, 4, "cancel", 3, "B", 10, 5), (1, 1, 5, "cancel", 99, "B", 10, 5)]
    events = spark.createDataFrame(rows, "SecuCode long, TradingDay long, seq long, kind string, order_id long, side string, price long, qty long")
    cancels = spark.createDataFrame([(1, 1, 4, 3), (1, 1, 5, 99), (2, 1, 1, 1)], "SecuCode long, TradingDay long, DealID long, OrderID long")
    got = {(r.SecuCode, r.DealID): (r.CancelPrice, r.OBLevel, r.QueuePos) for r in K.locate_cancels(cancels, events).collect()}
    assert got == {(1, 4): (10, 2, 2), (1, 5): (0, -1, -1), (2, 1): (0, -1, -1)}


def test_snapshot_verification(spark):
    """Volumes may differ by 20 shares; prices, counts and totals may not; the traded volume must come in time."""
    level = lambda p, v, o: (float(p), v, o)
    names = ["SecuCode", "TradingDay", "snap_no", "TickTime", "TotalVolume", "TotalTurnover", "TotalBidVolume",
             "TotalAskVolume", "WeightBidPrice", "WeightAskPrice", "bids", "asks"]
    asks = [level(11, 20, 1)]
    deep = [level(5 - i, 0, 0) for i in range(3)]  # five levels, so the snapshot is not a thin one

    def snap(no, bids, clock=100_000_000, turnover=200, total=100, volume=20):
        return (1, 1, no, clock, volume, turnover, total, 20, 98.0, 110.0, bids + deep, asks)

    good = [level(10, 80, 1), level(9, 35, 1)]
    rows = [
        snap(1, good), snap(2, [level(10, 80, 2), level(9, 20, 1)]), snap(3, [level(10, 80, 1), level(9, 41, 1)]),
        snap(4, good, turnover=201), snap(5, good, total=99), snap(6, good, clock=92_400_000, total=99),
        snap(7, good, clock=99_990_000), snap(8, good, clock=99_999_000), snap(9, good, volume=21)]
    level_type = "array<struct<price:double,volume:long,orders:long>>"
    kinds = {"WeightBidPrice": "double", "WeightAskPrice": "double", "bids": level_type, "asks": level_type}
    snaps = spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))
    late = book(spark).withColumn("clock", F.lit(100_000_000) + F.col("seq") - 5)  # the trade that reaches 20 shares is at 100000000
    ok = {r.snap_no: (r.ok, r.at_seq) for r in K.verify_snapshots(late.withColumn("clock", F.when(F.col("seq") < 5, F.col("clock")).otherwise(F.col("clock"))), snaps, n_levels=2).collect()}
    # 6 is in the opening auction by its clock, and its limit passed long before the trade; 7 gave up two seconds after its tick
    assert {k: v[0] for k, v in ok.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True, 9: False}
    assert ok[1] == (True, 8) == ok[8]
    early = book(spark).withColumn("clock", F.lit(92_400_000) + F.col("seq"))
    ok = {r.snap_no: r.ok for r in K.verify_snapshots(early, snaps.where("snap_no = 6"), n_levels=2).collect()}
    assert ok == {6: True}


def test_deal_numbers_above_ten_digits_keep_their_order(spark):
    deals = [(1, 1, 93000000, 25_000_000_000, 100), (1, 1, 93000000, 3, 90), (1, 1, 93000001, 1, 110)]
    df = spark.createDataFrame(deals, "SecuCode int, TradingDay int, DealTime int, DealID long, Price int")
    r = df.agg(F.min_by("Price", O.deal_key()).alias("a"), F.max_by("Price", O.deal_key()).alias("z")).first()
    assert (r["a"], r["z"]) == (90, 110)


def test_turnover_is_at_the_trade_price(spark):
    events = [(1, 1, 1, "insert", 1, "B", 11, 50), (1, 1, 2, "insert", 2, "S", 10, 20), (1, 1, 3, "trade", 1, "B", 10, 20), (1, 1, 3, "trade", 2, "S", 10, 20)]
    df = spark.createDataFrame(events, "SecuCode int, TradingDay int, seq long, kind string, order_id long, side string, price long, qty long")
    last = K.book_totals(df).orderBy("seq", "order_id").collect()[-1]
    assert (last["matched"], last["matched_value"]) == (20, 200)


def test_raw_tables_become_book_events(spark):
    orders = spark.createDataFrame([
        (1, 7, 1, 101, 93000000, 0, 10, 0, 50), (1, 7, 2, 102, 93001000, 1, 0, 11, 20), (1, 7, 3, 103, 93002000, 13, 0, 0, 5),
        (1, 7, 1, 106, 93005000, -1, 0, 0, 30), (1, 7, 9, 107, 93006000, 99, 1, 1, 1),
        (2, 7, 4, 0, 93000000, 12, 8, 0, 6), (2, 7, 4, 0, 93009000, -11, 8, 0, 6)],
        "SecuCode long, TradingDay long, OrderID long, BizIndex long, OrderTime long, OrderType long, Price long, LastPrice long, Volume long")
    deals = spark.createDataFrame([
        (1, 7, 104, 93003000, 1, 3, 10, 5, 1), (1, 7, 105, 93004000, 1, 0, 10, 5, -1), (2, 7, 200, 93008000, 0, 4, 0, 6, -11)],
        "SecuCode long, TradingDay long, DealID long, DealTime long, BuyID long, SellID long, Price long, Volume long, Side long")
    got = events_of(spark, orders, deals)
    assert got == [
        (1, "insert", 1, "B", 10, 50, 101), (1, "insert", 2, "B", 11, 20, 102), (1, "insert", 3, "S", None, 5, 103),
        (1, "trade", 1, "B", 10, 5, 104), (1, "trade", 3, "S", 10, 5, 104), (1, "cancel", 1, "B", 0, 30, 106),
        (2, "insert", 4, "S", 8, 6, 0), (2, "cancel", 4, "S", 0, 6, 200)]


def events_of(spark, orders, deals):
    from tidemark.operators.book import events_from

    rows = events_from(orders, deals).orderBy("SecuCode", "seq", "order_id").collect()
    return [(r.SecuCode, r.kind, r.order_id, r.side, r.price, r.qty, r.source_id) for r in rows]
