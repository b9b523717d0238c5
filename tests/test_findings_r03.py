"""Cases of the third review."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import open_series
from tidemark.operators import indicators as I


def price_bars(spark, n):
    """Rising bars, one of which has a low of 0."""
    rows = [("a", t, 10.0 + t, 0.0 if t == 5 else 9.0 + t, 9.5 + t) for t in range(n)]
    return open_series(spark.createDataFrame(rows, "k string, t bigint, high double, low double, close double"), ["k"], ["t"], "t div 100", 60)


def test_contraction_with_a_price_of_zero(spark):
    rows = {r.t: r for r in I.vcp(price_bars(spark, 20), 3, 0.9).close().collect()}
    assert len(rows) == 20 and math.isinf(rows[5].vcp) and math.isinf(rows[7].vcp_range)
    assert rows[8].vcp_range == pytest.approx((1 / 15 + 1 / 16 + 1 / 17) / 3)


def test_price_range_with_a_price_of_zero(spark):
    rows = {r.t: r for r in I.range_contraction(price_bars(spark, 20), 3, 4).close().collect()}
    assert len(rows) == 20 and math.isinf(rows[7].price_range)
    assert rows[8].price_range == pytest.approx((18 - 15) / 15) and rows[8].contracted and not rows[15].contracted


def test_a_key_has_one_timer_and_few_state_calls():
    """A thousand rows of as many minutes wait in one chunk, go off with one timer, in order, and leave nothing behind."""
    import pandas as pd
    from pyspark.sql.types import LongType, StructType

    from tidemark.streaming import ordered as O

    class Held(dict):
        def get(self):
            return dict.get(self, 0)

        def update(self, value):
            self[0] = value

        def getValue(self, key):
            calls.append(key)
            return self[key]

        def updateValue(self, key, value):
            calls.append(key)
            self[key] = value

        containsKey, removeKey = dict.__contains__, dict.__delitem__

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getMapState(self, name, *_):
            return self.states.setdefault(name, Held())

        def getValueState(self, name, *_):
            return self.states.setdefault(name, Held())

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    calls, handle = [], Handle()
    schema = StructType().add("at_ms", LongType()).add("seq", LongType())
    job = O.Ordered(schema, ["k"], ["at_ms", "seq"], lambda key, rows, before: (rows.copy(), "x"))
    job.init(handle)
    rows = pd.DataFrame({"at_ms": [60_000 * ((i * 7) % 1000 + 1) for i in range(1000)], "seq": range(1000)})
    list(job.handleInputRows(("a",), iter([rows]), At(0)))
    assert handle.timers == [60_000] and len(calls) == 1
    first = pd.concat(job.handleExpiredTimer(("a",), At(30_000_000), At(60_000)))
    assert first["at_ms"].tolist() == [60_000 * i for i in range(1, 501)] and handle.timers == [60_000, 30_060_000]
    rest = pd.concat(job.handleExpiredTimer(("a",), At(90_000_000), At(30_060_000)))
    assert rest["at_ms"].tolist() == [60_000 * i for i in range(501, 1001)] and len(calls) == 4 and not handle.states["waiting"]


def test_many_small_files_share_a_task(spark, tmp_path):
    """Six hundred files are three tasks, and every record of each comes once, with its number; a bound leaves the other files out."""
    import numpy as np

    from tidemark.sources import fixed_width as X

    for i in range(600):
        data = np.zeros(3, X.DAILY)
        data["date"], data["close"] = 20200101 + np.arange(3) + i % 2 * 100, i
        (tmp_path / f"sh6{i:05d}.day").write_bytes(data.tobytes())
    rows = X.read_records(spark, str(tmp_path), "daily", "*.day")
    assert rows.rdd.getNumPartitions() == 3
    got = sorted((r.close, r.record, r.path[-9:-4]) for r in rows.collect())
    assert got == [(i, k, f"{i:05d}") for i in range(600) for k in range(3)]
    assert rows.where("date >= 20200201").count() == 900


def test_blocks_of_intervals_are_never_broadcast(spark):
    """Blocks exploded from a small table look small to the planner and are not."""
    from tidemark.functions.dyadic import stab

    spans = spark.createDataFrame([(1, 0, 900, 5), (1, 100, 200, 7)], "k long, start long, end long, price long")
    points = spark.createDataFrame([(1, 50), (1, 150), (1, 950)], "k long, at long")
    found = stab(spans, points, ["k"], "at", 4, best=spans["price"])
    assert sorted((r.at, r.best) for r in found.collect()) == [(50, 5), (150, 7), (950, None)]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()


def test_a_symbol_has_one_csv_file(spark):
    from tidemark.plans.catalog import QUERIES
    from tidemark.plans import all_queries

    all_queries()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = QUERIES["src05_daily_csv"](spark, "/root/testdata/sf0.001")
        files = rows.inputFiles()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files and len(files) == len({f.rsplit("/", 2)[1] for f in files})


def test_ratchet_stops_of_many_sets_in_one_pass(spark):
    """Sets that share the bars give what each gives alone; a null key has its own bars, over several blocks too."""
    from tidemark.operators import machines as M

    rows = [(k, t, 100.0 + (t * 7 + i * 3) % 11 - t % 17, 1.0 + t % 3) for i, k in enumerate((None, 1, 1 << 60)) for t in range(60)]
    bars = spark.createDataFrame(rows, "k bigint, t bigint, close double, atr double")
    enters = {0: F.col("t") % 9 == 4, 1: F.col("t") % 13 == 2, 2: F.lit(False)}
    sets = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enters.items()]))
    for block in (7, 1000):
        got = M.ratchet_stops(bars.withColumn("entry", sets), ["k"], "t", "t div 50", 0.5, block, points="set").collect()
        want = [(r.k, i, r.t, r.stop, r.exit) for i, c in enters.items()
                for r in M.ratchet_stops(bars.withColumn("entry", c), ["k"], "t", "t div 50", 0.5, 1000).collect()]
        assert want and sorted(map(repr, want)) == sorted(repr((r.k, r["set"], r.t, r.stop, r.exit)) for r in got)


def test_relay_calls_spark_once_for_many_keys(spark):
    """Short keys are read in one stream: the plan has no cogroup, which cost several milliseconds a key."""
    from tidemark.functions import relay as R

    plans, stage = [], R.stage
    R.stage = lambda df: plans.append(df._jdf.queryExecution().toString()) or stage(df)
    try:
        rows = spark.createDataFrame([(k, 1, k) for k in range(50)], "k bigint, _pos bigint, x bigint")
        got = R.relay(rows, ["k"], lambda pdf, state: ([(int(pdf["x"].iloc[0]),)], None), "y bigint").collect()
    finally:
        R.stage = stage
    assert sorted((r.k, r.y) for r in got) == [(k, k) for k in range(50)]
    assert not any("CoGroup" in p for p in plans)


def test_grid_exits_equal_a_scan_and_take_one_row_a_bar(spark):
    """Peaks, segments and exits of all sets over several buckets; the rows that are written do not grow with the sets."""
    from tidemark.operators import screens as S

    rows = [(k, t, 100.0 + (t * 7) % 13 + n, None if t == 31 else 99.0 + (t * 5) % 17, None if t < 3 else 1.0, t % 11 == 4, t % 29 == 20)
            for n, k in enumerate((None, "a")) for t in range(70)]
    bars = spark.createDataFrame(rows, "k string, t bigint, high double, close double, atr double, _hit0 boolean, _hit1 boolean")
    grid = [S.Params(2, 1, 1, k_atr, 3, 5, 8) for k_atr in (3.0, 9.0)]
    want = set()
    for k in (None, "a"):
        for i, p in enumerate(grid):
            seg, peak, done = 0, None, False
            for r in (r for r in rows if r[0] == k):
                if r[5 + i]:
                    seg, peak, done = seg + 1, None, False
                peak = r[2] if peak is None else max(peak, r[2])
                out = bool(seg and not done and r[3] is not None and r[4] is not None and r[3] < peak - p.k_atr * r[4])
                done = done or out
                want.add((k, r[1], i, seg, peak, out))
    written, stage = [], S.stage
    S.stage = lambda df: written.append(stage(df)) or written[-1]
    try:
        got = S.grid_exits(bars, grid, ["k"], "t", "t div 9").collect()
        few = S.grid_exits(bars, grid, ["k"], "t", "t div 9", events=True).collect()
    finally:
        S.stage = stage
    assert len(got) == len(want) and {(r.k, r.t, r.param_id, r.seg, r.peak, r.exit) for r in got} == want
    assert any(w[-1] for w in want)
    assert sorted(map(repr, few)) == sorted(repr(r) for r in got if r.entry or r.exit)
    assert {df.count() for df in written} == {len(rows)}


def test_only_entries_and_exits_reach_the_pairing(spark):
    from tidemark.operators import screens as S

    rows = [("a", t, float(t), t in (3, 5, 40), t in (9, 60)) for t in range(100)]
    df = spark.createDataFrame(rows, "k string, t bigint, close double, entry boolean, exit boolean")
    written, stage = [], S.stage
    S.stage = lambda d: written.append(stage(d)) or written[-1]
    try:
        got = sorted((r.entry_t, r.exit_t) for r in S.pair_trades(df, ["k"], "t", "t div 10").collect())
    finally:
        S.stage = stage
    assert got == [(3, 9), (40, 60)] and written[0].count() == 5


def flow_deals(spark, n):
    """Trades and cancels of one busy and some quiet stock-days."""
    cell = "cast({} as bigint)".format
    return spark.range(n).selectExpr(
        "cast(if(id % 3 = 0, 1, id % 7) as bigint) as SecuCode", cell("id % 2") + " as TradingDay", "id as DealID",
        cell("93000000 + id % 50 * 100000 + id % 1000") + " as DealTime", "id % 11 as BuyID", "id % 13 as SellID",
        "id % 5 as Price", "id % 17 + 1 as Volume", "cast(array(0, 1, -1, -11)[id % 4] as bigint) as Side")


def exchanges(df):
    """Nodes of the planned query below each of its shuffles, up to the shuffle before."""
    found, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = line.lstrip(" +-:*(0123456789)")
        if name.startswith("Exchange"):
            below = []
            found.append(below)
        elif below is not None:
            below.append(name.split("(")[0].split(" ")[0])
    return found


def test_order_and_minute_sums_hold_no_rows_before_their_shuffle(spark):
    """F18, F27, F30 to F33: trades are shuffled once by order, and once more by minute, with no hash table in the task that reads them."""
    from tidemark.operators import flow as O

    deals = flow_deals(spark, 2000)
    for df, shuffles in ((O.sweeps(deals), 1), (O.order_volumes(deals), 1), (O.minute_orders(deals), 1), (O.minute_flow(deals), 2),
                         (O.minute_cancels(deals), 1), (O.minute_features(deals, how="full_outer"), 3)):
        found = exchanges(df)
        assert len(found) == shuffles and "HashAggregate" not in found[-1]
        n = spark.conf.get("spark.sql.shuffle.partitions")
        assert df._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") == shuffles


def test_order_and_minute_sums(spark):
    """The same sums, added up row by row in Python."""
    from collections import defaultdict

    from tidemark.operators import flow as O

    deals = flow_deals(spark, 2000)
    orders, days = defaultdict(list), defaultdict(int)
    for r in deals.collect():
        if r.Side in (0, 1):
            orders[r.SecuCode, r.TradingDay, "buy", r.BuyID].append(r)
            orders[r.SecuCode, r.TradingDay, "sell", r.SellID].append(r)
        else:
            days["cancelbuy_vol_Small" if r.Side == -1 else "cancelsell_vol_Small", r.SecuCode, r.TradingDay, r.DealTime // 100_000] += r.Volume
    for key, rows in orders.items():
        active = min(r.Side for r in rows) == 0 if key[2] == "buy" else max(r.Side for r in rows) == 1
        for r in rows:
            days[f"deal_{'act' if active else 'pas'}_{key[2]}_vol_Small", r.SecuCode, r.TradingDay, r.DealTime // 100_000] += r.Volume
    got = {(r.SecuCode, r.TradingDay, r.order_side, r.OrderID): (r.volume, r.fills, r.depth, r.price_first) for r in O.order_executions(deals).collect()}
    assert got == {k: (sum(r.Volume for r in v), len(v), len({r.Price for r in v}), min(v, key=lambda r: (r.DealTime, r.DealID)).Price) for k, v in orders.items()}
    cuts = spark.createDataFrame([(c, b, 1e9, 2e9, 3e9) for c in range(7) for b in ("bid", "ask")], "SecuCode bigint, book string, p70 double, p95 double, p995 double")
    wide = O.minute_features(deals, cuts, "full_outer").collect()
    assert {(c, r.SecuCode, r.TradingDay, r.minute): r[c] for r in wide for c in r.asDict() if c.endswith(("Small", "Mega")) and r[c]} == dict(days)


def test_effective_events_are_dealt_out_once(spark):
    """one shuffle by order and no table in between; odd orders change what they did before."""
    from tidemark.operators import book as B

    rows = [
        (1, "trade", 7, "B", 10, 5),  # before its insert
        (2, "insert", 7, "B", 10, 8), (3, "insert", 7, "S", 11, 99),  # a repeated insert
        (4, "trade", 7, "B", 9, 5), (5, "cancel", 7, "B", 10, 9), (6, "cancel", 7, "B", 10, 1),  # more than is left, and nothing left
        (7, "cancel", 8, "S", 12, 3),  # unknown
        (8, "insert", None, "S", 12, 3), (9, "cancel", None, "S", 12, 3)]  # no order
    events = spark.createDataFrame([(1, 1, *r) for r in rows], "SecuCode int, TradingDay int, seq bigint, kind string, order_id bigint, side string, price bigint, qty bigint")
    out = B.effective_events(events)
    assert len(exchanges(out)) == 1 and "tidemark-work" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.seq: (r.side, r.price, r.opens, r.delta, r.live, r.closes) for r in out.collect()}
    assert got == {
        1: ("B", None, False, 0, 0, False), 2: ("B", 10, True, 8, 8, False), 3: ("B", 10, False, 0, 8, False),
        4: ("B", 10, False, -5, 3, False), 5: ("B", 10, False, -3, 0, True), 6: ("B", 10, False, 0, 0, False),
        7: ("S", None, False, 0, 0, False), 8: ("S", None, False, 0, 0, False), 9: ("S", None, False, 0, 0, False)}


def test_profiles_are_pooled_where_they_are_needed(spark):
    """the days of a target are shuffled once, by target, for the pooled prices and their windows."""
    from tidemark.operators import profile as P

    profile = spark.createDataFrame([(1, d, p, d + p) for d in range(6) for p in range(4)], "SecuCode int, TradingDay int, Price bigint, Volume bigint")
    pairs = spark.createDataFrame([(1, t, d) for t in range(6) for d in range(max(0, t - 2), t + 1)], "SecuCode int, target int, TradingDay int")
    plan = P.value_areas(P.pooled_profiles(profile, pairs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Price#" not in "".join(part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])
    got = {(r.target, r.Price): (r.Volume, r.today) for r in P.pooled_profiles(profile, pairs).collect()}
    assert got == {(t, p): (sum(d + p for d in range(max(0, t - 2), t + 1)), t + p) for t in range(6) for p in range(4)}
