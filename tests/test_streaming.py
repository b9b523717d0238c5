"""Streams must give what the batch jobs give for the rows behind the watermark."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import POS
from tidemark.operators import book as B
from tidemark.operators import machines as M
from tidemark.streaming import jobs as J
from tidemark.streaming import ordered as O

SECOND = 1000


def as_stream(spark, df, tmp_path, files=3):
    """Written in time order over several files, read one file per micro-batch."""
    path = str(tmp_path / "in")
    rows = df.orderBy("ts").toPandas()
    step = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows.iloc[i * step : (i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_timeline_orders_late_rows(spark, tmp_path):
    rows = [("a", t, t * 10, kind) for kind, t in enumerate([5, 1, 3, 2, 4, 60])]
    df = spark.createDataFrame(rows, "k string, sec long, seq long, prio long").select(
        "k", F.timestamp_seconds("sec").alias("ts"), (F.col("sec") * 1000).alias("at_ms"), "seq", "prio",
        F.lit("order").alias("kind"))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = J.materialised(O.timeline(stream, ["k"], "10 seconds"), "append").orderBy("event_no").collect()
    assert [(r.at_ms // 1000, r.event_no) for r in out] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_three_feeds_with_watermarks_of_their_own(spark, tmp_path):
    """A row is late only where its own feed's delay and all other feeds have passed it; the slowest feed rules."""
    def feed(name, batches):
        path = str(tmp_path / name)
        for k, seconds in enumerate(batches):
            rows = spark.createDataFrame([("a", s, s * 10 + k) for s in seconds], "k string, sec long, seq long")
            rows.select("k", F.timestamp_seconds("sec").alias("ts"), (F.col("sec") * SECOND).alias("at_ms"), "seq").coalesce(1).write.mode("append").parquet(path)
        schema = "k string, ts timestamp, at_ms long, seq long"
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    orders = feed("orders", [[10, 20], [50, 15], [100]])  # 15 comes when orders are at 50, but deals still at 30
    deals = feed("deals", [[12, 30], [40, 11], [90]])     # 11 is behind its own delay, but the snapshots hold everything back
    snaps = feed("snaps", [[5], [12], [60]])
    feeds = {"order": (orders, "5 seconds"), "deal": (deals, "5 seconds"), "snapshot": (snaps, "1 second")}
    out = J.materialised(O.feeds_timeline(feeds, ["k"], 20 * SECOND), "append").orderBy("event_no").collect()
    want = sorted([(10, 0), (20, 0), (15, 0), (50, 0), (12, 1), (30, 1), (40, 1), (11, 1), (5, 2), (12, 2)])
    assert [(r.at_ms // SECOND, r.prio) for r in out] == want
    assert [r.event_no for r in out] == list(range(1, len(want) + 1))


BOOK = ("SecuCode long, TradingDay long, seq long, kind string, order_id long, side string, price long, qty long, "
        "bids array<struct<price:double,volume:long,orders:long>>, asks array<struct<price:double,volume:long,orders:long>>")


@pytest.mark.parametrize("step_ms", [1, 40_000, 10**9])
def test_book_matches_the_batch_book(spark, tmp_path, step_ms):
    """Levels are checked among the events; a repeated insert, an unknown order and an own-best order change what they do in the batch book."""
    import random

    rng, rows = random.Random(3), []
    for seq in range(1, 160):
        oid = rng.randint(1, 60)
        kind = rng.choice(["insert", "insert", "trade", "cancel"])
        rows.append((seq, kind, oid, "B" if oid % 3 else "S", None if kind == "insert" and seq % 9 == 0 else rng.randint(1, 300) * 7, rng.randint(1, 9), None, None))
    df = spark.createDataFrame([(1, 1, *r) for r in rows], BOOK)
    want = {r.seq: (r.best_bid, r.best_ask) for r in B.best_prices(df).collect()}
    at = B.positioned(df)
    depth = {r["_pos"]: (r.bids, r.asks) for r in B.depth_at(at, at.where("_pos % 10 = 0"), 10).collect()}
    checks, ok = [], {}
    for seq, (bids, asks) in depth.items():
        bids = [tuple(x) for x in bids]
        if seq % 20 == 0 and bids:
            bids[-1] = (bids[-1][0], bids[-1][1] + (20 if seq % 40 == 0 else 21), bids[-1][2])
        ok[seq] = seq % 20 != 0 or not bids or seq % 40 == 0
        checks.append((1, 1, seq, "check", 10**9, "B", 0, 0, bids, [tuple(x) for x in asks]))
    both = df.union(spark.createDataFrame(checks, BOOK)).union(spark.createDataFrame([(1, 1, 500, "insert", 9, "B", 1, 1, None, None)], BOOK))
    timed = both.select("SecuCode", "TradingDay", F.timestamp_seconds("seq").alias("ts"), (F.col("seq") * SECOND).alias("at_ms"),
                        "seq", "kind", "order_id", "side", "price", "qty", "bids", "asks").orderBy("seq")
    path = str(tmp_path / "in")
    for low, high in ((0, 60), (60, 110), (110, 1000)):
        timed.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = J.materialised(O.live_book(stream, ["SecuCode", "TradingDay"], step_ms=step_ms), "append").collect()
    assert {r.seq: (r.best_bid, r.best_ask) for r in got if r.kind != "check"} == want
    assert {r.seq: r.ok for r in got if r.kind == "check"} == ok


def test_ladder_of_prices():
    import random

    class Held(dict):
        def containsKey(self, key):
            return key in self

        getValue, updateValue = dict.__getitem__, dict.__setitem__
        removeKey = dict.__delitem__

    rng, masks = random.Random(1), O._Cached(Held())
    for side in "BS":
        ladder, prices = O.Ladder(masks, side), set()
        for _ in range(2000):
            price = rng.choice([rng.randint(0, 40), rng.randint(0, 16**10 - 1)])
            if price in prices:
                prices.remove(price)
                ladder.remove(price)
            else:
                prices.add(price)
                ladder.add(price)
            if rng.random() < 0.1:
                masks.flush()
                assert ladder.best(5) == sorted(prices, reverse=side == "B")[:5]
        for price in prices:
            ladder.remove(price)
    masks.flush()
    assert not masks.state


@pytest.fixture(scope="module")
def walk(spark):
    rng = __import__("random").Random(11)
    rows, price = [], 100.0
    for t in range(260):
        price *= 1 + rng.choice([-0.02, -0.01, 0.0, 0.01, 0.02, 0.15 if t % 60 == 59 else 0.0])
        rows.append(("a", t, price * 1.01, price * 0.99, price))
    return spark.createDataFrame(rows, "symbol string, t long, high double, low double, close double").cache()


BOX = dict(mid_rows=5, band=0.2, init=5, period=8)


def brute_boxes(rows):
    from tidemark.operators.machines import Box, advance_box
    box, out, closes = Box(), [], []
    for r in rows:
        closes.append(r.close)
        if len(closes) < BOX["mid_rows"]:
            continue
        mid = sum(closes[-BOX["mid_rows"]:]) / BOX["mid_rows"]
        box, done = advance_box(box, r.t, r.high, r.low, r.close, mid, BOX["band"], BOX["init"], BOX["period"])
        if done:
            out.append((done.start, r.t, done.days))
    return out


@pytest.mark.parametrize("block", [25, 100_000])
def test_boxes_in_blocks(walk, block):
    got = M.boxes(walk, ["symbol"], "t", "t div 50", block=block, **BOX).orderBy("break_t").collect()
    want = brute_boxes(walk.orderBy("t").collect())
    assert want and [(r.start_t, r.break_t, r.days) for r in got] == want


def test_live_boxes_match_the_batch(spark, walk, tmp_path):
    day = (F.col("t") + 1) * 86400  # the first instant of the epoch is never ahead of a watermark
    bars = walk.select("symbol", F.timestamp_seconds(day).alias("ts"), (day * SECOND).alias("at_ms"),
                       F.col("t").alias("bt"), "high", "low", "close")
    out = J.materialised(O.live_boxes(as_stream(spark, bars, tmp_path), ["symbol"], delay="1 second", **BOX), "append")
    got = [(r.start_t, r.break_t, r.days) for r in out.orderBy("break_t").collect()]
    want = [w for w in brute_boxes(walk.orderBy("t").collect()) if w[1] < 259]
    assert got == want


@pytest.mark.parametrize("block", [7, 100_000])
def test_growth_segments(walk, block):
    closes = [r.close for r in walk.orderBy("t").collect()]
    want, i = [], 0
    while i < len(closes):
        ahead = closes[i : i + 30]
        peak = ahead.index(max(ahead)) + i
        gain = (closes[peak] - closes[i]) / closes[i]
        if gain >= 0.1:
            want.append((i, peak))
            i = peak + 1
        else:
            i += 1
    got = M.growth_segments(walk, ["symbol"], "t", "t div 50", 0.1, 30, block).orderBy("start_t").collect()
    assert want and [(r.start_t, r.peak_t) for r in got] == want


def test_growth_segments_of_a_null_key(spark):
    rows = [(None, t, 10.0 + 5 * (t % 3)) for t in range(9)] + [("b", t, 1.0) for t in range(5)]
    df = spark.createDataFrame(rows, "symbol string, t int, close double")
    got = M.growth_segments(df, ["symbol"], "t", "t div 2", 0.5, 3).collect()
    assert sorted((r.symbol, r.start_t, r.peak_t) for r in got) == [(None, 0, 2), (None, 3, 5), (None, 6, 8)]


@pytest.mark.parametrize("block", [9, 100_000])
def test_ratchet_stops(walk, block):
    signals = walk.select("symbol", "t", (F.col("t") % 20 == 3).alias("entry"), "close", F.lit(1.5).alias("atr"))
    stop, want = None, []
    for r in signals.orderBy("t").collect():
        if stop is None:
            if r.entry:
                stop = r.close - 4.5
                want.append((r.t, False))
        elif r.close < stop:
            want.append((r.t, True))
            stop = None
        else:
            stop = max(stop, r.close - 4.5)
            want.append((r.t, False))
    got = M.ratchet_stops(signals, ["symbol"], "t", "t div 50", 3.0, block).orderBy("t").collect()
    assert [(r.t, r.exit) for r in got] == want


def test_final_bars_equal_batch_bars(spark, tmp_path):
    rows = [("a", i * 17_000_000 + 1, i, i % 7 + 1, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, us long, seq long, price long, volume long").withColumn(
        "ts", F.timestamp_micros("us"))
    live = J.materialised(J.bars(as_stream(spark, df, tmp_path), "symbol", "1 minute", "0 seconds"), "append")
    from tidemark.operators.bars import tick_bars
    batch = tick_bars(df, ["symbol"], "us", "seq", 60)
    got = {F_: v for F_, *v in [(int(r.label.timestamp()), r.open, r.high, r.low, r.close, r.volume) for r in live.collect()]}
    want = {r.ts: [r.open, r.high, r.low, r.close, r.volume] for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_checks_in_time_late_and_without_a_further_row(spark, tmp_path):
    rows = [
        ("a", 1, "trade", 0, 1, 5), ("a", 1, "check", 1, 2, 5), ("a", 2, "check", 1, 3, 8), ("a", 4, "trade", 0, 4, 3),
        ("a", 5, "check", 1, 5, 9), ("a", 8, "trade", 0, 6, 1), ("a", 10, "check", 1, 7, 9), ("a", 10, "check", 1, 8, 9),
        ("a", 11, "check", 1, 9, 100), ("b", 500, "trade", 0, 10, 1), ("b", 900, "trade", 0, 11, 1)]
    df = spark.createDataFrame(rows, "k string, sec long, kind string, prio long, seq long, volume long").select(
        "k", F.timestamp_seconds("sec").alias("ts"), (F.col("sec") * SECOND).alias("at_ms"), "kind", "prio", "seq", "volume")
    out = J.materialised(O.timed_checks(as_stream(spark, df, tmp_path), ["k"]), "append").collect()
    assert sorted((r.seq, r.ok, r.matched_ms) for r in out) == [
        (2, True, 1000), (3, True, 4000), (5, False, None), (7, True, 10000), (8, True, 10000), (9, False, None)]


def test_rows_that_wait_at_the_close_get_the_default_time(spark, tmp_path):
    rows = [("a", 0, 10, 1, 0), ("a", 0, 20, 2, -1), ("a", 0, 30, 3, 1), ("a", 0, 40, 4, -11), ("a", 1, 110, 5, 0), ("a", 9, 910, 6, 0)]
    df = spark.createDataFrame(rows, "k string, day long, sec long, seq long, side long").select(
        "k", "day", F.timestamp_seconds("sec").alias("ts"), (F.col("sec") * SECOND).alias("at_ms"),
        (F.col("sec") * 1_000_000).alias("clock"), "seq", "side")
    live = O.next_trade(as_stream(spark, df, tmp_path), ["k", "day"], "10 seconds", lambda key: (int(key[1]) + 1) * 100 * SECOND)
    out = J.materialised(live, "append").collect()
    assert sorted((r.day, r.seq, r.next_time) for r in out) == [
        (0, 1, 30_000_000), (0, 2, 30_000_000), (0, 3, 153_000_000), (0, 4, 153_000_000), (1, 5, 153_000_000)]
