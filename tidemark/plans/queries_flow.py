"""Event-log, order-flow and volume-profile queries."""

from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.operators import events as E
from tidemark.operators import flow as O
from tidemark.operators import profile as P
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.session import stage

V.VIEW_SQL["deal_log"] = """
SELECT SecuCode, TradingDay, BizIndex - 40 + OrderID % 97 AS DealID, OrderTime + OrderID % 7 * 1000 AS DealTime,
  CASE WHEN OrderType IN (0, -1) THEN OrderID ELSE 0 END AS BuyID,
  CASE WHEN OrderType IN (10, -11) THEN OrderID ELSE 0 END AS SellID, Price, Volume,
  CASE WHEN OrderType IN (-1, -11) THEN OrderType ELSE OrderID % 2 END AS Side
FROM orders_log"""
V.VIEW_SQL["lossy_log"] = "SELECT * FROM deal_log WHERE Side >= 0 OR Volume < 15"


def deal_log(spark, d):
    kind, key = F.col("OrderType"), F.col("OrderID")
    return V.orders_log(spark, d).select(
        "SecuCode", "TradingDay", (F.col("BizIndex") - 40 + key % 97).alias("DealID"),
        (F.col("OrderTime") + key % 7 * 1000).alias("DealTime"),
        F.when(kind.isin(0, -1), key).otherwise(0).alias("BuyID"),
        F.when(kind.isin(10, -11), key).otherwise(0).alias("SellID"), "Price", "Volume",
        F.when(kind < 0, kind.cast("bigint")).otherwise(key % 2).alias("Side"),
    )


@query("ag01_value_counts", "SELECT Side, count(*) AS n FROM deals GROUP BY 1")
def _(spark, d):
    return E.value_counts(V.deals(spark, d), "Side").orderBy("Side")


@query("jn01_event_timeline", """
WITH u AS (SELECT SecuCode, TradingDay, OrderTime AS time, CASE WHEN BizIndex > 0 THEN BizIndex ELSE OrderID END AS seq,
    0 AS prio, 'order' AS kind FROM orders_log
  UNION ALL SELECT SecuCode, TradingDay, DealTime, DealID, 1, 'deal' FROM deal_log)
SELECT SecuCode, TradingDay, kind, time, seq,
  row_number() OVER (PARTITION BY SecuCode, TradingDay ORDER BY time, seq, prio) AS event_no FROM u""")
def _(spark, d):
    log = E.timeline(V.orders_log(spark, d), deal_log(spark, d))
    return log.select("SecuCode", "TradingDay", "kind", "time", "seq", "event_no")


@query("jn05_repair_sequence", """
WITH m AS (SELECT SecuCode, TradingDay, id, min(DealID) AS first_deal FROM (
  SELECT SecuCode, TradingDay, DealID, unnest([BuyID, SellID]) AS id FROM deal_log) WHERE id > 0 GROUP BY 1, 2, 3),
g AS (SELECT SecuCode, TradingDay, bool_or(BizIndex > 0 AND BizIndex <> OrderID) AS biz FROM orders_log GROUP BY 1, 2)
SELECT o.SecuCode, o.TradingDay, o.OrderID, CASE WHEN biz AND BizIndex > first_deal AND OrderType NOT IN (-1, -11)
  THEN first_deal ELSE BizIndex END AS BizIndex
FROM orders_log o JOIN g USING (SecuCode, TradingDay)
LEFT JOIN m ON m.SecuCode = o.SecuCode AND m.TradingDay = o.TradingDay AND m.id = o.OrderID""")
def _(spark, d):
    fixed = E.repair_sequence(V.orders_log(spark, d), deal_log(spark, d))
    return fixed.select("SecuCode", "TradingDay", "OrderID", "BizIndex")


@query("jn06_fill_cancels", """
WITH w AS (SELECT SecuCode, TradingDay, OrderType AS Side, count(*) AS want FROM orders_log WHERE OrderType < 0 GROUP BY 1, 2, 3),
h AS (SELECT SecuCode, TradingDay, Side, count(*) AS have FROM lossy_log WHERE Side < 0 GROUP BY 1, 2, 3),
s AS (SELECT SecuCode, TradingDay, Side FROM w LEFT JOIN h USING (SecuCode, TradingDay, Side) WHERE want > coalesce(have, 0))
SELECT SecuCode, TradingDay, DealID, DealTime, BuyID, SellID, Price, Volume, Side FROM lossy_log
UNION ALL
SELECT o.SecuCode, o.TradingDay, o.BizIndex, o.OrderTime, CASE WHEN OrderType = -1 THEN OrderID ELSE 0 END,
  CASE WHEN OrderType = -11 THEN OrderID ELSE 0 END, Price, Volume, OrderType
FROM orders_log o JOIN s ON s.SecuCode = o.SecuCode AND s.TradingDay = o.TradingDay AND s.Side = o.OrderType
WHERE NOT EXISTS (SELECT 1 FROM lossy_log x WHERE x.SecuCode = o.SecuCode AND x.TradingDay = o.TradingDay
  AND x.Side = o.OrderType AND x.DealID = o.BizIndex)""")
def _(spark, d):
    lossy = deal_log(spark, d).where("Side >= 0 or Volume < 15")  # the feed lost the large cancels
    return E.fill_cancels(V.orders_log(spark, d), lossy)


@query("jn07_order_to_ticks", """
SELECT DealID, Price, Volume, BuyID, sum(Volume) OVER p::BIGINT AS order_volume, min(Side) OVER p = 0 AS active
FROM deals WHERE Side IN (0, 1) WINDOW p AS (PARTITION BY SecuCode, TradingDay, BuyID)""")
def _(spark, d):
    trades = V.deals(spark, d).where(C.is_trade(F.col("Side")))
    order = trades.groupBy("SecuCode", "TradingDay", "BuyID").agg(
        F.sum("Volume").alias("order_volume"), (F.min("Side") == 0).alias("active"))
    return trades.join(order, ["SecuCode", "TradingDay", "BuyID"]).select(
        "DealID", "Price", "Volume", "BuyID", "order_volume", "active")


@query("wn18_next_trade_time", """
SELECT event_id, coalesce(first_value(CASE WHEN side NOT IN (-1, -11) THEN ts_us END IGNORE NULLS) OVER (
  PARTITION BY symbol ORDER BY ts_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 153000000) AS next_time
FROM (SELECT seq AS event_id, symbol, ts_us, CASE user_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -11 ELSE user_id % 2 END AS side FROM ticks)""")
def _(spark, d):
    user = F.col("user_id")
    rows = V.ticks(spark, d).select(
        "symbol", F.col("seq").alias("DealID"), F.col("ts_us").alias("DealTime"),
        F.when(user % 5 == 0, -1).when(user % 5 == 1, -11).otherwise(user % 2).alias("Side"),
    )
    return E.next_trade_time(rows, ["symbol"], bucket="DealTime div 3600000000").select(F.col("DealID").alias("event_id"), "next_time")


@query("ag36_running_matched", """
SELECT SecuCode, TradingDay, DealID, DealTime, Price, Volume,
  sum(CASE WHEN Side IN (0, 1) THEN 1 ELSE 0 END) OVER w::BIGINT AS cum_count,
  sum(CASE WHEN Side IN (0, 1) THEN Volume ELSE 0 END) OVER w::BIGINT AS cum_volume,
  sum(CASE WHEN Side IN (0, 1) THEN Volume * Price ELSE 0 END) OVER w::BIGINT AS cum_turnover
FROM deals WINDOW w AS (PARTITION BY SecuCode, TradingDay ORDER BY DealTime, DealID, Price, Volume ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return E.running_matched(V.deals(spark, d)).select(
        "SecuCode", "TradingDay", "DealID", "DealTime", "Price", "Volume", "cum_count", "cum_volume", "cum_turnover")


@query("ag16_completeness", """
WITH u AS (SELECT 'order' AS kind, SecuCode, TradingDay, OrderTime AS t FROM orders_log
  UNION ALL SELECT 'deal', SecuCode, TradingDay, DealTime FROM deals),
d AS (SELECT kind, SecuCode, TradingDay, count(*) AS n, min(t) // 1000 AS h, max(t) // 1000 AS e FROM u GROUP BY 1, 2, 3),
x AS (SELECT *, printf('%02d:%02d:%02d', h // 10000, h // 100 % 100, h % 100) AS ht,
  printf('%02d:%02d:%02d', e // 10000, e // 100 % 100, e % 100) AS et FROM d)
SELECT kind, SecuCode, TradingDay, n, CASE WHEN n < 4 THEN '数据行数不足4行'
  WHEN h >= 92500 AND e <= 145900 THEN '缺失' || ht || '前及' || et || '后'
  WHEN h >= 92500 THEN '缺失' || ht || '前' ELSE '缺失' || et || '后' END AS gap
FROM x WHERE n < 4 OR h >= 92500 OR e <= 145900""")
def _(spark, d):
    return E.completeness({
        "order": (V.orders_log(spark, d), "OrderTime"),
        "deal": (V.deals(spark, d).withColumn("TradingDay", F.col("TradingDay").cast("bigint")), "DealTime"),
    })


V.VIEW_SQL["sides"] = """
SELECT *, 'buy' AS order_side, BuyID AS OrderID FROM deals WHERE Side IN (0, 1)
UNION ALL SELECT *, 'sell', SellID FROM deals WHERE Side IN (0, 1)"""
V.VIEW_SQL["executions"] = """
SELECT SecuCode, TradingDay, order_side, OrderID, min(DealTime) AS start_time, max(DealTime) AS end_time,
  min(Price) AS price_min, max(Price) AS price_max, arg_min(Price, (DealTime, DealID, Price)) AS price_first,
  arg_max(Price, (DealTime, DealID, Price)) AS price_last, sum(Volume)::BIGINT AS volume,
  sum(Price * Volume)::BIGINT AS turnover, count(DISTINCT Price) AS depth, count(*) AS fills,
  bool_or((DealTime >= 92500000 AND DealTime < 93000000) OR (DealTime >= 145700000 AND DealTime < 150000000)) AS in_auction
FROM sides GROUP BY 1, 2, 3, 4"""


@query("ag04_order_sweeps", "SELECT * FROM executions WHERE fills > 1")
def _(spark, d):
    return O.sweeps(V.deals(spark, d))


def _sweep_sql():
    cols = ["sum(volume) FILTER (order_side = 'buy') AS v", "sum(turnover) FILTER (order_side = 'buy') AS tt"]
    for s in ("buy", "sell"):
        on = f"order_side = '{s}' AND fills > 1"
        cols += [
            f"coalesce(sum(volume) FILTER ({on}), 0) AS {s}_v", f"coalesce(sum(turnover) FILTER ({on}), 0) AS {s}_t",
            f"count(*) FILTER ({on}) AS {s}_n", f"coalesce(max(depth) FILTER ({on}), 1) AS {s}_d",
            f"coalesce(avg(depth) FILTER ({on}), 1.0) AS {s}_a", f"count(*) FILTER ({on} AND depth > 1) AS {s}_dn",
            f"coalesce(sum(volume) FILTER ({on} AND depth > 1), 0) AS {s}_dv",
        ]
    out = ["SecuCode", "TradingDay", "v::BIGINT AS daily_total_volume", "tt::BIGINT AS daily_total_turnover",
           "(buy_v - sell_v)::BIGINT AS net_sweep_volume", "round((buy_v - sell_v) / v, 6) AS sweep_power_bias",
           "round(buy_t / (sell_t + 1e-8), 6) AS buy_sell_sweep_ratio", "round(buy_a - sell_a, 6) AS sweep_depth_bias"]
    for s in ("buy", "sell"):
        out += [
            f"{s}_v::BIGINT AS daily_{s}_sweep_vol", f"{s}_t::BIGINT AS daily_{s}_sweep_turnover",
            f"{s}_n AS {s}_sweep_count", f"{s}_d AS {s}_max_sweepdepth", f"round({s}_v / v, 6) AS {s}_sweep_ratio",
            f"round({s}_dn / ({s}_n + 1e-8), 6) AS {s}_multi_depth_ratio",
            f"round({s}_dv / ({s}_v + 1e-8), 6) AS {s}_multi_depth_vol_ratio",
            f"round({s}_dv / v, 6) AS {s}_multi_depth_market_ratio",
        ]
    return f"SELECT {', '.join(out)} FROM (SELECT SecuCode, TradingDay, {', '.join(cols)} FROM executions GROUP BY 1, 2)"


def rounded(df, n=6, skip=()):
    """Round every double column (sums of doubles depend on their order in the last digits)."""
    return df.select(*[
        F.round(c, n).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


SWEEPS = _sweep_sql().replace("FILTER (order", "FILTER (WHERE order")


@query("ag05_sweep_metrics", SWEEPS)
def _(spark, d):
    return rounded(O.sweep_metrics(V.deals(spark, d)))


@query("ag06_volume_at_price", """
SELECT SecuCode, TradingDay, Price, sum(Volume)::BIGINT AS Volume FROM deals WHERE Side IN (0, 1) GROUP BY 1, 2, 3""")
def _(spark, d):
    return P.volume_at_price(V.deals(spark, d))


V.VIEW_SQL["sizes"] = "SELECT SecuCode, TradingDay, order_side, OrderID, sum(Volume)::BIGINT AS volume FROM sides GROUP BY 1, 2, 3, 4"


@query("ag07_order_tier_arrays", """
SELECT SecuCode, TradingDay, order_side, volume, count(*) AS orders,
  round(sum(volume * count(*)) OVER d / sum(count(*)) OVER d, 6) AS volume_mean
FROM sizes GROUP BY SecuCode, TradingDay, order_side, volume WINDOW d AS (PARTITION BY SecuCode, TradingDay, order_side)""")
def _(spark, d):
    return rounded(O.order_tier_sizes(V.deals(spark, d)))


V.VIEW_SQL["thresholds"] = """
WITH b AS (SELECT SecuCode, TradingDay, volume, CASE order_side WHEN 'buy' THEN 'bid' ELSE 'ask' END AS book FROM sizes
  UNION ALL SELECT SecuCode, TradingDay, volume, 'total' FROM sizes),
m AS (SELECT SecuCode, TradingDay, book, avg(volume) AS mean FROM b GROUP BY 1, 2, 3),
s AS (SELECT SecuCode, book, avg(mean) AS scale FROM m GROUP BY 1, 2),
c AS (SELECT SecuCode, book, quantile_cont(volume / mean, [0.70, 0.95, 0.995]) AS q
      FROM b JOIN m USING (SecuCode, TradingDay, book) GROUP BY 1, 2)
SELECT SecuCode, book, q[1] * scale AS p70, q[2] * scale AS p95, q[3] * scale AS p995 FROM c JOIN s USING (SecuCode, book)"""


@query("ag08_tier_thresholds", """
SELECT SecuCode, book, round(p70, 5) AS p70, round(p95, 5) AS p95, round(p995, 5) AS p995 FROM thresholds""")
def _(spark, d):
    return rounded(O.tier_thresholds(O.order_volumes(V.deals(spark, d))), 5)


def day_cuts(spark, d):
    """Fixed cut-offs per stock, so that tier labels do not sit on a rounding edge."""
    codes = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("SecuCode"))
    cut = lambda base: F.lit(base) + F.col("SecuCode") % 7
    return codes.withColumn("book", F.explode(F.array(F.lit("bid"), F.lit("ask")))).select(
        "SecuCode", "book", (cut(55) + 0.5).alias("p70"), (cut(120) + 0.5).alias("p95"), (cut(170) + 0.5).alias("p995"))


def _tier_sql(v, shift=0):
    base = "SecuCode % 7 + 0.5"
    return (f"CASE WHEN {v} < {55 - shift} + {base} THEN 'Small' WHEN {v} < {120 - shift} + {base} THEN 'Medium' "
            f"WHEN {v} < {170 - shift} + {base} THEN 'Large' ELSE 'Mega' END")


V.VIEW_SQL["flow_m"] = f"""
SELECT SecuCode, TradingDay, minute, {", ".join(
    f"coalesce(sum(volume) FILTER (WHERE c = '{c}' AND tier = '{t}'), 0)::BIGINT AS deal_{c}_vol_{t}"
    for c in O.CATEGORIES for t in C.TIERS)}
FROM (SELECT SecuCode, TradingDay, DealTime // 100000 AS minute, Volume AS volume,
  CASE WHEN order_side = 'buy' THEN CASE WHEN min(Side) OVER o = 0 THEN 'act_buy' ELSE 'pas_buy' END
       ELSE CASE WHEN max(Side) OVER o = 1 THEN 'act_sell' ELSE 'pas_sell' END END AS c,
  {_tier_sql('(sum(Volume) OVER o)')} AS tier
  FROM sides WINDOW o AS (PARTITION BY SecuCode, TradingDay, order_side, OrderID)) GROUP BY 1, 2, 3"""
V.VIEW_SQL["cancel_m"] = f"""
SELECT SecuCode, TradingDay, DealTime // 100000 AS minute, {", ".join(
    f"coalesce(sum(Volume) FILTER (WHERE Side = {k} AND tier = '{t}'), 0)::BIGINT AS cancel{s}_vol_{t}"
    for s, k in (("buy", -1), ("sell", -11)) for t in C.TIERS)}
FROM (SELECT *, CASE WHEN Volume < 20 THEN 'Small' WHEN Volume < 35 THEN 'Medium' WHEN Volume < 45 THEN 'Large' ELSE 'Mega' END AS tier
  FROM deals WHERE Side IN (-1, -11)) GROUP BY 1, 2, 3"""


def flat_cuts(spark, d):
    codes = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("SecuCode"))
    return codes.withColumn("book", F.explode(F.array(F.lit("bid"), F.lit("ask")))).select(
        "SecuCode", "book", F.lit(20.0).alias("p70"), F.lit(35.0).alias("p95"), F.lit(45.0).alias("p995"))


@query("ag09_minute_flow", "SELECT * FROM flow_m")
def _(spark, d):
    return O.minute_flow(V.deals(spark, d), day_cuts(spark, d))


@query("ag10_minute_cancels", "SELECT * FROM cancel_m")
def _(spark, d):
    return O.minute_cancels(V.deals(spark, d), flat_cuts(spark, d))


FLOW_COLS = [f"deal_{c}_vol_{t}" for c in O.CATEGORIES for t in C.TIERS]
CANCEL_COLS = [f"cancel{s}_vol_{t}" for s in ("buy", "sell") for t in C.TIERS]
ALL_COLS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in FLOW_COLS + CANCEL_COLS)


def minutes(spark, d, how):
    deals = V.deals(spark, d)
    flow = O.minute_flow(deals, day_cuts(spark, d))
    cancels = O.minute_cancels(deals, flat_cuts(spark, d))
    return flow.join(cancels, ["SecuCode", "TradingDay", "minute"], how).na.fill(0)


@query("jn03_minute_full_outer", f"""
SELECT SecuCode, TradingDay, minute, {ALL_COLS} FROM flow_m FULL JOIN cancel_m USING (SecuCode, TradingDay, minute)""")
def _(spark, d):
    return minutes(spark, d, "full_outer")


@query("jn04_minute_left", f"""
SELECT SecuCode, TradingDay, minute, {ALL_COLS} FROM flow_m LEFT JOIN cancel_m USING (SecuCode, TradingDay, minute)""")
def _(spark, d):
    return minutes(spark, d, "left")


def _ratio_sql():
    out = []
    for t in C.TIERS:
        for s in ("buy", "sell"):
            dv = f"(coalesce(deal_act_{s}_vol_{t}, 0) + coalesce(deal_pas_{s}_vol_{t}, 0))"
            cv = f"coalesce(cancel{s}_vol_{t}, 0)"
            out.append(f"round(coalesce({cv} / nullif({dv} + {cv}, 0), 0), 6) AS {s}_{t}_cancel_ratio")
        b, a = f"coalesce(cancelbuy_vol_{t}, 0)", f"coalesce(cancelsell_vol_{t}, 0)"
        out.append(f"round(coalesce(({b} - {a}) / nullif({b} + {a}, 0), 0), 6) AS {t}_cancel_imbalance")
    return ", ".join(out)


@query("ag12_cancel_ratios", f"""
SELECT SecuCode, TradingDay, minute, {_ratio_sql()} FROM flow_m FULL JOIN cancel_m USING (SecuCode, TradingDay, minute)""")
def _(spark, d):
    return rounded(O.cancel_ratios(minutes(spark, d, "full_outer")))


V.VIEW_SQL["large_days"] = """
SELECT SecuCode, TradingDay, count(*) FILTER (WHERE Side = 0) AS large_buy_orders,
  count(*) FILTER (WHERE Side = 1) AS large_sell_orders, count(*) FILTER (WHERE Side = -1) AS large_buy_cancels,
  count(*) FILTER (WHERE Side = -11) AS large_sell_cancels FROM deals WHERE Volume >= 35 GROUP BY 1, 2"""


@query("ag13_cancel_asymmetry", """
WITH r AS (SELECT *, large_buy_cancels / (large_buy_orders + 1e-8) - large_sell_cancels / (large_sell_orders + 1e-8) AS dy FROM large_days),
x AS (SELECT SecuCode, TradingDay, dy, sum(large_buy_cancels) OVER w / (sum(large_buy_orders) OVER w + 1e-8) AS b,
  sum(large_sell_cancels) OVER w / (sum(large_sell_orders) OVER w + 1e-8) AS s, count(*) OVER w AS n,
  coalesce(avg(dy) OVER p, 0) AS mean, CASE WHEN count(dy) OVER p = 0 THEN 1 ELSE stddev_samp(dy) OVER p END AS sd
  FROM r WINDOW w AS (PARTITION BY SecuCode ORDER BY TradingDay ROWS 3 PRECEDING),
  p AS (PARTITION BY SecuCode ORDER BY TradingDay ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT SecuCode, TradingDay, round(b, 6) AS rolling_buy_cancel_ratio, round(s, 6) AS rolling_sell_cancel_ratio,
  round(b - s, 6) AS cancel_asymmetry, CASE WHEN abs((dy - mean) / (sd + 1e-8)) < 10000 THEN round((dy - mean) / (sd + 1e-8), 3)
    ELSE round((dy - mean) / (sd + 1e-8) / 10000) * 10000 END AS cancel_asymmetry_zscore,
  round(b * greatest(0, b - s), 6) AS spoofing_score, n AS actual_lookback_days FROM x""")
def _(spark, d):
    side = lambda k: F.count(F.when(F.col("Side") == k, 1))
    days = V.deals(spark, d).where("Volume >= 35").groupBy("SecuCode", "TradingDay").agg(
        side(0).alias("large_buy_orders"), side(1).alias("large_sell_orders"),
        side(-1).alias("large_buy_cancels"), side(-11).alias("large_sell_cancels"))
    out = O.cancel_asymmetry(days, 4)
    z = "cancel_asymmetry_zscore"
    big = F.round(F.col(z) / 10000) * 10000
    return rounded(out, skip=(z,)).withColumn(z, F.when(F.abs(z) < 10000, F.round(z, 3)).otherwise(big))


@query("ag14_cancel_pulse", """
WITH c AS (SELECT o.SecuCode, o.TradingDay, o.side, o.qty, o.qty * o.price AS turnover, o.seq * 1000 AS start_ms,
    x.seq * 1000 AS cancel_ms, x.qty AS cancel_vol
  FROM (SELECT * FROM book_events WHERE kind = 'insert') o JOIN (SELECT * FROM book_events WHERE kind = 'cancel') x
  USING (SecuCode, TradingDay, order_id)),
m AS (SELECT SecuCode, TradingDay, side, cancel_ms // 60000 AS minute, sum(cancel_vol) AS pulse,
  avg((cancel_ms - start_ms) / 1000) AS life, avg(least(greatest((qty - cancel_vol) / qty, 0.0), 1.0)) AS fill
  FROM c WHERE turnover >= 50 GROUP BY 1, 2, 3, 4)
SELECT SecuCode, TradingDay, coalesce(max(pulse) FILTER (WHERE side = 'B'), 0)::BIGINT AS max_pulse_buy_1m,
  round(coalesce(median(life) FILTER (WHERE side = 'B'), -1), 5) AS median_lifetime_buy_1m,
  round(coalesce(avg(fill) FILTER (WHERE side = 'B'), 1), 6) AS mean_fill_rate_buy_1m,
  coalesce(max(pulse) FILTER (WHERE side = 'S'), 0)::BIGINT AS max_pulse_sell_1m,
  round(coalesce(median(life) FILTER (WHERE side = 'S'), -1), 5) AS median_lifetime_sell_1m,
  round(coalesce(avg(fill) FILTER (WHERE side = 'S'), 1), 6) AS mean_fill_rate_sell_1m
FROM m GROUP BY 1, 2""")
def _(spark, d):
    log = V.book_events(spark, d)
    placed = log.where("kind = 'insert'").select(
        "SecuCode", "TradingDay", "order_id", F.when(F.col("side") == "B", "buy").otherwise("sell").alias("side"),
        (F.col("seq") * 1000).alias("start_ms"), F.col("qty").alias("Volume"),
        (F.col("qty") * F.col("price")).alias("Turnover"))
    cancelled = log.where("kind = 'cancel'").select(
        "SecuCode", "TradingDay", "order_id", (F.col("seq") * 1000).alias("cancel_ms"), F.col("qty").alias("cancel_vol"))
    out = O.cancel_pulse(placed.join(cancelled, ["SecuCode", "TradingDay", "order_id"]), 50)
    return out.select(*[
        F.round(c, 5 if c.startswith("median") else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


V.VIEW_SQL["vap"] = """
SELECT SecuCode, TradingDay, Price, sum(Volume)::BIGINT AS Volume FROM deals WHERE Side IN (0, 1) GROUP BY 1, 2, 3"""
V.VIEW_SQL["pairs_t"] = """
WITH dd AS (SELECT SecuCode, TradingDay, sum(Volume) AS v FROM vap GROUP BY 1, 2),
c AS (SELECT *, sum(v) OVER (PARTITION BY SecuCode ORDER BY TradingDay) AS c FROM dd)
SELECT a.SecuCode, a.TradingDay AS target, b.TradingDay FROM c a JOIN c b
  ON a.SecuCode = b.SecuCode AND b.TradingDay <= a.TradingDay AND a.c - b.c < (1500 + 10 * a.SecuCode) * 1.0"""


def free_shares(spark, d):
    return V.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("SecuCode"), (F.col("s_suppkey") * 10 + 1500).alias("free_shares"))


def turnover_pairs(spark, d, profile):
    days = profile.groupBy("SecuCode", "TradingDay").agg(F.sum("Volume").alias("Volume"))
    return P.lookback_turnover(days, free_shares(spark, d))


@query("jn17_lookback_turnover", "SELECT SecuCode, target, TradingDay FROM pairs_t")
def _(spark, d):
    return turnover_pairs(spark, d, P.volume_at_price(V.deals(spark, d)))


@query("jn17_lookback_fixed", """
WITH dd AS (SELECT DISTINCT SecuCode, TradingDay FROM deals),
r AS (SELECT *, row_number() OVER (PARTITION BY SecuCode ORDER BY TradingDay) AS i FROM dd)
SELECT a.SecuCode, a.TradingDay AS target, b.TradingDay FROM r a JOIN r b
  ON a.SecuCode = b.SecuCode AND b.i <= a.i AND a.i - b.i < 3""")
def _(spark, d):
    return P.lookback_fixed(V.deals(spark, d).select("SecuCode", "TradingDay").distinct(), 3)


PROFILES = """
WITH pool AS (SELECT p.SecuCode, target, Price, sum(Volume) AS v, coalesce(sum(Volume) FILTER (WHERE p.TradingDay = target), 0) AS today
  FROM pairs_t p JOIN vap USING (SecuCode, TradingDay) GROUP BY 1, 2, 3),
k AS (SELECT SecuCode, target, arg_max(Price, (v, -Price)) AS poc, max(v) AS pv, sum(v) AS tot, sum(today) AS tt FROM pool GROUP BY 1, 2),
a AS (SELECT *, min(v) OVER (PARTITION BY SecuCode, target, Price > poc ORDER BY abs(Price - poc)) AS rm
  FROM pool JOIN k USING (SecuCode, target) WHERE Price <> poc),
b AS (SELECT *, pv + coalesce(sum(v) OVER (PARTITION BY SecuCode, target ORDER BY rm DESC, Price > poc, abs(Price - poc)
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
va AS (SELECT SecuCode, target, min(Price) AS lo, max(Price) AS hi FROM b WHERE before < tot * 0.7 GROUP BY 1, 2),
en AS (SELECT SecuCode, target, -sum((v / (tot + 1e-8)) * ln(v / (tot + 1e-8) + 1e-8)) AS e,
  coalesce(sum(today) FILTER (WHERE Price BETWEEN poc * 0.99 AND poc * 1.01), 0) / (any_value(tt) + 1e-8) AS st
  FROM pool JOIN k USING (SecuCode, target) GROUP BY 1, 2),
dp AS (SELECT SecuCode, TradingDay, arg_max(Price, (Volume, -Price)) AS p FROM vap GROUP BY 1, 2),
dr AS (SELECT SecuCode, target, count(*) AS n, coalesce(avg(x), 0) AS mig FROM (
  SELECT p.SecuCode, target, d.p - lag(d.p) OVER (PARTITION BY p.SecuCode, target ORDER BY TradingDay) AS x
  FROM pairs_t p JOIN dp d USING (SecuCode, TradingDay)) GROUP BY 1, 2),
cl AS (SELECT SecuCode, TradingDay AS target, arg_max(Price, (DealTime, DealID, Price)) AS close FROM deals WHERE Side IN (0, 1) GROUP BY 1, 2),
f AS (SELECT SecuCode, target, poc, least(coalesce(lo, poc), poc) AS val, greatest(coalesce(hi, poc), poc) AS vah
  FROM k LEFT JOIN va USING (SecuCode, target))
SELECT SecuCode, target AS TradingDay, poc, val, vah, round((vah - val) / (poc + 1e-8), 6) AS va_width_pct,
  round((close - val) / (vah - val + 1e-8), 4) AS price_position_in_va, close > vah AS is_breakout_high,
  round(e, 6) AS profile_entropy_rolling, round(st, 6) AS avsi_sticky_ratio, round(mig, 6) AS poc_migration_vector,
  n AS actual_lookback_days
FROM f JOIN en USING (SecuCode, target) JOIN dr USING (SecuCode, target) JOIN cl USING (SecuCode, target)"""


@query("ag15_volume_profile", PROFILES)
def _(spark, d):
    deals = V.deals(spark, d)
    profile = stage(P.volume_at_price(deals))
    closes = deals.where(C.is_trade(F.col("Side"))).groupBy("SecuCode", "TradingDay").agg(
        F.max_by("Price", O.deal_key()).alias("close"))
    out = P.profile_metrics(profile, stage(turnover_pairs(spark, d, profile)), closes)
    at = "price_position_in_va"
    return rounded(out, skip=(at,)).withColumn(at, F.round(at, 4))
