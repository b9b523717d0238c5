"""Order-book and state-machine queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.functions.series import POS, dealt
from tidemark.operators import book as B
from tidemark.operators import daily as D
from tidemark.operators import flow as O
from tidemark.operators import machines as M
from tidemark.operators import screens as S
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.queries_flow import PROFILES, SWEEPS, day_cuts, deal_log, flat_cuts, rounded, turnover_pairs
from tidemark.plans.queries_screens import GRID, K, T, YEARS, exits, grid_bars
from tidemark.session import stage

V.VIEW_SQL["cut_events"] = """
SELECT e.*, i.seq AS iseq, i.qty AS iqty, i.price AS iprice, CASE WHEN e.kind <> 'insert' AND e.seq > i.seq THEN e.qty ELSE 0 END AS cut
FROM book_events e JOIN book_events i ON i.kind = 'insert' AND i.SecuCode = e.SecuCode AND i.TradingDay = e.TradingDay AND i.order_id = e.order_id"""
V.VIEW_SQL["eff_events"] = """
WITH c AS (SELECT *, sum(cut) OVER (PARTITION BY SecuCode, TradingDay, order_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM cut_events)
SELECT *, greatest(iqty - cum, 0) AS live, CASE WHEN kind = 'insert' THEN iqty ELSE greatest(iqty - cum, 0) - greatest(iqty - cum + cut, 0) END AS delta FROM c"""
V.VIEW_SQL["lives"] = """
SELECT SecuCode, TradingDay, order_id, side, iprice AS price, min(iseq) AS a, coalesce(min(seq) FILTER (WHERE live = 0), 9223372036854775807) AS z FROM eff_events GROUP BY 1, 2, 3, 4, 5"""


@query("ob01_live_orders", """
SELECT SecuCode, TradingDay, order_id, side, iprice AS price, greatest(sum(delta), 0)::BIGINT AS live FROM eff_events GROUP BY 1, 2, 3, 4, 5""")
def _(spark, d):
    return B.live_orders(V.book_events(spark, d))


@query("ob02_depth", """
WITH l AS (SELECT SecuCode, TradingDay, order_id, side, iprice AS price, sum(delta) AS live FROM eff_events GROUP BY 1, 2, 3, 4, 5)
SELECT SecuCode, TradingDay, side, price, sum(live)::BIGINT AS volume, count(*) AS orders FROM l WHERE live > 0 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return B.depth(B.live_orders(V.book_events(spark, d)))


@query("tk07_top_levels", """
WITH l AS (SELECT SecuCode, TradingDay, order_id, side, iprice AS price, sum(delta) AS live FROM eff_events GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT SecuCode, TradingDay, side, price, sum(live)::BIGINT AS volume, count(*) AS orders FROM l WHERE live > 0 GROUP BY 1, 2, 3, 4)
SELECT *, (row_number() OVER (PARTITION BY SecuCode, TradingDay, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END))::INTEGER AS level FROM p QUALIFY level <= 5""")
def _(spark, d):
    return B.top_levels(B.depth(B.live_orders(V.book_events(spark, d))), 5)


@query("ob03_book_totals", """
SELECT SecuCode, TradingDay, seq, order_id, sum(CASE WHEN side = 'B' THEN delta ELSE 0 END) OVER w::BIGINT AS bid_volume,
  sum(CASE WHEN side = 'S' THEN delta ELSE 0 END) OVER w::BIGINT AS ask_volume,
  coalesce((sum(CASE WHEN side = 'B' THEN delta * iprice * 20000 + delta ELSE 0 END) OVER w::BIGINT // nullif(sum(CASE WHEN side = 'B' THEN delta * 2 ELSE 0 END) OVER w::BIGINT, 0)) / 10000, 0) AS bid_price,
  coalesce((sum(CASE WHEN side = 'S' THEN delta * iprice * 20000 + delta ELSE 0 END) OVER w::BIGINT // nullif(sum(CASE WHEN side = 'S' THEN delta * 2 ELSE 0 END) OVER w::BIGINT, 0)) / 10000, 0) AS ask_price,
  sum(CASE WHEN side = 'B' AND kind = 'trade' THEN -delta ELSE 0 END) OVER w::BIGINT AS matched,
  sum(CASE WHEN side = 'B' AND kind = 'trade' THEN -delta * price ELSE 0 END) OVER w::BIGINT AS matched_value
FROM eff_events WINDOW w AS (PARTITION BY SecuCode, TradingDay ORDER BY seq, order_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    return B.book_totals(V.book_events(spark, d)).select(
        "SecuCode", "TradingDay", "seq", "order_id", "bid_volume", "ask_volume", "bid_price", "ask_price", "matched", "matched_value")


V.VIEW_SQL["best_prices"] = """
SELECT e.SecuCode, e.TradingDay, e.seq, e.order_id, coalesce(max(l.price) FILTER (WHERE l.side = 'B'), 0)::DOUBLE AS best_bid,
  coalesce(min(l.price) FILTER (WHERE l.side = 'S'), 0)::DOUBLE AS best_ask
FROM book_events e LEFT JOIN lives l ON l.SecuCode = e.SecuCode AND l.TradingDay = e.TradingDay
  AND (l.a, l.order_id) <= (e.seq, e.order_id) AND (l.z, l.order_id) > (e.seq, e.order_id) GROUP BY 1, 2, 3, 4"""


@query("ob04_best_prices", "SELECT * FROM best_prices")
def _(spark, d):
    return B.best_prices(V.book_events(spark, d)).select("SecuCode", "TradingDay", "seq", "order_id", "best_bid", "best_ask")


#: Own-best orders one after the other: each takes the best of the priced orders and of the earlier own-best orders alive (kept in a list).
V.VIEW_SQL["own_prices"] = """
WITH RECURSIVE k AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY SecuCode, TradingDay, side ORDER BY a) AS i FROM (
  SELECT o.SecuCode, o.TradingDay, o.side, o.order_id, o.a, o.z, max(CASE WHEN l.side = 'B' THEN l.price ELSE -l.price END) AS known
  FROM lives o LEFT JOIN lives l ON l.SecuCode = o.SecuCode AND l.TradingDay = o.TradingDay AND l.side = o.side AND l.order_id % 6 <> 5 AND l.a < o.a AND (l.z, l.order_id) > (o.a, o.order_id)
  WHERE o.order_id % 6 = 5 GROUP BY ALL)),
r AS (
  SELECT SecuCode, TradingDay, side, order_id, i, coalesce(known, 0) AS s, [{'z': z, 'o': order_id, 's': coalesce(known, 0)}] AS held FROM k WHERE i = 1
  UNION ALL
  SELECT SecuCode, TradingDay, side, order_id, i, s, list_append(held, {'z': z, 'o': order_id, 's': s}) FROM (
    SELECT k.*, r.held, coalesce(greatest(k.known, list_max(list_transform(list_filter(r.held, lambda x: (x.z, x.o) > (k.a, k.order_id)), lambda x: x.s))), 0) AS s
    FROM r JOIN k ON k.SecuCode = r.SecuCode AND k.TradingDay = r.TradingDay AND k.side = r.side AND k.i = r.i + 1))
SELECT SecuCode, TradingDay, order_id, CASE WHEN side = 'B' THEN s ELSE -s END AS price FROM r"""


@query("ob04_own_best_prices", """
WITH l AS (SELECT l.* EXCLUDE price, coalesce(p.price, l.price) AS price FROM lives l LEFT JOIN own_prices p USING (SecuCode, TradingDay, order_id))
SELECT e.SecuCode, e.TradingDay, e.seq, e.order_id, p.price::DOUBLE AS used_price, coalesce(max(l.price) FILTER (WHERE l.side = 'B'), 0)::DOUBLE AS best_bid,
  coalesce(min(l.price) FILTER (WHERE l.side = 'S'), 0)::DOUBLE AS best_ask
FROM book_events e JOIN own_prices p USING (SecuCode, TradingDay, order_id) LEFT JOIN l ON l.SecuCode = e.SecuCode AND l.TradingDay = e.TradingDay
  AND (l.a, l.order_id) <= (e.seq, e.order_id) AND (l.z, l.order_id) > (e.seq, e.order_id) WHERE e.kind = 'insert' GROUP BY 1, 2, 3, 4, 5""")
def _(spark, d):
    """Every sixth order is an own-best order."""
    events = V.book_events(spark, d)
    own = events.withColumn("price", F.when(F.col("order_id") % 6 != 5, F.col("price")))
    out = B.best_prices(own).where("kind = 'insert' and order_id % 6 = 5")
    return out.select("SecuCode", "TradingDay", "seq", "order_id", F.col("price").cast("double").alias("used_price"), "best_bid", "best_ask")


V.VIEW_SQL["cancel_places"] = """
SELECT c.SecuCode, c.TradingDay, c.seq, c.order_id, CASE WHEN o.a IS NULL THEN 0 ELSE o.price END AS price,
  CASE WHEN o.a IS NULL THEN -1 ELSE 1 + count(DISTINCT l.price) FILTER (WHERE CASE WHEN o.side = 'B' THEN l.price > o.price ELSE l.price < o.price END) END AS level,
  CASE WHEN o.a IS NULL THEN -1 ELSE 1 + count(*) FILTER (WHERE l.price = o.price AND l.a < o.a) END AS queue
FROM (SELECT * FROM book_events WHERE kind = 'cancel') c
LEFT JOIN lives o ON o.SecuCode = c.SecuCode AND o.TradingDay = c.TradingDay AND o.order_id = c.order_id AND o.a < c.seq AND o.z >= c.seq
LEFT JOIN lives l ON l.SecuCode = c.SecuCode AND l.TradingDay = c.TradingDay AND l.side = o.side AND l.a < c.seq AND (l.z, l.order_id) >= (c.seq, c.order_id) AND l.order_id <> o.order_id
GROUP BY c.SecuCode, c.TradingDay, c.seq, c.order_id, o.a, o.price"""


@query("ob05_cancel_locations", "SELECT * FROM cancel_places")
def _(spark, d):
    return B.cancel_locations(V.book_events(spark, d))


def raw_cancels(spark, d):
    """Cancels as the deal feed reports them: who and how much, without price or place in the book."""
    side = F.when(F.col("side") == "B", -1).otherwise(-11).cast("bigint").alias("Side")
    return V.book_events(spark, d).where("kind = 'cancel'").select(
        *B.DAY, F.col("seq").alias("DealID"), side, F.col("order_id").alias("OrderID"), F.col("qty").alias("Volume"))


V.VIEW_SQL["located"] = """
SELECT SecuCode, TradingDay, seq AS DealID, (CASE WHEN side = 'B' THEN -1 ELSE -11 END)::BIGINT AS Side, order_id AS OrderID, qty AS Volume,
  p.price AS CancelPrice, level AS OBLevel, queue AS QueuePos
FROM book_events e JOIN cancel_places p USING (SecuCode, TradingDay, seq, order_id) WHERE e.kind = 'cancel'"""


@query("jn02_cancel_book_location", "SELECT * FROM located")
def _(spark, d):
    return B.locate_cancels(raw_cancels(spark, d), V.book_events(spark, d))


def raw_tables(spark, d):
    """The same orders, trades and cancels as raw order and deal tables.

    Days of even codes carry their own sequence and cancel by order rows, those of odd codes cancel by deal rows.
    """
    log, oid, at = V.book_events(spark, d), F.col("order_id"), F.col("seq")
    buys, own = F.col("side") == "B", F.col("SecuCode") % 2 == 0
    number = at * 1000 + oid - F.expr("seq div 4") + 300  # unique, and in the order of the events
    code = F.when(F.col("kind") == "cancel", F.when(buys, -1).otherwise(-11)).otherwise(oid % 3 + F.when(buys, 0).otherwise(10)).cast("bigint")
    market = (F.col("kind") == "insert") & (oid % 3 == 1)
    orders = log.where((F.col("kind") == "insert") | ((F.col("kind") == "cancel") & own)).select(
        *B.DAY, (oid + 1).alias("OrderID"), F.when(own, number).otherwise(0).alias("BizIndex"), at.alias("OrderTime"),
        code.alias("OrderType"), F.when(market, 0).otherwise(F.col("price")).alias("Price"),
        F.when(market, F.col("price")).otherwise(0).alias("LastPrice"), F.col("qty").alias("Volume"))
    side = F.when(F.col("kind") == "cancel", F.when(buys, -1).otherwise(-11)).otherwise(oid % 2).cast("bigint")
    deals = log.where((F.col("kind") == "trade") | ((F.col("kind") == "cancel") & ~own)).select(
        *B.DAY, number.alias("DealID"), at.alias("DealTime"), F.when(buys, oid + 1).otherwise(0).alias("BuyID"),
        F.when(buys, 0).otherwise(oid + 1).alias("SellID"), F.col("price").alias("Price"), F.col("qty").alias("Volume"), side.alias("Side"))
    return orders, deals


@query("jn02_raw_cancel_locations", """
SELECT SecuCode, TradingDay, DealID * 1000 + OrderID - DealID // 4 + 300 AS DealID, Side, OrderID + 1 AS OrderID, Volume, CancelPrice, OBLevel, QueuePos FROM located""")
def _(spark, d):
    orders, deals = raw_tables(spark, d)
    cancels = B.cancel_table(orders, deals).drop("DealTime")
    return B.locate_cancels(cancels, stage(B.events_from(orders, deals)))


@query("ag11_large_cancels", """
SELECT SecuCode, TradingDay, """ + ", ".join(
    f"coalesce(sum(Volume) FILTER (WHERE Side = {k} AND {w}), 0)::BIGINT AS {s}_cancel_{n}"
    for s, k in (("buy", -1), ("sell", -11))
    for n, w in (("at_touch", "lv = 1"), ("spoofing", "lv BETWEEN 2 AND 5"), ("deep", "lv >= 6"))
) + """, round(coalesce(sum(Volume / lv) FILTER (WHERE Side = -1 AND lv >= 1), 0), 6) AS total_weighted_buy_cancel,
  round(coalesce(sum(Volume / lv) FILTER (WHERE Side = -11 AND lv >= 1), 0), 6) AS total_weighted_sell_cancel
FROM (SELECT *, OBLevel AS lv FROM located WHERE Volume >= 8 AND Volume < 20) GROUP BY 1, 2""")
def _(spark, d):
    cancels = B.locate_cancels(raw_cancels(spark, d), V.book_events(spark, d))
    layer = C.size_tier(F.col("Volume"), F.lit(4), F.lit(8), F.lit(20))
    return rounded(O.large_cancels(cancels.withColumn("Layer", layer)))


@query("ob07_cancel_table", """
WITH g AS (SELECT SecuCode, TradingDay, bool_or(biz > 0 AND biz <> OrderID) AS b FROM (
  SELECT *, CASE WHEN SecuCode % 2 = 0 THEN BizIndex ELSE 0 END AS biz FROM orders_log) GROUP BY 1, 2)
SELECT o.SecuCode, o.TradingDay, BizIndex AS DealID, OrderTime AS DealTime, OrderType::BIGINT AS Side, OrderID, Volume
  FROM orders_log o JOIN g USING (SecuCode, TradingDay) WHERE b AND OrderType < 0
UNION ALL SELECT x.SecuCode, x.TradingDay, DealID, DealTime, Side, CASE WHEN Side = -1 THEN BuyID ELSE SellID END, Volume
  FROM deal_log x JOIN g USING (SecuCode, TradingDay) WHERE NOT b AND Side < 0""")
def _(spark, d):
    orders = V.orders_log(spark, d).withColumn("BizIndex", F.when(F.col("SecuCode") % 2 == 0, F.col("BizIndex")).otherwise(0))
    return B.cancel_table(orders, deal_log(spark, d))


#: Snapshots by plain joins of orders and the moments at which they live, in words that both engines know. The book after every
#: seventh event of a stock-day, with one fault in most: an order too many in all, 21 or 20 shares on the best level, a price,
#: a count, a turnover, and clocks of long before.
SNAPSHOTS = """
WITH first AS (SELECT SecuCode, TradingDay, order_id, side, min(price) AS price, min(qty) AS qty, min(seq) AS a FROM {log} WHERE kind = 'insert' GROUP BY SecuCode, TradingDay, order_id, side),
moves AS (SELECT e.SecuCode, e.TradingDay, e.order_id, e.seq, e.kind, e.price AS paid, f.side, f.price, f.qty, f.a, CASE WHEN e.kind = 'insert' THEN 0 ELSE e.qty END AS cut
  FROM {log} e JOIN first f ON f.SecuCode = e.SecuCode AND f.TradingDay = e.TradingDay AND f.order_id = e.order_id),
spent AS (SELECT *, sum(cut) OVER (PARTITION BY SecuCode, TradingDay, order_id ORDER BY seq) AS upto FROM moves),
steps AS (SELECT *, greatest(qty - upto, 0) AS live, CASE WHEN kind = 'insert' THEN 0 ELSE greatest(qty - upto + cut, 0) - greatest(qty - upto, 0) END AS gone,
  coalesce(lead(seq) OVER (PARTITION BY SecuCode, TradingDay, order_id ORDER BY seq), 9000000000000000) AS until FROM spent),
moments AS (SELECT SecuCode, TradingDay, seq, row_number() OVER (PARTITION BY SecuCode, TradingDay ORDER BY seq) AS n FROM (SELECT DISTINCT SecuCode, TradingDay, seq FROM steps) x),
chosen AS (SELECT SecuCode, TradingDay, seq, n, CAST((n + 6) / 7 AS int) AS snap_no FROM moments WHERE n % 7 = 0),
book AS (SELECT c.SecuCode, c.TradingDay, c.seq, s.side, s.price, sum(s.live) AS volume, count(*) AS orders
  FROM chosen c JOIN steps s ON s.SecuCode = c.SecuCode AND s.TradingDay = c.TradingDay AND s.seq <= c.seq AND s.until > c.seq AND s.live > 0 GROUP BY c.SecuCode, c.TradingDay, c.seq, s.side, s.price),
totals AS (SELECT SecuCode, TradingDay, seq, sum(CASE WHEN side = 'B' THEN volume ELSE 0 END) AS bid_volume, sum(CASE WHEN side = 'S' THEN volume ELSE 0 END) AS ask_volume,
  sum(CASE WHEN side = 'B' THEN volume * price ELSE 0 END) AS bid_value, sum(CASE WHEN side = 'S' THEN volume * price ELSE 0 END) AS ask_value FROM book GROUP BY SecuCode, TradingDay, seq),
traded AS (SELECT c.SecuCode, c.TradingDay, c.seq, c.n, sum(CASE WHEN s.kind = 'trade' AND s.side = 'B' THEN s.gone ELSE 0 END) AS volume,
  sum(CASE WHEN s.kind = 'trade' AND s.side = 'B' THEN s.gone * s.paid ELSE 0 END) AS turnover
  FROM chosen c JOIN steps s ON s.SecuCode = c.SecuCode AND s.TradingDay = c.TradingDay AND s.seq <= c.seq GROUP BY c.SecuCode, c.TradingDay, c.seq, c.n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY SecuCode, TradingDay, seq, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS level FROM book),
faulty AS (SELECT t.*, (t.n / 7 + t.SecuCode) % 9 AS fault FROM traded t)
SELECT f.SecuCode, f.TradingDay, f.n AS snap_no, f.seq AS taken, CASE WHEN f.fault = 7 THEN 93000000 ELSE 93000000 + f.seq END AS TickTime, f.volume AS TotalVolume,
  f.turnover + CASE WHEN f.fault = 6 THEN 1 ELSE 0 END AS TotalTurnover, t.bid_volume + CASE WHEN f.fault = 1 THEN 1 ELSE 0 END AS TotalBidVolume, t.ask_volume AS TotalAskVolume,
  CAST(floor((t.bid_value * 20 + t.bid_volume) / (CASE WHEN t.bid_volume > 0 THEN t.bid_volume ELSE 1 END * 2)) AS double) AS WeightBidPrice,
  CAST(floor((t.ask_value * 20 + t.ask_volume) / (CASE WHEN t.ask_volume > 0 THEN t.ask_volume ELSE 1 END * 2)) AS double) AS WeightAskPrice,
  r.side, r.level, r.price + CASE WHEN f.fault = 4 AND r.level = 2 THEN 1 ELSE 0 END AS price, r.volume + CASE WHEN r.level > 1 THEN 0 WHEN f.fault = 2 THEN 21 WHEN f.fault = 3 THEN 20 ELSE 0 END AS volume,
  r.orders + CASE WHEN f.fault = 5 AND r.level = 1 THEN 1 ELSE 0 END AS orders
FROM faulty f JOIN totals t ON t.SecuCode = f.SecuCode AND t.TradingDay = f.TradingDay AND t.seq = f.seq
  JOIN ranked r ON r.SecuCode = f.SecuCode AND r.TradingDay = f.TradingDay AND r.seq = f.seq AND r.level <= 10"""
HEAD = ["SecuCode", "TradingDay", "snap_no", "taken", "TickTime", "TotalVolume", "TotalTurnover", "TotalBidVolume", "TotalAskVolume", "WeightBidPrice", "WeightAskPrice"]
V.VIEW_SQL["snap_levels"] = SNAPSHOTS.format(log="book_events").replace("n / 7", "n // 7").replace("(n + 6) / 7", "(n + 6) // 7")
V.VIEW_SQL["snap_heads"] = f"SELECT DISTINCT {', '.join(HEAD)} FROM snap_levels"
#: Every state of the book that a snapshot may meet, compared level by level.
V.VIEW_SQL["snap_checks"] = """
WITH s AS MATERIALIZED (SELECT SecuCode, TradingDay, seq, max(order_id) AS order_id FROM book_events GROUP BY 1, 2, 3),
t AS (SELECT SecuCode, TradingDay, seq, order_id, sum(CASE WHEN side = 'B' THEN delta ELSE 0 END) OVER w AS bid_volume, sum(CASE WHEN side = 'S' THEN delta ELSE 0 END) OVER w AS ask_volume,
    sum(CASE WHEN side = 'B' THEN delta * iprice ELSE 0 END) OVER w AS bid_value, sum(CASE WHEN side = 'S' THEN delta * iprice ELSE 0 END) OVER w AS ask_value,
    sum(CASE WHEN side = 'B' AND kind = 'trade' THEN -delta ELSE 0 END) OVER w AS matched, sum(CASE WHEN side = 'B' AND kind = 'trade' THEN -delta * price ELSE 0 END) OVER w AS value
  FROM eff_events WINDOW w AS (PARTITION BY SecuCode, TradingDay ORDER BY seq, order_id ROWS UNBOUNDED PRECEDING)),
st AS MATERIALIZED (SELECT t.*, first_value(seq) OVER p AS first_seq FROM (SELECT t.*, coalesce(lag(seq) OVER (PARTITION BY SecuCode, TradingDay ORDER BY seq), -1) AS before FROM t JOIN s USING (SecuCode, TradingDay, seq, order_id)) t
  WINDOW p AS (PARTITION BY SecuCode, TradingDay, matched ORDER BY seq)),
stretch AS (SELECT SecuCode, TradingDay, matched, min(seq) AS first_seq, arg_min(before, seq) AS before, max(value) AS value FROM st GROUP BY 1, 2, 3),
h AS MATERIALIZED (SELECT h.*, r.first_seq, (TickTime < 92500000 OR TickTime BETWEEN 145700000 AND 149999999 OR greatest(nb, na) < 5) AS easy
  FROM (SELECT h.*, x.nb, x.na FROM snap_heads h JOIN (SELECT SecuCode, TradingDay, snap_no, count(*) FILTER (WHERE side = 'B') AS nb, count(*) FILTER (WHERE side = 'S') AS na FROM snap_levels GROUP BY 1, 2, 3) x USING (SecuCode, TradingDay, snap_no)) h
  JOIN stretch r ON r.SecuCode = h.SecuCode AND r.TradingDay = h.TradingDay AND r.matched = h.TotalVolume AND r.value = h.TotalTurnover
  WHERE 93000000 + r.first_seq < TickTime + 2000 OR r.before < 0 OR 93000000 + r.before < TickTime + 2000),
c AS MATERIALIZED (SELECT h.*, st.seq, st.order_id AS oid FROM h JOIN st ON st.SecuCode = h.SecuCode AND st.TradingDay = h.TradingDay AND st.matched = h.TotalVolume
  AND st.bid_volume = h.TotalBidVolume AND st.ask_volume = h.TotalAskVolume WHERE NOT easy
  AND abs(coalesce((bid_value * 20 + bid_volume) // nullif(bid_volume * 2, 0), 0) - WeightBidPrice) < CASE WHEN WeightBidPrice % 10 = 0 THEN 6 ELSE 2 END
  AND abs(coalesce((ask_value * 20 + ask_volume) // nullif(ask_volume * 2, 0), 0) - WeightAskPrice) < CASE WHEN WeightBidPrice % 10 = 0 THEN 6 ELSE 2 END),
live AS (SELECT c.SecuCode, c.TradingDay, c.snap_no, c.seq, l.side, l.price, sum(e.delta) AS volume, count(DISTINCT l.order_id) AS orders FROM c
  JOIN lives l ON l.SecuCode = c.SecuCode AND l.TradingDay = c.TradingDay AND (l.a, l.order_id) <= (c.seq, c.oid) AND (l.z, l.order_id) > (c.seq, c.oid)
  JOIN eff_events e ON e.SecuCode = c.SecuCode AND e.TradingDay = c.TradingDay AND e.order_id = l.order_id AND e.seq <= c.seq GROUP BY 1, 2, 3, 4, 5, 6),
mine AS (SELECT *, row_number() OVER (PARTITION BY SecuCode, TradingDay, snap_no, seq, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS level FROM live QUALIFY level <= 10),
slots AS (SELECT c.SecuCode, c.TradingDay, c.snap_no, c.seq, x.side, y.level FROM c, (VALUES ('B'), ('S')) x(side), range(1, 11) y(level)),
agree AS (SELECT p.SecuCode, p.TradingDay, p.snap_no, p.seq, bool_and(coalesce(m.price, 0) = coalesce(q.price, 0) AND coalesce(m.orders, 0) = coalesce(q.orders, 0) AND abs(coalesce(m.volume, 0) - coalesce(q.volume, 0)) <= 20) AS good
  FROM slots p LEFT JOIN mine m USING (SecuCode, TradingDay, snap_no, seq, side, level) LEFT JOIN snap_levels q USING (SecuCode, TradingDay, snap_no, side, level) GROUP BY 1, 2, 3, 4),
won AS (SELECT SecuCode, TradingDay, snap_no, seq FROM agree WHERE good UNION ALL SELECT SecuCode, TradingDay, snap_no, first_seq FROM h WHERE easy)
SELECT h.SecuCode, h.TradingDay, h.snap_no, h.TickTime, min(w.seq) AS at_seq, min(w.seq) IS NOT NULL AS ok
FROM snap_heads h LEFT JOIN won w USING (SecuCode, TradingDay, snap_no) WHERE NOT (TotalBidVolume = 0 AND TotalAskVolume = 0) GROUP BY 1, 2, 3, 4"""


def snapshots(spark, d):
    """The snapshots of SNAPSHOTS as one row each with its levels.

    The events are dealt out once by stock-day. What orders change at a level between two snapshots is summed, and a level's running
    sums are spread over the snapshots at which it has an order, so no order meets a snapshot.
    """
    log = V.book_events(spark, d).where("SecuCode is not null and TradingDay is not null and order_id is not null")
    of_order = Window.partitionBy(*B.ORDER).orderBy("seq")
    whole, upto = of_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.sum("cut").over(of_order)
    placed = lambda s, x: F.when((F.col("kind") == "insert") & (F.col("side") == s), x)
    rows = dealt(log, B.DAY).withColumn("cut", F.when(F.col("kind") == "insert", 0).otherwise(F.col("qty"))).withColumns(
        {f"{s}_{n}": f(placed(s, F.col(c))).over(whole) for s in "BS" for n, f, c in (("n", F.count, "kind"), ("price", F.min, "price"), ("qty", F.min, "qty"))}
        | {"upto": upto}).where("B_n > 0 or S_n > 0")
    # an order entered on both sides is cut for both, and stands on one
    rows = rows.withColumn("upto", F.expr("upto * (if(B_n > 0, 1, 0) + if(S_n > 0, 1, 0))")).selectExpr(
        *B.ORDER, "seq", "if(S_n > 0, 'S', 'B') AS side", "if(S_n > 0, S_price, B_price) AS price", "greatest(if(S_n > 0, S_qty, B_qty) - upto, 0) AS live",
        "CASE WHEN kind = 'trade' AND B_n > 0 THEN greatest(B_qty - upto + cut, 0) - greatest(B_qty - upto, 0) ELSE 0 END AS gone",
        "CASE WHEN kind = 'trade' AND B_n > 0 THEN (greatest(B_qty - upto + cut, 0) - greatest(B_qty - upto, 0)) * price ELSE 0 END AS paid")
    by_time = Window.partitionBy(*B.DAY).orderBy("seq")
    rows = rows.withColumn("was", F.coalesce(F.lag("live").over(of_order), F.lit(0))).withColumns({
        "n": F.dense_rank().over(by_time), "volume": F.sum("gone").over(by_time), "turnover": F.sum("paid").over(by_time)})
    rows = rows.withColumn("all", F.expr("max(n) OVER (PARTITION BY SecuCode, TradingDay) div 7")).withColumn("at", F.expr("(n + 6) div 7"))
    rows = rows.where(F.col("at") <= F.col("all")).selectExpr(*B.DAY, "at", "all", """inline(array_compact(array(
        CASE WHEN live <> was THEN named_struct('side', side, 'price', price, 'v', live - was, 'o', if(live > 0, 1, 0) - if(was > 0, 1, 0), 'taken', null, 'volume', null, 'turnover', null) END,
        CASE WHEN n % 7 = 0 THEN named_struct('side', '', 'price', null, 'v', 0, 'o', 0, 'taken', seq, 'volume', volume, 'turnover', turnover) END)))""")
    steps = rows.groupBy(*B.DAY, "at", "all", "side", "price").agg(
        *[F.sum(c).alias(c) for c in ("v", "o")], *[F.max(c).alias(c) for c in ("taken", "volume", "turnover")])
    of_level = Window.partitionBy(*B.DAY, "side", "price").orderBy("at")
    so_far = of_level.rowsBetween(Window.unboundedPreceding, 0)
    levels = steps.withColumns({"until": F.coalesce(F.lead("at").over(of_level) - 1, "all"), "v": F.sum("v").over(so_far), "o": F.sum("o").over(so_far)})
    levels = levels.withColumn("at", F.explode(F.expr("CASE WHEN side = '' THEN array(at) WHEN o > 0 THEN sequence(at, until) END")))
    heads = levels.groupBy(*B.DAY, "at").agg(
        *[F.max(c).alias(c) for c in ("taken", "volume", "turnover")],
        *[F.expr(f"sum(CASE side WHEN '{s}' THEN {x} WHEN '' THEN null ELSE 0 END)").alias(f"{s}_{n}") for s in "BS" for n, x in (("volume", "v"), ("value", "v * price"))],
        *[F.expr(f"slice(sort_array(collect_list(CASE WHEN side = '{s}' THEN named_struct('k', {k}, 'price', price, 'v', v, 'o', o) END)), 1, 10)").alias(n)
          for s, k, n in (("B", "-price", "bids"), ("S", "price", "asks"))])
    shown = """transform({0}, (x, i) -> named_struct('price', cast(x.price + if(fault = 4 and i = 1, 1, 0) AS double),
        'volume', cast(x.v + CASE WHEN i > 0 THEN 0 WHEN fault = 2 THEN 21 WHEN fault = 3 THEN 20 ELSE 0 END AS bigint), 'orders', cast(x.o + if(fault = 5 and i = 0, 1, 0) AS bigint))) AS {0}"""
    mean = "CAST(floor(({0}_value * 20 + {0}_volume) / (CASE WHEN {0}_volume > 0 THEN {0}_volume ELSE 1 END * 2)) AS double)"
    return heads.where("size(bids) + size(asks) > 0").withColumn("fault", F.expr("(at + SecuCode) % 9")).selectExpr(
        *B.DAY, "cast(at * 7 AS bigint) AS snap_no", "cast(taken AS bigint) AS taken", "cast(if(fault = 7, 93000000, 93000000 + taken) AS bigint) AS TickTime",
        "cast(volume AS bigint) AS TotalVolume", "cast(turnover + if(fault = 6, 1, 0) AS bigint) AS TotalTurnover", "cast(B_volume + if(fault = 1, 1, 0) AS bigint) AS TotalBidVolume",
        "cast(S_volume AS bigint) AS TotalAskVolume", f"{mean.format('B')} AS WeightBidPrice", f"{mean.format('S')} AS WeightAskPrice", shown.format("bids"), shown.format("asks"))


def checked(spark, d):
    """One event a millisecond."""
    events = V.book_events(spark, d).withColumn("clock", F.col("seq") + 93_000_000)
    return B.verify_snapshots(events, stage(snapshots(spark, d)))


@query("ob06_verify_snapshots", "SELECT SecuCode, TradingDay, snap_no, at_seq, ok FROM snap_checks")
def _(spark, d):
    return checked(spark, d).select("SecuCode", "TradingDay", "snap_no", "at_seq", "ok")


@query("ob09_verification_report", """
SELECT SecuCode, TradingDay, bool_and(ok) AS passed, count(*) AS snapshots, min(TickTime) FILTER (WHERE NOT ok) AS first_failure FROM snap_checks GROUP BY 1, 2""")
def _(spark, d):
    return B.verification_report(checked(spark, d))


@query("jn13_snapshot_match", """
WITH t AS (SELECT SecuCode, TradingDay, seq, sum(CASE WHEN side = 'B' AND kind = 'trade' THEN -delta ELSE 0 END) OVER (PARTITION BY SecuCode, TradingDay ORDER BY seq, order_id ROWS UNBOUNDED PRECEDING)::BIGINT AS m FROM eff_events)
SELECT SecuCode, TradingDay, m AS TotalVolume, min(seq) AS first_seq FROM t GROUP BY 1, 2, 3""")
def _(spark, d):
    totals = B.book_totals(V.book_events(spark, d))
    return totals.groupBy(*B.DAY, F.col("matched").alias("TotalVolume")).agg(F.min("seq").alias("first_seq"))


V.VIEW_SQL["day_bars"] = """
SELECT SecuCode, TradingDay, arg_min(Price, (DealTime, DealID)) AS open, max(Price) AS high, min(Price) AS low, sum(Volume)::BIGINT AS volume,
  sum(Price * Volume)::BIGINT AS turnover, count(*) AS trades FROM deals WHERE Side IN (0, 1) GROUP BY 1, 2"""


@query("ob10_daily_metrics", f"""
WITH m AS (SELECT SecuCode, TradingDay, count(*) AS minutes, {", ".join(f"sum(coalesce(deal_{c}_vol_Mega, 0))::BIGINT AS {c}_mega" for c in O.CATEGORIES)} FROM flow_m GROUP BY 1, 2),
x AS (SELECT SecuCode, TradingDay, {", ".join(f"sum({c})::BIGINT AS {c}" for c in D.CANCELS)} FROM cancel_m GROUP BY 1, 2),
o AS (SELECT SecuCode, round(p70, 5) AS order_p70, round(p95, 5) AS order_p95, round(p995, 5) AS order_p995 FROM thresholds WHERE book = 'total')
SELECT * REPLACE ({", ".join(f"coalesce({c}, 0) AS {c}" for c in D.CANCELS)})
FROM day_bars JOIN ({SWEEPS}) USING (SecuCode, TradingDay) JOIN m USING (SecuCode, TradingDay) JOIN ({PROFILES}) USING (SecuCode, TradingDay)
JOIN o USING (SecuCode) LEFT JOIN x USING (SecuCode, TradingDay)""")
def _(spark, d):
    """Bars, sweeps, profile, tiers, minute flow and cancels of every stock-day in one job, keyed by stock and day."""
    metrics = D.daily_metrics(V.deals(spark, d), day_cuts(spark, d), flat_cuts(spark, d), lambda profile: turnover_pairs(spark, d, profile))
    at, tiers = "price_position_in_va", ("order_p70", "order_p95", "order_p995")
    return rounded(metrics, skip=(at, *tiers)).withColumns({at: F.round(at, 4), **{c: F.round(c, 5) for c in tiers}})


V.VIEW_SQL["segments"] = """
WITH RECURSIVE n AS MATERIALIZED (SELECT symbol, t, close, row_number() OVER w AS i, max(close) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS top
  FROM bars_m WINDOW w AS (PARTITION BY symbol ORDER BY t)),
p AS MATERIALIZED (SELECT a.symbol, a.i, any_value(a.t) AS start_t, min(b.i) AS pi, min(b.t) AS peak_t, any_value((a.top - a.close) / a.close) AS growth
  FROM n a JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i AND a.i + 11 AND b.close = a.top GROUP BY 1, 2),
r AS (SELECT symbol, 0::BIGINT AS i, 1::BIGINT AS following, 0::BIGINT AS start_t, 0::BIGINT AS peak_t, 0::DOUBLE AS growth FROM n GROUP BY 1
  UNION ALL
  SELECT p.symbol, p.i, CASE WHEN p.growth >= 2 THEN p.pi ELSE p.i END + 1, p.start_t, p.peak_t, p.growth FROM r JOIN p ON p.symbol = r.symbol AND p.i = r.following)
SELECT symbol, start_t, peak_t, round(growth, 6) AS growth, peak_t - start_t AS duration FROM r WHERE growth >= 2"""


@query("wn41_growth_segments", "SELECT * FROM segments")
def _(spark, d):
    return rounded(M.growth_segments(V.bars_m(spark, d), K, "t", YEARS, 2.0, 12))


BOX = dict(mid_rows=6, band=0.9, init=3, period=4)
V.VIEW_SQL["price_boxes"] = f"""
WITH RECURSIVE m AS (SELECT symbol, t, high::DOUBLE AS h, low::DOUBLE AS l, close::DOUBLE AS c, avg(close) OVER w AS mid, row_number() OVER (PARTITION BY symbol ORDER BY t) AS pos
  FROM bars_m WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 5 PRECEDING)),
g AS MATERIALIZED (SELECT symbol, t, h, l, c, pos - 5 AS i, mid * {1 + BOX['band']!r}e0 AS top, mid * {1 - BOX['band']!r}e0 AS bottom FROM m WHERE pos >= 6),
r AS (SELECT symbol, 0::BIGINT AS i, 0::BIGINT AS days, 0::DOUBLE AS high, 0::DOUBLE AS low, 0::BIGINT AS hits, 0::BIGINT AS start_t, 0::BIGINT AS end_t,
    0::BIGINT AS o_days, 0::DOUBLE AS o_high, 0::DOUBLE AS o_low, 0::BIGINT AS o_start, 0::BIGINT AS o_end, 'wait' AS act, 0::BIGINT AS t FROM g GROUP BY 1
  UNION ALL
  SELECT symbol, i, CASE act WHEN 'wait' THEN 0 WHEN 'build' THEN days + 1 WHEN 'grow' THEN days + 1 ELSE 1 END,
    CASE act WHEN 'wait' THEN high WHEN 'build' THEN CASE WHEN h > top THEN top ELSE greatest(high, h) END WHEN 'grow' THEN greatest(high, h) ELSE h END,
    CASE act WHEN 'wait' THEN low WHEN 'build' THEN CASE WHEN l < bottom THEN bottom ELSE least(low, l) END WHEN 'grow' THEN least(low, l) ELSE l END,
    CASE WHEN act = 'wait' THEN hits WHEN act = 'build' AND (h > top OR l < bottom) THEN hits + 1 ELSE 0 END,
    CASE WHEN act IN ('wait', 'build', 'grow') THEN start_t ELSE t END, CASE WHEN act = 'wait' THEN end_t ELSE t END,
    days, high, low, start_t, end_t, act, t
  FROM (SELECT g.symbol, g.i, g.t, g.h, g.l, g.c, g.top, g.bottom, r.days, r.high, r.low, r.hits, r.start_t, r.end_t,
      CASE WHEN r.days = 0 THEN CASE WHEN g.h > g.top OR g.l < g.bottom THEN 'wait' ELSE 'fresh' END
        WHEN r.days < {BOX['init']} THEN CASE WHEN r.hits > 1 THEN 'fresh' ELSE 'build' END
        WHEN g.c > r.high AND g.h > (r.high + r.low) / 2 * 1.1e0 THEN 'up'
        WHEN g.c < r.low AND g.l < (r.high + r.low) / 2 * 0.9e0 THEN 'fresh' ELSE 'grow' END AS act
    FROM r JOIN g ON g.symbol = r.symbol AND g.i = r.i + 1))
SELECT symbol, o_start AS start_t, o_end AS end_t, t AS break_t, round(o_high, 6) AS box_high, round(o_low, 6) AS box_low, o_days AS days
FROM r WHERE act = 'up' AND o_days > {BOX['period']}"""


@query("wn42_price_boxes", "SELECT * FROM price_boxes")
def _(spark, d):
    return rounded(M.boxes(V.bars_m(spark, d), K, "t", YEARS, **BOX))


V.VIEW_SQL["ratchet"] = """
WITH RECURSIVE g AS MATERIALIZED (SELECT symbol, param_id, t, entry, close, atr, row_number() OVER (PARTITION BY symbol, param_id ORDER BY t) AS i FROM grid_sig),
r AS (
  SELECT symbol, param_id, t, i, CASE WHEN entry AND atr IS NOT NULL THEN close - 0.3::DOUBLE * atr END AS stop, false AS exit FROM g WHERE i = 1
  UNION ALL
  SELECT g.symbol, g.param_id, g.t, g.i,
    CASE WHEN r.stop IS NULL OR r.exit THEN CASE WHEN g.entry AND g.atr IS NOT NULL THEN g.close - 0.3::DOUBLE * g.atr END
         WHEN g.close < r.stop THEN r.stop ELSE greatest(r.stop, g.close - 0.3::DOUBLE * g.atr) END,
    r.stop IS NOT NULL AND NOT r.exit AND g.close < r.stop
  FROM r JOIN g ON g.symbol = r.symbol AND g.param_id = r.param_id AND g.i = r.i + 1)
SELECT symbol, param_id, t::BIGINT AS t, round(stop, 6) AS stop, exit FROM r WHERE stop IS NOT NULL"""


@query("wn45_ratchet_stops", "SELECT * FROM ratchet")
def _(spark, d):
    """The stops of all parameter sets run in one pass over each supplier's bars."""
    enter = F.array_compact(F.array(*[F.when(F.col(f"_hit{i}"), F.lit(i)) for i in range(len(GRID))])).alias("entry")
    signals = S.grid_hits(grid_bars(spark, d), GRID, "t").select(*K, POS, "t", enter, "close", "atr")
    return rounded(M.ratchet_stops(signals, K, "t", YEARS, 0.3, points="param_id").select(*K, "param_id", "t", "stop", "exit"))
