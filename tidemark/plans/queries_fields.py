"""Projection, filter and classification queries."""

from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.functions.series import exact_percentiles, open_series
from tidemark.plans import views as V
from tidemark.plans.catalog import query

CODES = """(SELECT o_orderkey, lpad(((o_orderkey * 104729 + 430000) % 1000000)::VARCHAR, 6, '0') AS code,
  CASE o_orderkey % 3 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE 'bj' END AS ex FROM orders)"""


def codes(spark, d):
    key = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        "o_orderkey",
        C.padded_code((key * 104729 + 430000) % 1000000).alias("code"),
        F.when(key % 3 == 0, "sz").when(key % 3 == 1, "sh").otherwise("bj").alias("ex"),
    )


@query("prj01_event_time", """
SELECT DealID, Price, Volume, epoch_ms(make_date(TradingDay, 1, 2)::TIMESTAMP)
  + ((DealTime // 10000000) * 3600 + (DealTime // 100000 % 100) * 60 + DealTime // 1000 % 100) * 1000
  + DealTime % 1000 AS at_ms FROM deals""")
def _(spark, d):
    return V.deals(spark, d).select(
        "DealID", "Price", "Volume",
        F.unix_millis(C.event_time(F.col("TradingDay") * 10000 + 102, F.col("DealTime"))).alias("at_ms"),
    )


@query("prj02_minute_bucket", """
SELECT SecuCode, DealTime // 100000 AS minute, count(*) AS n FROM deals GROUP BY 1, 2""")
def _(spark, d):
    return (
        V.deals(spark, d).groupBy("SecuCode", C.minute_of(F.col("DealTime")).alias("minute"))
        .agg(F.count("*").alias("n"))
    )


@query("prj03_turnover", "SELECT DealID, Price, Volume, Price * Volume AS Turnover FROM deals")
def _(spark, d):
    return V.deals(spark, d).select(
        "DealID", "Price", "Volume", (F.col("Price") * F.col("Volume")).alias("Turnover"))


@query("prj04_scaled_integers", """
SELECT o_orderkey, round_even(o_totalprice * 100, 0)::BIGINT AS price100,
       round_even(o_totalprice * 10, 0)::BIGINT AS price10,
       93000000 + o_orderkey % 3000 * 1000 - 1000 AS tick_time FROM orders""")
def _(spark, d):
    price = F.col("o_totalprice")
    return V.table(spark, d, "orders").select(
        "o_orderkey", C.scaled(price, 100).alias("price100"), C.scaled(price, 10).alias("price10"),
        (F.lit(93_000_000) + F.col("o_orderkey") % 3000 * 1000 - 1000).alias("tick_time"),
    )


@query("prj05_trades_and_cancels", """
SELECT DealID, Price, Side, Side IN (0, 1) AS trade, Side IN (-1, -11) AS cancel FROM deals
WHERE Side IN (0, 1, -1, -11)""")
def _(spark, d):
    side = F.col("Side")
    return V.deals(spark, d).where(C.is_trade(side) | C.is_cancel(side)).select(
        "DealID", "Price", "Side", C.is_trade(side).alias("trade"), C.is_cancel(side).alias("cancel"))


@query("prj06_weighted_price", """
SELECT symbol, ts, round((high + 2 * open + 2 * close + low) / 6, 6) AS ohlc FROM bars_h""")
def _(spark, d):
    return V.bars_h(spark, d).select("symbol", "ts", F.round(C.weighted_price(), 6).alias("ohlc"))


@query("prj07_exchange", f"""
SELECT o_orderkey, code, CASE WHEN code[1:2] IN ('60', '68') THEN 'SH' WHEN code[1:2] IN ('00', '30') THEN 'SZ'
  WHEN code[1:2] IN ('83', '87', '43') THEN 'BJ' ELSE 'UNKNOWN' END AS exchange FROM {CODES}""")
def _(spark, d):
    return codes(spark, d).select("o_orderkey", "code", C.exchange_of(F.col("code")).alias("exchange"))


@query("prj08_security_type", f"""
WITH k AS (SELECT o_orderkey, CASE
  WHEN ex = 'sz' AND code[1:2] IN ('00', '30') THEN 'SZ_A_STOCK'
  WHEN ex = 'sz' AND code[1:2] IN ('20') THEN 'SZ_B_STOCK'
  WHEN ex = 'sz' AND code[1:2] IN ('39') THEN 'SZ_INDEX'
  WHEN ex = 'sz' AND code[1:2] IN ('15', '16') THEN 'SZ_FUND'
  WHEN ex = 'sz' AND code[1:2] IN ('10', '11', '12', '13', '14') THEN 'SZ_BOND'
  WHEN ex = 'sh' AND code[1:2] IN ('60', '68') THEN 'SH_A_STOCK'
  WHEN ex = 'sh' AND code[1:2] IN ('90') THEN 'SH_B_STOCK'
  WHEN ex = 'sh' AND code[1:2] IN ('00', '88', '99') THEN 'SH_INDEX'
  WHEN ex = 'sh' AND code[1:2] IN ('50', '51') THEN 'SH_FUND'
  WHEN ex = 'sh' AND code[1:2] IN ('01', '10', '11', '12', '13', '14') THEN 'SH_BOND'
  WHEN ex = 'bj' AND code[1:2] IN ('43', '92', '87', '83') THEN 'BJ_A_STOCK' END AS kind FROM {CODES})
SELECT o_orderkey, kind,
  CASE WHEN kind IN ('SH_B_STOCK', 'SH_FUND', 'SH_BOND', 'SZ_FUND', 'SZ_BOND') THEN 0.001::DOUBLE
       WHEN kind IS NOT NULL THEN 0.01::DOUBLE END AS price_scale,
  CASE WHEN kind IN ('SH_INDEX', 'SH_FUND', 'SH_BOND', 'SZ_INDEX') THEN 1.0::DOUBLE
       WHEN kind IS NOT NULL THEN 0.01::DOUBLE END AS volume_scale FROM k""")
def _(spark, d):
    kind = C.security_type(F.col("ex"), F.col("code"))
    return codes(spark, d).withColumn("kind", kind).select(
        "o_orderkey", "kind", C.security_scale(F.col("kind"), 0).alias("price_scale"),
        C.security_scale(F.col("kind"), 1).alias("volume_scale"),
    )


@query("prj09_market_id", f"""
SELECT o_orderkey, CASE WHEN code[1:1] IN ('5', '6', '9')
  OR code[1:3] IN ('009', '126', '110', '201', '202', '203', '204') THEN 1 ELSE 0 END AS market FROM {CODES}""")
def _(spark, d):
    return codes(spark, d).select("o_orderkey", C.market_id(F.col("code")).alias("market"))


@query("prj10_symbol", """
WITH c AS (SELECT c_custkey, lpad((c_custkey * 379 % 1000000)::VARCHAR, 6, '0') AS code FROM customer)
SELECT c_custkey, code || '.' || CASE WHEN code[1:2] IN ('60', '68') THEN 'SH' WHEN code[1:2] IN ('00', '30') THEN 'SZ'
  WHEN code[1:2] IN ('83', '87', '43') THEN 'BJ' ELSE 'UNKNOWN' END AS symbol FROM c""")
def _(spark, d):
    return V.table(spark, d, "customer").select(
        "c_custkey", C.symbol_of(F.col("c_custkey") * 379 % 1000000).alias("symbol"))


@query("prj11_order_type", """
SELECT OrderID, CASE WHEN OrderType IN (0, 1, 2, 3, -1) THEN 'B' ELSE 'S' END AS side,
  CASE WHEN OrderType IN (0, 10) THEN 'limit' WHEN OrderType IN (-1, -11) THEN 'cancel' END AS source
FROM orders_log""")
def _(spark, d):
    kind = F.col("OrderType")
    return V.orders_log(spark, d).select(
        "OrderID", C.order_side(kind).alias("side"), C.order_price_source(kind).alias("source"))


@query("prj12_size_tier", """
SELECT DealID, Price, Volume, CASE WHEN Volume < 20 THEN 'Small' WHEN Volume < 35 THEN 'Medium'
  WHEN Volume < 49 THEN 'Large' ELSE 'Mega' END AS tier FROM deals""")
def _(spark, d):
    return V.deals(spark, d).select(
        "DealID", "Price", "Volume",
        C.size_tier(F.col("Volume"), F.lit(20), F.lit(35), F.lit(49)).alias("tier"))


@query("prj13_auction_flag", """
SELECT SecuCode, TradingDay, count(*) FILTER (WHERE (DealTime >= 92500000 AND DealTime < 93000000)
  OR (DealTime >= 145700000 AND DealTime < 150000000)) AS n FROM deals GROUP BY 1, 2""")
def _(spark, d):
    flag = C.in_auction(F.col("DealTime"))
    return V.deals(spark, d).groupBy("SecuCode", "TradingDay").agg(F.count(F.when(flag, 1)).alias("n"))


@query("prj14_price_tolerance", """
SELECT o_orderkey, CASE WHEN o_orderkey * 7 % 10 = 0 THEN 0 ELSE 1 END AS decimals,
  CASE WHEN o_orderkey * 7 % 10 = 0 THEN 6 ELSE 2 END AS tolerance FROM orders""")
def _(spark, d):
    price = F.col("o_orderkey") * 7
    return V.table(spark, d, "orders").select(
        "o_orderkey", C.price_decimals(price).alias("decimals"), C.price_tolerance(price).alias("tolerance"))


FUTURES_SQL = """(SELECT event_id, user_id % 3 * 10000 + event_id * 13 % 90 AS code, 1 + event_id % 4 AS volume,
  event_id % 9 - 4 AS change, CASE WHEN user_id % 7 = 0 THEN 31 ELSE 28 END AS market FROM events)"""


def futures(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    return V.table(spark, d, "events").select(
        "event_id", (u % 3 * 10000 + e * 13 % 90).alias("code"), (e % 4 + 1).alias("volume"),
        (e % 9 - 4).alias("change"), F.when(u % 7 == 0, 31).otherwise(28).alias("market"),
    )


@query("prj15_futures_nature", f"""
SELECT event_id, CASE WHEN code % 10000 > 59 THEN 0 ELSE code % 10000 END AS second,
  CASE WHEN market = 31 THEN CASE WHEN code = 0 THEN 1 WHEN code = 256 THEN -1 ELSE 0 END
       WHEN code // 10000 = 0 THEN 1 WHEN code // 10000 = 1 THEN -1 ELSE 0 END AS direction,
  CASE WHEN market = 31 THEN CASE WHEN code = 0 THEN 'B' WHEN code = 256 THEN 'S' ELSE '' END
  WHEN code // 10000 = 0 THEN CASE WHEN change > 0 THEN CASE WHEN volume > change THEN '多开' WHEN volume = change THEN '双开' END
    WHEN change = 0 THEN '多换' WHEN volume = -change THEN '双平' ELSE '空平' END
  WHEN code // 10000 = 1 THEN CASE WHEN change > 0 THEN CASE WHEN volume > change THEN '空开' WHEN volume = change THEN '双开' END
    WHEN change = 0 THEN '空换' WHEN volume = -change THEN '双平' ELSE '多平' END
  ELSE CASE WHEN change > 0 THEN CASE WHEN volume > change THEN '开仓' WHEN volume = change THEN '双开' END
    WHEN change < 0 THEN CASE WHEN volume > -change THEN '平仓' WHEN volume = -change THEN '双平' END
    ELSE '换手' END END AS nature FROM {FUTURES_SQL}""")
def _(spark, d):
    code, volume, change, market = (F.col(c) for c in ("code", "volume", "change", "market"))
    return futures(spark, d).select(
        "event_id", C.futures_second(code).alias("second"),
        C.futures_direction(code, market).alias("direction"),
        C.futures_nature(code, volume, change, market).alias("nature"),
    )


NAMES_SQL = ", ".join(f"({k}, '{v}')" for k, v in C.ACTION_NAMES.items())


@query("prj16_corporate_actions", f"""
WITH a AS (SELECT event_id, (1 + event_id % 14)::INTEGER AS category, value AS a, value * 2 AS b, value * 3 AS c, value * 4 AS d FROM events)
SELECT event_id, category, name, CASE WHEN category = 1 THEN a END AS fenhong, CASE WHEN category = 1 THEN b END AS peigujia,
  CASE WHEN category = 1 THEN c END AS songzhuangu, CASE WHEN category = 1 THEN d END AS peigu,
  CASE WHEN category IN (11, 12) THEN c END AS suogu, CASE WHEN category IN (13, 14) THEN a END AS xingquanjia,
  CASE WHEN category IN (13, 14) THEN c END AS fenshu,
  CASE WHEN category NOT IN (1, 11, 12, 13, 14) THEN a END AS panqianliutong,
  CASE WHEN category NOT IN (1, 11, 12, 13, 14) THEN b END AS qianzongguben,
  CASE WHEN category NOT IN (1, 11, 12, 13, 14) THEN c END AS panhouliutong,
  CASE WHEN category NOT IN (1, 11, 12, 13, 14) THEN d END AS houzongguben
FROM a JOIN (VALUES {NAMES_SQL}) n(k, name) ON k = category""")
def _(spark, d):
    v = F.col("value")
    cat = (F.col("event_id") % 14 + 1).cast("int")
    fields = C.action_fields(F.col("category"), v, v * 2, v * 3, v * 4)
    return V.table(spark, d, "events").withColumn("category", cat).select(
        "event_id", "category", C.action_name(F.col("category")).alias("name"),
        *[c.alias(n) for n, c in fields.items()],
    )


FUND_SQL = """
SELECT l_suppkey AS symbol, sum(l_quantity::BIGINT)::BIGINT AS volume, count(*) AS shares,
  sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cap, sum(round(l_discount * 100)::BIGINT)::BIGINT AS debt,
  sum(round(l_tax * 100)::BIGINT)::BIGINT AS holders, sum(l_orderkey % 9)::BIGINT AS income,
  sum(l_partkey % 5)::BIGINT AS revenue FROM lineitem GROUP BY 1"""
V.VIEW_SQL["fundamentals"] = FUND_SQL


def fundamentals(spark, d):
    pct = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    return V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("volume"), F.count("*").alias("shares"),
        F.sum(V.cents("l_extendedprice")).alias("cap"), pct("l_discount").alias("debt"),
        pct("l_tax").alias("holders"), F.sum(F.col("l_orderkey") % 9).alias("income"),
        F.sum(F.col("l_partkey") % 5).alias("revenue"),
    )


def ratios(df):
    """Turnover, debt/equity, return on equity and price/revenue; bad numbers become null."""
    num = lambda c: F.col(c).try_cast("double")
    return df.withColumns({
        "turnover": F.try_divide(num("volume"), num("shares")),
        "debt_to_equity": F.try_divide(num("debt"), num("holders")),
        "return_on_equity": F.try_divide(num("income"), num("holders")),
        "price_to_revenue": F.try_divide(num("cap"), num("revenue")),
    })


RATIO_SQL = """SELECT *, volume / nullif(shares, 0) AS turnover, debt / nullif(holders, 0) AS debt_to_equity,
  income / nullif(holders, 0) AS return_on_equity, cap / nullif(revenue, 0) AS price_to_revenue FROM fundamentals"""


@query("prj17_fundamental_ratios", f"""
SELECT symbol, round(turnover, 6) AS turnover, round(debt_to_equity, 6) AS debt_to_equity,
  round(return_on_equity, 6) AS return_on_equity, round(price_to_revenue, 4) AS price_to_revenue FROM ({RATIO_SQL})""")
def _(spark, d):
    df = ratios(fundamentals(spark, d))
    return df.select(
        "symbol", *[F.round(c, 6).alias(c) for c in ("turnover", "debt_to_equity", "return_on_equity")],
        F.round("price_to_revenue", 4).alias("price_to_revenue"))


@query("prj18_fundamental_screen", f"""
WITH f AS ({RATIO_SQL}),
q AS (SELECT quantile_cont(volume::DOUBLE, 0.05) AS v05, quantile_cont(turnover, 0.95) AS t95 FROM f)
SELECT symbol, cap, volume FROM f, q WHERE cap > 100000 AND volume > v05 AND turnover < t95
  AND debt_to_equity <= 2 AND return_on_equity >= 0.1 AND income > 0 AND price_to_revenue > 0""")
def _(spark, d):
    df = ratios(fundamentals(spark, d)).withColumn("_k", F.lit(0))
    cuts = (
        exact_percentiles(df, ["_k"], "volume", {"v05": 0.05})
        .join(exact_percentiles(df, ["_k"], "turnover", {"t95": 0.95}), "_k")
    )
    return df.join(F.broadcast(cuts), "_k").where(
        "cap > 100000 and volume > v05 and turnover < t95 and debt_to_equity <= 2 and return_on_equity >= 0.1 "
        "and income > 0 and price_to_revenue > 0"
    ).select("symbol", "cap", "volume")


@query("prj19_packed_clock", """
SELECT o_orderkey, ((n // 2048) + 2004) * 10000 + (n % 2048 // 100) * 100 + n % 2048 % 100 AS day,
  (m // 60) * 100 + m % 60 AS hhmm
FROM (SELECT o_orderkey, o_orderkey % 20 * 2048 + (1 + o_orderkey % 12) * 100 + 1 + o_orderkey % 28 AS n,
      o_orderkey * 7 % 1440 AS m FROM orders)""")
def _(spark, d):
    k = F.col("o_orderkey")
    n = k % 20 * 2048 + (k % 12 + 1) * 100 + 1 + k % 28
    return V.table(spark, d, "orders").select(
        "o_orderkey", C.packed_date(n).alias("day"), C.packed_clock(k * 7 % 1440).alias("hhmm"))


@query("prj20_server_time", """
SELECT o_orderkey, CASE WHEN s // 10000 % 100 < 60
  THEN printf('%d:%02d:%06.3f', s // 1000000, s // 10000 % 100, s % 10000 * 60 / 10000.0)
  ELSE printf('%d:%02d:%06.3f', s // 1000000, s % 1000000 * 60 // 1000000, (s % 1000000 * 60 % 1000000) * 60 / 1000000.0)
  END AS clock
FROM (SELECT o_orderkey, 9000000 + o_orderkey * 48271 % 6000000 AS s FROM orders)""")
def _(spark, d):
    stamp = F.lit(9_000_000) + F.col("o_orderkey") * 48271 % 6_000_000
    return V.table(spark, d, "orders").select("o_orderkey", C.server_time(stamp).alias("clock"))


@query("prj21_levels_long", """
SELECT o_orderkey, i AS level, o_orderkey % 50 + i AS price, o_orderkey * i % 97 AS volume, i * 2 AS orders
FROM orders, range(1, 11) r(i) WHERE o_orderkey * i % 97 > 0""")
def _(spark, d):
    wide = V.table(spark, d, "orders").select("o_orderkey", *[
        c for i in range(1, 11) for c in (
            (F.col("o_orderkey") % 50 + i).alias(f"BidPrice{i}"), (F.col("o_orderkey") * i % 97).alias(f"BidVolume{i}"),
            F.lit(i * 2).cast("bigint").alias(f"BidOrder{i}"))
    ])
    return (
        wide.select("o_orderkey", F.posexplode(C.levels("Bid")).alias("i", "lv"))
        .where("lv.volume > 0")
        .select("o_orderkey", (F.col("i") + 1).cast("bigint").alias("level"), "lv.price", "lv.volume", "lv.orders")
    )


BALANCE_COLUMNS = ["volume", "cap", "debt", "holders", "income", "revenue"]


@query("prj22_balance_units", "SELECT symbol, shares, " + ", ".join(
    f"{c} * 10000 AS {c}" for c in BALANCE_COLUMNS) + " FROM fundamentals")
def _(spark, d):
    return fundamentals(spark, d).select(
        "symbol", "shares", *[(F.col(c) * 10000).alias(c) for c in BALANCE_COLUMNS])


@query("prj23_tickers_in_range", """
SELECT o.o_custkey, o.o_orderkey FROM orders o SEMI JOIN (
  SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) >= TIMESTAMP '2001-05-01'
    AND min(o_orderdate) <= TIMESTAMP '2001-06-30') k USING (o_custkey)""")
def _(spark, d):
    orders = V.table(spark, d, "orders")
    inside = C.tickers_inside(
        orders, ["o_custkey"], "o_orderdate", F.lit("2001-05-01").cast("timestamp_ntz"),
        F.lit("2001-06-30").cast("timestamp_ntz"))
    return orders.join(inside, "o_custkey", "left_semi").select("o_custkey", "o_orderkey")


@query("prj24_volume_spike", """
SELECT symbol, ts, round(ratio, 6) AS ratio FROM (
  SELECT symbol, ts, open, close, volume / lag(volume) OVER (PARTITION BY symbol ORDER BY ts) AS ratio FROM bars_h)
WHERE NOT contains(lower(symbol), 'er') AND close > open AND ratio > 4.5""")
def _(spark, d):
    s = open_series(V.bars_h(spark, d), ["symbol"], ["ts"], "ts div 2592000", back=1)
    s = s.add(ratio=F.col("volume") / s.lag("volume"))
    return s.close().where(
        ~F.contains(F.lower("symbol"), F.lit("er")) & (F.col("close") > F.col("open")) & (F.col("ratio") > 4.5)
    ).select("symbol", "ts", F.round("ratio", 6).alias("ratio"))


@query("prj25_volume_split", """
SELECT symbol, ts, CASE WHEN open < close THEN volume ELSE 0 END AS up_volume,
  CASE WHEN open > close THEN volume ELSE 0 END AS down_volume FROM bars_h""")
def _(spark, d):
    return V.bars_h(spark, d).select(
        "symbol", "ts", C.up_volume().alias("up_volume"), C.down_volume().alias("down_volume"))


@query("prj26_quality_band", """
SELECT event_id, CASE WHEN s < 1.6 THEN 'Poor' WHEN s < 1.9 THEN 'Below average' WHEN s < 2.4 THEN 'Average'
  WHEN s < 2.9 THEN 'Good' WHEN s < 5.0 THEN 'Excellent' WHEN s < 6.9 THEN 'Superb' ELSE 'Holy Grail' END AS band
FROM (SELECT event_id, value / 10 AS s FROM events)""")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", C.quality_band(F.col("value") / 10).alias("band"))


@query("prj27_near_strikes", """
SELECT l_suppkey AS exp, l_orderkey AS contract, l_linenumber AS leg, l_quantity AS strike, l_discount AS mark
FROM lineitem WHERE abs(l_quantity - 25) <= 2""")
def _(spark, d):
    near = V.table(spark, d, "lineitem").where(F.abs(F.col("l_quantity") - 25) <= 2)
    return near.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount").withColumnsRenamed({
        "l_suppkey": "exp", "l_orderkey": "contract", "l_linenumber": "leg", "l_quantity": "strike",
        "l_discount": "mark"}).orderBy("exp", "strike", "contract", "leg", "mark")


@query("prj28_contango", """
SELECT symbol, yr, round(m2 / m1 - 1, 6) AS contango FROM (
  SELECT symbol, t // 12 AS yr, max(close) FILTER (WHERE t % 12 = 0) AS m1, max(close) FILTER (WHERE t % 12 = 1) AS m2
  FROM bars_m GROUP BY 1, 2)""")
def _(spark, d):
    terms = (
        V.bars_m(spark, d).withColumn("month", F.col("t") % 12)
        .groupBy("symbol", F.expr("cast(t div 12 as int)").alias("yr"))
        .pivot("month", [0, 1]).agg(F.max("close"))
    )
    return terms.select("symbol", "yr", F.round(F.try_divide("1", "0") - 1, 6).alias("contango"))


@query("prj29_quality_fix", """
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE adj = 0) AS zero_adjusted, count(*) FILTER (WHERE bad IS NULL) AS nulls,
  sum(CASE WHEN adj = 0 THEN close ELSE adj END)::BIGINT AS repaired, count(*) < 2 AS is_empty
FROM (SELECT symbol, close, CASE WHEN ts % 18000 = 0 THEN 0 ELSE close END AS adj,
      CASE WHEN ts % 25200 = 0 THEN NULL ELSE close END AS bad FROM bars_h) GROUP BY 1""")
def _(spark, d):
    ts = F.col("ts")
    rows = V.bars_h(spark, d).withColumns({
        "adj": F.when(ts % 18000 == 0, 0).otherwise(F.col("close")),
        "bad": F.when(ts % 25200 != 0, F.col("close")),
    })
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.count(F.when(F.abs("adj") <= 1e-8, 1)).alias("zero_adjusted"),
        F.count(F.when(F.col("bad").isNull(), 1)).alias("nulls"),
        F.sum(C.repaired_adjusted_close(F.col("adj"), F.col("close"))).alias("repaired"),
        (F.count("*") < 2).alias("is_empty"),
    )


@query("prj30_span_label", """
SELECT o_custkey, CASE WHEN days > 1826.25 THEN 'Yearly' WHEN days > 365.25 THEN 'Monthly' WHEN days > 50 THEN 'Weekly'
  WHEN days > 5 THEN 'Daily' WHEN days > 0.5 THEN 'Hourly' WHEN days > 0.05 THEN 'Per 15 Min' ELSE 'Per minute' END AS span
FROM (SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days FROM orders GROUP BY 1)""")
def _(spark, d):
    span = V.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.datediff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")).alias("days"))
    return span.select("o_custkey", C.span_label(F.col("days")).alias("span"))
