"""Bar queries."""

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.plans import views as V
from tidemark.plans.catalog import query

DAY_US = 86_400_000_000


@query("ag02_bars_hour", "SELECT * FROM bars_h WHERE volume > 0")
def _(spark, d):
    return V.bars_h(spark, d)


@query("ag02_bars_multi", """
SELECT symbol, freq, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, seq) AS close, sum(volume)::BIGINT AS volume, sum(price * volume)::BIGINT AS turnover
FROM (SELECT *, '30min' AS freq, ((ts_us + 1799999999) // 1800000000) * 1800 AS ts FROM ticks
      UNION ALL SELECT *, '1min', ((ts_us + 59999999) // 60000000) * 60 FROM ticks
      UNION ALL SELECT *, '1d', (ts_us // 86400000000) * 86400 FROM ticks)
GROUP BY ALL HAVING sum(volume) > 0""")
def _(spark, d):
    return B.all_bars(V.ticks(spark, d), ["symbol"], "ts_us", "seq", ["1min", "30min", "1d"])


@query("ag03_rebar_week", """
SELECT symbol, ((ts - 1) // 604800) * 604800 AS week, arg_min(open, ts) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume
FROM bars_h GROUP BY 1, 2""")
def _(spark, d):
    return B.rebar(V.bars_h(spark, d), ["symbol"], "ts", F.expr("((ts - 1) div 604800) * 604800"), "week")


@query("ag03_rebar_calendar", """
SELECT symbol, t // 3 AS quarter, arg_min(open, t) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, t) AS close, sum(volume)::BIGINT AS volume
FROM bars_m GROUP BY 1, 2""")
def _(spark, d):
    return B.rebar(V.bars_m(spark, d), ["symbol"], "t", F.expr("cast(t div 3 as int)"), "quarter")


@query("jn09_reconcile_bars", """
WITH src AS (SELECT symbol, ts, open, high, low, close FROM bars_h WHERE ts % 25200 <> 0),
dst AS (SELECT symbol, ts, open / 100 AS open, (high + CASE WHEN ts % 18000 = 0 THEN 1 ELSE 0 END) / 100 AS high,
               low / 100 AS low, close / 100 AS close FROM bars_h WHERE ts % 28800 <> 0)
SELECT symbol, ts, 'only_mine' AS problem FROM src ANTI JOIN dst USING (symbol, ts)
UNION ALL SELECT symbol, ts, 'only_theirs' FROM dst ANTI JOIN src USING (symbol, ts)
UNION ALL SELECT symbol, ts, 'open' FROM src JOIN dst USING (symbol, ts) WHERE src.open <> round_even(dst.open * 100, 0)
UNION ALL SELECT symbol, ts, 'high' FROM src JOIN dst USING (symbol, ts) WHERE src.high <> round_even(dst.high * 100, 0)
UNION ALL SELECT symbol, ts, 'low' FROM src JOIN dst USING (symbol, ts) WHERE src.low <> round_even(dst.low * 100, 0)
UNION ALL SELECT symbol, ts, 'close' FROM src JOIN dst USING (symbol, ts) WHERE src.close <> round_even(dst.close * 100, 0)
""")
def _(spark, d):
    bars = V.bars_h(spark, d)
    bump = F.when(F.col("ts") % 18000 == 0, 1).otherwise(0)
    theirs = bars.where("ts % 28800 <> 0").select(
        "symbol", "ts", (F.col("open") / 100).alias("open"), ((F.col("high") + bump) / 100).alias("high"),
        (F.col("low") / 100).alias("low"), (F.col("close") / 100).alias("close"),
    )
    return B.reconcile(bars.where("ts % 25200 <> 0"), theirs, ["symbol", "ts"])
