"""Indicator queries on hourly bars."""

from pyspark.sql import functions as F

from tidemark.functions.series import POS, number_rows, open_series, running
from tidemark.operators import indicators as I
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.queries_flow import rounded
from tidemark.session import stage

K, T, MONTH = ["symbol"], ["ts"], "ts div 2592000"
V.VIEW_SQL["pb"] = """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos, (high + 2 * open + 2 * close + low) / 6 AS ohlc FROM bars_h"""


def series(spark, d, back, forward=0):
    return open_series(stage(V.bars_h(spark, d)), K, T, MONTH, back, forward)


def out(s, *cols, n=6):
    return rounded(s.close().select("symbol", "ts", *cols), n)


@query("wn01_rolling", """
SELECT symbol, ts, CASE WHEN pos >= 20 THEN round(avg(close) OVER w, 6) END AS sma,
  CASE WHEN pos >= 20 THEN round(stddev_samp(close) OVER w, 6) END AS std,
  CASE WHEN pos >= 20 THEN max(high) OVER w END AS hi, CASE WHEN pos >= 20 THEN min(low) OVER w END AS lo
FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)""")
def _(spark, d):
    s = series(spark, d, 20)
    return out(s.add(sma=s.sma("close", 20), std=s.std("close", 20), hi=s.high("high", 20), lo=s.low("low", 20)),
               "sma", "std", "hi", "lo")


SPANS = [5, 10, 20, 60, 120]


def ema_sql(col, spans, source="pb", extra="", name="close"):
    sma = ", ".join(f"avg({col}) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING) AS s{n}" for n in spans)
    init = ", ".join(f"CASE WHEN 1 = {n} THEN s{n} END::DOUBLE AS e{n}" for n in spans)
    step = ", ".join(
        f"CASE WHEN b.pos = {n} THEN b.s{n} WHEN b.pos > {n} THEN {2 / (n + 1)!r}::DOUBLE * b.x + {1 - 2 / (n + 1)!r}::DOUBLE * r.e{n} END"
        for n in spans)
    return (f"WITH RECURSIVE b AS (SELECT symbol, ts, pos, {col}::DOUBLE AS x, {sma} FROM {source}),\n"
            f"r AS (SELECT symbol, ts, pos, {init} FROM b WHERE pos = 1 UNION ALL\n"
            f"SELECT b.symbol, b.ts, b.pos, {step} FROM r JOIN b ON b.symbol = r.symbol AND b.pos = r.pos + 1)")


@query("wn02_ema", ema_sql("close", SPANS) + " SELECT symbol, ts, " + ", ".join(
    f"round(e{n}, 5) AS ema_{n}" for n in SPANS) + " FROM r")
def _(spark, d):
    e = I.emas(V.bars_h(spark, d), K, T, MONTH, "close", SPANS)
    return rounded(e.select("symbol", "ts", *[f"ema_{n}" for n in SPANS]), 5)


@query("wn03_macd", ema_sql("close", [12, 26]) + """,
m AS (SELECT symbol, ts, pos, e12 - e26 AS x, avg(e12 - e26) OVER (PARTITION BY symbol ORDER BY ts ROWS 8 PRECEDING) AS s FROM r),
g AS (SELECT symbol, ts, pos, x, NULL::DOUBLE AS sig FROM m WHERE pos = 33 UNION ALL
  SELECT m.symbol, m.ts, m.pos, m.x, CASE WHEN m.pos = 34 THEN m.s ELSE 0.2::DOUBLE * m.x + 0.8::DOUBLE * g.sig END
  FROM g JOIN m ON m.symbol = g.symbol AND m.pos = g.pos + 1)
SELECT m.symbol, m.ts, round(m.x, 5) AS macd, round(sig, 5) AS signal,
  CASE WHEN m.x - sig > 0 AND lag(m.x - sig) OVER w <= 0 THEN 1 WHEN m.x - sig < 0 AND lag(m.x - sig) OVER w >= 0 THEN -1 ELSE 0 END AS cross_sign
FROM m LEFT JOIN g USING (symbol, pos) WINDOW w AS (PARTITION BY m.symbol ORDER BY m.pos)""")
def _(spark, d):
    m = I.macd(V.bars_h(spark, d), K, T, MONTH)
    return rounded(m.select("symbol", "ts", "macd", "signal", F.col("cross").alias("cross_sign")), 5)


V.VIEW_SQL["trs"] = """
SELECT *, CASE WHEN pos > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM pb)"""


def atr_sql(n):
    return f"""WITH RECURSIVE b AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING) AS s FROM trs),
r AS (SELECT symbol, ts, pos, tr, NULL::DOUBLE AS atr FROM b WHERE pos = 1 UNION ALL
  SELECT b.symbol, b.ts, b.pos, b.tr, CASE WHEN b.pos = {n + 1} THEN b.s WHEN b.pos > {n + 1} THEN b.tr / {n} + r.atr * {1 - 1 / n!r}::DOUBLE END
  FROM r JOIN b ON b.symbol = r.symbol AND b.pos = r.pos + 1)"""


@query("wn04_atr", atr_sql(14) + " SELECT symbol, ts, tr, round(atr, 5) AS atr FROM r")
def _(spark, d):
    return rounded(I.atr(V.bars_h(spark, d), K, T, MONTH, 14).select("symbol", "ts", "tr", "atr"), 5)


@query("wn05_mfi", """
WITH a AS (SELECT *, high + low + close AS tp FROM pb),
b AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY ts) AS ptp FROM a),
c AS (SELECT symbol, ts, pos, sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER w AS up,
  sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER w AS dn
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING))
SELECT symbol, ts, CASE WHEN pos >= 15 THEN round(coalesce(up / nullif(up + dn, 0), 0) * 100, 6) END AS mfi FROM c""")
def _(spark, d):
    return out(I.mfi(series(spark, d, 15)), "mfi")


@query("wn06_stochastic", """
WITH a AS (SELECT symbol, ts, pos, close, CASE WHEN pos >= 14 THEN (close - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) * 100 END AS k,
  CASE WHEN pos >= 15 THEN avg(tr) OVER w END AS atr FROM trs WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)),
b AS (SELECT *, CASE WHEN pos >= 16 THEN avg(k) OVER (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING) END AS d FROM a)
SELECT symbol, ts, round(k, 6) AS k, round(d, 6) AS d, round(atr, 5) AS atr,
  coalesce(k < 20 AND k > d AND atr / close > 0.02, false) AS entry, coalesce(k > 80, false) AS exit FROM b""")
def _(spark, d):
    s = I.stochastic(series(spark, d, 32))
    df = s.close().select("symbol", "ts", "k", "d", "atr", "entry", "exit")
    return rounded(df, 6, skip=("atr",)).withColumn("atr", F.round("atr", 5))


@query("wn07_changes", """
SELECT symbol, ts, round(close / lag(close) OVER w - 1, 6) AS pct, round((close / lag(close, 10) OVER w - 1) * 100, 6) AS roc10,
  close - lag(close) OVER w AS diff, round(open / lag(close) OVER w - 1, 6) AS overnight
FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    s = series(spark, d, 10)
    return out(s.add(pct=s.pct("close"), roc10=s.pct("close", 10) * 100, diff=F.col("close") - s.lag("close"),
                     overnight=F.col("open") / s.lag("close") - 1), "pct", "roc10", "diff", "overnight")


@query("wn08_volume_ratio", """
SELECT symbol, ts, CASE WHEN pos > 5 THEN round(volume / avg(volume) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) END AS ratio,
  CASE WHEN pos >= 10 THEN round(avg(volume) OVER (w ROWS 2 PRECEDING) / avg(volume) OVER (w ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING), 6) END AS surge
FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    s = series(spark, d, 10)
    return out(s.add(
        ratio=s.full(F.col("volume") / F.avg("volume").over(s.rows(-5, -1)), 5, 1),
        surge=s.full(F.avg("volume").over(s.last(3)) / F.avg("volume").over(s.rows(-9, -3)), 10)), "ratio", "surge")


@query("wn09_vcp", """
WITH a AS (SELECT *, (high - low) / low AS v FROM pb),
b AS (SELECT symbol, ts, pos, close, v, CASE WHEN pos >= 10 THEN avg(v) OVER w END AS r, CASE WHEN pos >= 10 THEN stddev_samp(v) OVER w END AS s,
  CASE WHEN pos >= 10 THEN max(high) OVER w END AS hh FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING)),
c AS (SELECT *, lag(r, 10) OVER w AS r0, lag(s, 10) OVER w AS s0, lag(hh) OVER w AS pivot_high FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, round(r, 6) AS vcp_range, round(s, 6) AS vcp_std, pivot_high,
  coalesce(r < r0 * 0.9 AND s < s0 * 0.9 AND close > pivot_high, false) AS vcp_signal FROM c""")
def _(spark, d):
    return out(I.vcp(series(spark, d, 20), 10, 0.9), "vcp_range", "vcp_std", "pivot_high", "vcp_signal")


@query("wn10_range_contraction", """
WITH a AS (SELECT symbol, ts, pos, close, CASE WHEN pos >= 20 THEN (max(high) OVER w - min(low) OVER w) / min(low) OVER w END AS pr,
  CASE WHEN pos >= 20 THEN max(high) OVER w END AS hh FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
b AS (SELECT *, CASE WHEN pos >= 79 THEN avg(pr) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING) END AS m,
  lag(hh) OVER (PARTITION BY symbol ORDER BY ts) AS ph FROM a),
c AS (SELECT *, coalesce(pr < m * 0.6, false) AS contracted FROM b)
SELECT symbol, ts, round(pr, 5) AS price_range, contracted, coalesce(close > ph, false) AS breakout,
  coalesce(lag(contracted) OVER (PARTITION BY symbol ORDER BY ts), false) AS after_contraction FROM c""")
def _(spark, d):
    return out(I.range_contraction(series(spark, d, 100)), "price_range", "contracted", "breakout", "after_contraction", n=5)


V.VIEW_SQL["trendline"] = """
WITH a AS (SELECT symbol, ts, pos, ohlc, """ + ", ".join(
    f"CASE WHEN pos >= {n} THEN ln(avg(ohlc) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)) END AS l{n}" for n in (5, 10, 20)
) + """ FROM pb),
b AS (SELECT symbol, ts, pos, """ + ", ".join(
    f"CASE WHEN pos >= {n + 4} THEN regr_slope(l{n}, pos) OVER w * 10 END AS s{n}" for n in (5, 10, 20)
) + """, CASE WHEN pos >= 5 THEN CASE WHEN max(ohlc) OVER w > min(ohlc) OVER w THEN regr_r2(ohlc, pos) OVER w ELSE 0 END END AS r2
  FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING))
SELECT *, 0.4::DOUBLE * s5 + 0.2::DOUBLE * s10 + 0.4::DOUBLE * s20 AS avg_slope FROM b"""


def trend(spark, d):
    s = series(spark, d, 40)
    return I.sector_trend(s.add(ohlc=(F.col("high") + 2 * F.col("open") + 2 * F.col("close") + F.col("low")) / 6))


@query("wn13_log_slope", """
SELECT symbol, ts, round(s5, 6) AS slope_5, round(s10, 6) AS slope_10, round(s20, 6) AS slope_20 FROM trendline""")
def _(spark, d):
    return out(trend(spark, d), "slope_5", "slope_10", "slope_20")


@query("wn14_rolling_r2", "SELECT symbol, ts, round(r2, 6) AS r2 FROM trendline")
def _(spark, d):
    return out(trend(spark, d), "r2")


@query("wn15_trending_sectors", """
SELECT symbol, ts, round(avg_slope, 6) AS avg_slope, row_number() OVER (PARTITION BY ts ORDER BY round(avg_slope, 6) DESC, symbol) AS rnk
FROM trendline WHERE degrees(atan(15 * r2 * avg_slope)) > 5 AND s20 > 0.001""")
def _(spark, d):
    chosen = stage(rounded(trend(spark, d).close().where("selected").select("symbol", "ts", "avg_slope")))
    ordered = chosen.withColumn("_down", -F.col("avg_slope"))
    # Steps of the slope are numbered one by one, so a time with very many sectors is not sorted in one task.
    ranks = number_rows(ordered, ["ts"], ["_down", "symbol"], "cast(floor(_down * 1000) as bigint)")
    return ranks.select("symbol", "ts", "avg_slope", F.col(POS).alias("rnk"))


@query("wn19_convergence", """
WITH a AS (SELECT symbol, ts, pos, """ + ", ".join(
    f"CASE WHEN pos >= {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING) END AS m{n}" for n in (5, 10, 20)
) + """ FROM pb),
b AS (SELECT *, (m5 + m10 + m20) / 3 AS mean FROM a),
c AS (SELECT *, sqrt((pow(m5 - mean, 2) + pow(m10 - mean, 2) + pow(m20 - mean, 2)) / 2) / mean * 100 AS conv,
  sqrt((pow(m5 - mean, 2) + pow(m10 - mean, 2) + pow(m20 - mean, 2)) / 3) / (mean + 1e-9) * 100 AS pconv FROM b),
e AS (SELECT *, CASE WHEN pos >= 23 THEN avg(conv) OVER (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING) END AS a4 FROM c)
SELECT symbol, ts, round(conv, 6) AS conv, round(pconv, 6) AS pop_conv,
  round(lag(a4, 2) OVER (PARTITION BY symbol ORDER BY ts), 6) AS avg_conv FROM e""")
def _(spark, d):
    s = I.convergence(series(spark, d, 32), "close", [5, 10, 20])
    s = s.add(pop_conv=I.row_cv(["ma_5", "ma_10", "ma_20"], 1e-9, True), _a=s.full(F.avg("conv").over(s.last(4)), 23))
    return out(s.add(avg_conv=s.lag("_a", 2)), "conv", "pop_conv", "avg_conv")


@query("wn24_ma_alignment", ema_sql("close", [20, 60, 120]) + """,
s AS (SELECT symbol, ts, pos, close, """ + ", ".join(
    f"CASE WHEN pos >= {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING) END AS m{n}" for n in (5, 10, 20, 30)
) + """ FROM pb)
SELECT s.symbol, s.ts, coalesce(m5 > m10 AND m10 > m20 AND m20 > m30, false) AS bull,
  coalesce(close > e20 AND e20 > e60 AND e60 > e120 AND close < e20 * 1.15::DOUBLE, false) AS ema_bull
FROM s JOIN r USING (symbol, pos)""")
def _(spark, d):
    e = I.emas(V.bars_h(spark, d), K, T, MONTH, "close", [20, 60, 120])
    s = open_series(e, K, T, MONTH, 30)
    s = s.add(**{f"ma_{n}": s.sma("close", n) for n in (5, 10, 20, 30)})
    bull = (F.col("ma_5") > F.col("ma_10")) & (F.col("ma_10") > F.col("ma_20")) & (F.col("ma_20") > F.col("ma_30"))
    c, e20 = F.col("close"), F.col("ema_20")
    ema_bull = (c > e20) & (e20 > F.col("ema_60")) & (F.col("ema_60") > F.col("ema_120")) & (c < e20 * 1.15)
    return out(s.add(bull=F.coalesce(bull, F.lit(False)), ema_bull=F.coalesce(ema_bull, F.lit(False))), "bull", "ema_bull")


@query("wn26_donchian", "SELECT symbol, ts, " + ", ".join(
    f"CASE WHEN pos >= {n} THEN max(high) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING) END AS upper_{n}, "
    f"CASE WHEN pos >= {n} THEN min(low) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING) END AS lower_{n}" for n in (10, 20, 55)
) + """, coalesce(pos >= 20 AND close > max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), false) AS breakout
FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    s = series(spark, d, 55)
    cols = {k: v for n in (10, 20, 55) for k, v in I.donchian(s, n).items()}
    s = s.add(**cols)
    return out(s.add(breakout=F.coalesce(F.col("close") > F.col("upper_20"), F.lit(False))), *cols, "breakout")


@query("wn27_trend_line", """
SELECT symbol, ts, CASE WHEN pos >= 20 THEN round(regr_slope(close, pos) OVER w, 4) END AS slope,
  CASE WHEN pos >= 20 THEN round(regr_intercept(close, pos) OVER w + regr_slope(close, pos) OVER w * pos, 3) END AS fitted
FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)""")
def _(spark, d):
    s = series(spark, d, 20)
    s = s.add(**I.trend_line(s, "close", 20))
    return s.close().select("symbol", "ts", F.round("slope", 4).alias("slope"), F.round("fitted", 3).alias("fitted"))


@query("wn28_cross_over", """
WITH a AS (SELECT symbol, ts, CASE WHEN pos >= 10 THEN avg(close) OVER (w ROWS 4 PRECEDING) - avg(close) OVER (w ROWS 9 PRECEDING) END AS g
  FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, CASE WHEN g > 0 AND lag(g) OVER w <= 0 THEN 1 WHEN g < 0 AND lag(g) OVER w >= 0 THEN -1 ELSE 0 END AS cross_sign
FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    s = series(spark, d, 11)
    s = s.add(_gap=s.full(s.sma("close", 5) - s.sma("close", 10), 10))
    return out(s.add(cross_sign=I.crossing(s, "_gap")), "cross_sign")


@query("wn36_forward_fill", """
WITH b AS (SELECT symbol, t, CASE WHEN symbol % 5 = t % 7 THEN NULL ELSE close END AS close FROM bars_m),
d AS (SELECT DISTINCT t FROM b WHERE close IS NOT NULL), k AS (SELECT DISTINCT symbol FROM b)
SELECT symbol, t, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS close
FROM d CROSS JOIN k LEFT JOIN b USING (symbol, t)""")
def _(spark, d):
    from tidemark.operators.panel import forward_fill
    bars = V.bars_m(spark, d).select("symbol", "t", F.when(F.col("symbol") % 5 != F.col("t") % 7, F.col("close")).alias("close"))
    return forward_fill(bars, "symbol", "t", "close", "t div 24")


@query("wn37_interpolate", """
WITH b AS (SELECT symbol, ts, CASE WHEN pos % 5 IN (1, 2) THEN NULL ELSE close END AS x FROM pb),
c AS (SELECT symbol, ts, x, last_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS t0, last_value(x IGNORE NULLS) OVER w AS x0,
  first_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER v AS t1, first_value(x IGNORE NULLS) OVER v AS x1 FROM b
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
         v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, ts, round(CASE WHEN x IS NOT NULL OR x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * ((ts - t0) / (t1 - t0)) END, 6) AS close FROM c""")
def _(spark, d):
    from tidemark.operators.panel import interpolate
    from tidemark.functions.series import POS, number_rows
    rows = number_rows(V.bars_h(spark, d), K, T, MONTH)
    gaps = rows.select("symbol", "ts", F.when(~(F.col(POS) % 5).isin(1, 2), F.col("close")).alias("close"))
    return rounded(interpolate(gaps, "symbol", "ts", "close", MONTH))


@query("wn38_delta_decode", """
WITH x AS (SELECT event_id, event_type, ts, user_id % 21 - 10 AS o, event_id % 15 - 7 AS c FROM events)
SELECT event_id, (coalesce(sum(o + c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + o) / 1000 AS open,
  sum(o + c) OVER (w ROWS UNBOUNDED PRECEDING) / 1000 AS close
FROM x WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def _(spark, d):
    from tidemark.operators.panel import decode_bar_deltas
    rows = V.table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("symbol"), V.micros("ts").alias("ts"),
        (F.col("user_id") % 21 - 10).alias("open_d"), (F.col("event_id") % 15 - 7).alias("close_d"))
    return decode_bar_deltas(rows, ["symbol"], ["ts"], "ts div 86400000000", 1000).select("event_id", "open", "close")


@query("wn38_tick_delta_decode", """
SELECT event_id, sum(user_id % 21 - 10) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) / 100 AS price FROM events""")
def _(spark, d):
    from tidemark.operators.panel import decode_tick_deltas
    rows = V.table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("symbol"), V.micros("ts").alias("ts"), (F.col("user_id") % 21 - 10).alias("delta"))
    return decode_tick_deltas(rows, ["symbol"], ["ts"], "ts div 86400000000", 100).select("event_id", "price")


@query("wn39_log_returns", """
SELECT symbol, ts, round(ln(close / lag(close) OVER w), 6) AS log_return,
  round(close / first_value(close) OVER w - 1, 5) AS cum_return FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    s = series(spark, d, 1)
    rows = s.add(log_return=I.log_return(s)).close(keep_pos=True)
    curve = running(rows, K, T, MONTH, {"_sum": ("sum", F.coalesce("log_return", F.lit(0.0)))})
    return curve.select("symbol", "ts", F.round("log_return", 6).alias("log_return"), F.round(F.exp("_sum") - 1, 5).alias("cum_return"))
