"""Screen, grid, exit and weight queries on monthly bars."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.series import POS, number_rows, open_series, running
from tidemark.operators import indicators as I
from tidemark.operators import screens as S
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.queries_flow import rounded
from tidemark.session import stage

K, T, YEARS = ["symbol"], ["t"], "t div 24"
V.VIEW_SQL["pm"] = """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS pos, (high + 2 * open + 2 * close + low) / 6 AS ohlc FROM bars_m"""
V.VIEW_SQL["sb"] = "SELECT *, row_number() OVER (PARTITION BY sector ORDER BY t) AS pos FROM sector_bars"


def stocks(spark, d, back):
    ohlc = (F.col("high") + 2 * F.col("open") + 2 * F.col("close") + F.col("low")) / 6
    return open_series(stage(V.bars_m(spark, d)).withColumn("ohlc", ohlc), K, T, YEARS, back)


def sector_series(spark, d, back):
    return open_series(stage(V.sector_bars(spark, d)), ["sector"], T, YEARS, back)


def avg_rank(col, n="count(*) OVER ()"):
    return f"((rank() OVER (ORDER BY {col})) + (count(*) OVER (PARTITION BY {col}) - 1) / 2) / ({n})"


@query("wn11_rps_change", f"""
WITH a AS (SELECT sector, t, pos, round((close / lag(close, 11) OVER w - 1) * 100, 9) AS rn,
  round((lag(close, 6) OVER w / lag(close, 17) OVER w - 1) * 100, 9) AS rp, row_number() OVER (PARTITION BY sector ORDER BY t DESC) AS rd
  FROM sb WINDOW w AS (PARTITION BY sector ORDER BY t)),
b AS (SELECT * FROM a WHERE rd = 1 AND pos >= 18),
c AS (SELECT sector, {avg_rank('rn')} * 100 AS now, {avg_rank('rp')} * 100 AS prev FROM b)
SELECT sector, round(prev, 6) AS rps_prev, round(now, 6) AS rps_now, round(now - prev, 6) AS rps_change FROM c""")
def _(spark, d):
    out = S.relative_strength_change(sector_series(spark, d, 18), "sector", "t", 12, 6)
    return rounded(out).orderBy(F.desc("rps_change"), "sector")


def momentum_sql(src, key, period, weights):
    m = " + ".join(f"(close / lag(close, {n - 1}) OVER w - 1) * {w}::DOUBLE" for n, w in weights.items())
    return f"""SELECT {key}, t, close, pos, CASE WHEN pos >= {period} THEN {m} END AS momentum,
  CASE WHEN pos >= {period} THEN regr_r2(ln(close), pos) OVER (w ROWS {period - 1} PRECEDING) END AS r2
  FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY t)"""


V.VIEW_SQL["quality_m"] = momentum_sql("pm", "symbol", 24, {20: 0.7, 24: 0.3})
V.VIEW_SQL["sector_q"] = momentum_sql("sb", "sector", 24, {10: 0.5, 20: 0.3, 24: 0.2})
V.VIEW_SQL["theme_q"] = momentum_sql(
    "(SELECT theme, t, sum(close)::DOUBLE / count(*) AS close, row_number() OVER (PARTITION BY theme ORDER BY t) AS pos"
    " FROM bars_m JOIN sectors USING (symbol) GROUP BY 1, 2)", "theme", 24, {20: 0.7, 24: 0.3})


@query("wn12_momentum_quality", """
SELECT symbol, t, round(momentum, 6) AS momentum, round(r2, 6) AS r2, round(momentum * r2, 6) AS score FROM quality_m""")
def _(spark, d):
    s = S.momentum_quality(stocks(spark, d, 24), 24, {20: 0.7, 24: 0.3})
    return rounded(s.close().select("symbol", "t", "momentum", "r2", "score"))


def sector_scores(spark, d):
    s = S.momentum_quality(sector_series(spark, d, 24), 24, {10: 0.5, 20: 0.3, 24: 0.2})
    return S.latest(s.close().select("sector", "t", "score"), ["sector"], "t")


def theme_scores(spark, d):
    bars = V.bars_m(spark, d).join(V.sectors(spark, d), "symbol").groupBy("theme", "t").agg(
        (F.sum("close") / F.count("close")).alias("close"))
    s = S.momentum_quality(open_series(bars, ["theme"], T, YEARS, 24), 24, {20: 0.7, 24: 0.3})
    return S.latest(s.close().select("theme", "t", "score"), ["theme"], "t")


@query("tk02_top_sectors", """
SELECT sector, round(momentum * r2, 6) AS score FROM sector_q
QUALIFY row_number() OVER (PARTITION BY sector ORDER BY t DESC) = 1 ORDER BY momentum * r2 DESC, sector LIMIT 10""")
def _(spark, d):
    best = S.top(sector_scores(spark, d), 10, F.desc("score"), F.asc("sector"))
    return best.select("sector", F.round("score", 6).alias("score"))


V.VIEW_SQL["last_sector"] = """
SELECT sector, momentum * r2 AS score FROM sector_q QUALIFY row_number() OVER (PARTITION BY sector ORDER BY t DESC) = 1"""
V.VIEW_SQL["last_theme"] = """
SELECT theme, momentum * r2 AS score FROM theme_q QUALIFY row_number() OVER (PARTITION BY theme ORDER BY t DESC) = 1"""


@query("jn20_resonance", """
WITH i AS (SELECT sector FROM last_sector ORDER BY score DESC, sector LIMIT 15),
c AS (SELECT theme FROM last_theme ORDER BY score DESC, theme LIMIT 3),
q AS (SELECT symbol, close, momentum, r2, avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS 11 PRECEDING) AS ma,
  row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS rd FROM quality_m)
SELECT symbol, sector, theme, round(r2, 3) AS r2, round(momentum, 4) AS momentum
FROM q JOIN sectors USING (symbol) WHERE rd = 1 AND r2 >= 0.01 AND close > ma
  AND sector IN (SELECT sector FROM i) AND theme IN (SELECT theme FROM c)""")
def _(spark, d):
    industries = S.top(sector_scores(spark, d), 15, F.desc("score"), F.asc("sector"))
    themes = S.top(theme_scores(spark, d), 3, F.desc("score"), F.asc("theme"))
    s = S.momentum_quality(stocks(spark, d, 24), 24, {20: 0.7, 24: 0.3})
    s = s.add(ma=F.avg("close").over(s.last(12)))
    last = S.latest(s.close().select("symbol", "t", "close", "momentum", "r2", "ma"), K, "t")
    return (
        last.where("r2 >= 0.01 and close > ma").join(V.sectors(spark, d), "symbol")
        .join(industries, "sector", "left_semi").join(themes, "theme", "left_semi")
        .select("symbol", "sector", "theme", F.round("r2", 3).alias("r2"), F.round("momentum", 4).alias("momentum"))
        .orderBy(F.desc("r2"), F.desc("momentum"), "symbol")
    )


@query("jn08_relative_strength", """
WITH j AS (SELECT b.symbol, b.t, b.close, x.close AS sc FROM bars_m b JOIN sectors USING (symbol) JOIN sector_bars x USING (sector, t)),
a AS (SELECT *, close / sc AS rs, row_number() OVER w AS pos, close / lag(close, 20) OVER w - sc / lag(sc, 20) OVER w AS ex
  FROM j WINDOW w AS (PARTITION BY symbol ORDER BY t)),
b AS (SELECT *, CASE WHEN pos >= 5 THEN avg(rs) OVER (PARTITION BY symbol ORDER BY t ROWS 4 PRECEDING) END AS m FROM a)
SELECT symbol, t, round(rs, 6) AS rs, round(ex, 6) AS excess,
  round(ex * 100 * CASE WHEN m > lag(m, 4) OVER (PARTITION BY symbol ORDER BY t) THEN 1.2 ELSE 0.8 END, 4) AS score FROM b""")
def _(spark, d):
    sector = V.sector_bars(spark, d).select("sector", "t", F.col("close").alias("sector_close"))
    rows = V.bars_m(spark, d).join(V.sectors(spark, d), "symbol").join(sector, ["sector", "t"])
    s = S.sector_relative(open_series(rows, K, T, YEARS, 24), 20, 5)
    return s.close().select("symbol", "t", F.round("rs", 6).alias("rs"), F.round("excess", 6).alias("excess"),
                            F.round("score", 4).alias("score"))


IGNITE = S.Ignition(spans=(3, 5, 8), conv_limit=60, day_gain=0.02, total_gain=0.10, volume_gain=0.8, min_rows=20)
V.VIEW_SQL["ig"] = """
WITH a AS (SELECT *, CASE WHEN pos >= 3 THEN avg(ohlc) OVER (w ROWS 2 PRECEDING) END AS m3, CASE WHEN pos >= 5 THEN avg(ohlc) OVER (w ROWS 4 PRECEDING) END AS m5,
    CASE WHEN pos >= 8 THEN avg(ohlc) OVER (w ROWS 7 PRECEDING) END AS m8, ohlc / lag(ohlc) OVER w - 1 AS pct,
    close / lag(open, 2) OVER w - 1 AS gain, avg(volume) OVER (w ROWS 2 PRECEDING) AS v3, avg(volume) OVER (w ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) AS v7,
    CASE WHEN pos >= 5 THEN avg(high - low) OVER (w ROWS 4 PRECEDING) END AS atr
  FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY t)),
b AS (SELECT *, sqrt((pow(m3 - (m3 + m5 + m8) / 3, 2) + pow(m5 - (m3 + m5 + m8) / 3, 2) + pow(m8 - (m3 + m5 + m8) / 3, 2)) / 2) / ((m3 + m5 + m8) / 3) * 100 AS conv FROM a),
c AS (SELECT *, CASE WHEN pos >= 11 THEN avg(conv) OVER (PARTITION BY symbol ORDER BY t ROWS 3 PRECEDING) END AS ac,
  min(pct) OVER u AS mn, max(pct) OVER u AS mx, sum(pct) OVER u AS sm FROM b WINDOW u AS (PARTITION BY symbol ORDER BY t ROWS 2 PRECEDING))
SELECT *, lag(ac, 2) OVER w AS avg_conv, m8 > lag(m8) OVER w AS rise FROM c WINDOW w AS (PARTITION BY symbol ORDER BY t)"""


@query("wn20_ignition", """
WITH r AS (SELECT symbol, t, close, low, high, pos, atr, avg_conv, max(ohlc) OVER w AS mo, max(high) OVER w AS mh,
  coalesce(pos >= 20 AND avg_conv < 60 AND mn > 0 AND mx > 0.02 AND gain > 0.1 AND v3 > v7 * 0.8 AND rise AND close > m8, false) AS hit
  FROM ig WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 9 PRECEDING)),
q AS (SELECT *, CASE WHEN pos >= 10 THEN mo END - atr * 0.5 AS stop, lag(CASE WHEN pos >= 10 THEN mh END) OVER (PARTITION BY symbol ORDER BY t) AS pivot_high FROM r)
SELECT symbol, t, close, round(stop, 4) AS stop, round((close - stop) / close * 100, 4) AS risk_pct, round((high - low) / low, 6) AS amplitude,
  pivot_high, round(avg_conv, 4) AS avg_conv FROM q WHERE hit""")
def _(spark, d):
    s = stocks(spark, d, 40)
    s = s.add(_range=F.col("high") - F.col("low"))
    s = s.add(atr=s.sma("_range", 5))
    s = S.ignition_report(S.ignition(s, IGNITE), 10, 0.5)
    r4 = lambda c: F.round(c, 4).alias(c)
    return s.close().where("ignited").select(
        "symbol", "t", "close", r4("stop"), r4("risk_pct"), F.round("amplitude", 6).alias("amplitude"), "pivot_high", r4("avg_conv"))


@query("wn21_early_pattern", """
WITH a AS (SELECT *, """ + ", ".join(
    f"CASE WHEN pos >= {n} THEN avg(close) OVER (w ROWS {n - 1} PRECEDING) END AS m{n}" for n in (4, 8, 12)
) + """, close / lag(close) OVER w - 1 AS pct, close / lag(close, 3) OVER w - 1 AS gain,
  CASE WHEN pos >= 10 THEN avg(volume) OVER (w ROWS 2 PRECEDING) / avg(volume) OVER (w ROWS 9 PRECEDING) END AS vm
  FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY t)),
b AS (SELECT *, sqrt((pow(m4 - (m4 + m8 + m12) / 3, 2) + pow(m8 - (m4 + m8 + m12) / 3, 2) + pow(m12 - (m4 + m8 + m12) / 3, 2)) / 2) / ((m4 + m8 + m12) / 3) AS cv FROM a),
c AS (SELECT *, CASE WHEN pos >= 19 THEN avg(cv) OVER (w ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING) END AS cb,
  min(pct) OVER (w ROWS 2 PRECEDING) AS mn, max(pct) OVER (w ROWS 2 PRECEDING) AS mx, m4 > lag(m4) OVER w AS rise
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, round(cb, 4) AS conv_before, round(gain, 4) AS gain, round(vm, 2) AS volume_multiple,
  coalesce(cb < 0.6 AND mn > 0 AND mx > 0.05 AND gain > 0.1 AND vm > 0.9 AND rise AND close > m4, false) AS triggered FROM c""")
def _(spark, d):
    s = S.early_pattern(stocks(spark, d, 24), (4, 8, 12), 0.6, 0.05, 0.10, 0.9)
    return s.close().select("symbol", "t", F.round("conv_before", 4).alias("conv_before"), F.round("gain", 4).alias("gain"),
                            F.round("volume_multiple", 2).alias("volume_multiple"), "triggered")


GRID = [S.Params(w, ct, vg, k, 3, 5, 8) for w in (2, 3) for ct in (45.0, 70.0) for vg in (0.6, 0.9) for k in (0.3, 0.8)]
V.VIEW_SQL["grid_sig"] = """
WITH a AS (SELECT symbol, t, pos, high, close, atr, mn, mx, sm, v3, m8, rise,
    CASE WHEN pos >= 11 THEN avg(conv) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) END AS c2,
    CASE WHEN pos >= 12 THEN avg(conv) OVER (w ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING) END AS c3,
    CASE WHEN pos >= 10 THEN v7 END AS vl
  FROM (SELECT * EXCLUDE (conv), sqrt((pow(m3 - (m3 + m5 + m8) / 3, 2) + pow(m5 - (m3 + m5 + m8) / 3, 2) + pow(m8 - (m3 + m5 + m8) / 3, 2)) / 2)
    / ((m3 + m5 + m8) / 3 + 1e-8) * 100 AS conv FROM ig) WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, high, close, atr, param_id, k_atr, coalesce(mn > 1e-6 AND mx > 0.02 AND sm > 0.05 AND v3 > vl * vg AND rise AND close > m8
  AND CASE cv_w WHEN 2 THEN c2 ELSE c3 END < ct, false) AS entry
FROM a, (VALUES """ + ", ".join(f"({i}, {p.cv_w}, {p.ct}, {p.vg}::DOUBLE, {p.k_atr}::DOUBLE)" for i, p in enumerate(GRID)) + """) g(param_id, cv_w, ct, vg, k_atr)"""


def grid_bars(spark, d):
    s = stocks(spark, d, S.grid_back(GRID))
    s = s.add(_range=F.col("high") - F.col("low"))
    return s.add(atr=s.sma("_range", 5))


def grid(spark, d):
    return S.grid_signals(grid_bars(spark, d), GRID, "t", YEARS)


@query("wn22_grid_entries", "SELECT symbol, t, param_id, entry FROM grid_sig")
def _(spark, d):
    return grid(spark, d).select("symbol", "t", "param_id", "entry")


@query("jn16_param_grid", f"""
SELECT symbol, param_id, cv_w, ct, vg, k_atr FROM (SELECT DISTINCT symbol FROM bars_m), (VALUES
{", ".join(f"({i}, {p.cv_w}, {p.ct}::DOUBLE, {p.vg}::DOUBLE, {p.k_atr}::DOUBLE)" for i, p in enumerate(GRID))}) g(param_id, cv_w, ct, vg, k_atr)""")
def _(spark, d):
    points = F.array(*[F.struct(
        F.lit(i).alias("param_id"), F.lit(p.cv_w).alias("cv_w"), F.lit(p.ct).alias("ct"), F.lit(p.vg).alias("vg"),
        F.lit(p.k_atr).alias("k_atr")) for i, p in enumerate(GRID)])
    return V.bars_m(spark, d).select("symbol").distinct().select("symbol", F.explode(points).alias("g")).select("symbol", "g.*")


V.VIEW_SQL["exits"] = """
WITH a AS (SELECT *, sum(entry::INTEGER) OVER (PARTITION BY symbol, param_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM grid_sig),
b AS (SELECT *, max(high) OVER (PARTITION BY symbol, param_id, seg ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM a),
c AS (SELECT *, coalesce(seg > 0 AND close < peak - k_atr * atr, false) AS breach FROM b)
SELECT *, breach AND sum(breach::INTEGER) OVER (PARTITION BY symbol, param_id, seg ORDER BY t ROWS UNBOUNDED PRECEDING) = 1 AS exit FROM c"""


def exits(spark, d, events=False):
    return S.grid_exits(S.grid_hits(grid_bars(spark, d), GRID, "t"), GRID, K, "t", YEARS, events)


@query("wn23_chandelier_exit", "SELECT symbol, t, param_id, seg::BIGINT AS seg, peak, exit FROM exits")
def _(spark, d):
    return exits(spark, d).select("symbol", "t", "param_id", "seg", "peak", "exit")


V.VIEW_SQL["grid_trades"] = """
WITH a AS (SELECT *, coalesce(sum(exit::INTEGER) OVER (PARTITION BY symbol, param_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM exits)
SELECT symbol, param_id, min(t) FILTER (WHERE entry) AS entry_t, arg_min(close, t) FILTER (WHERE entry) AS entry_price,
  max(t) FILTER (WHERE exit) AS exit_t, max(close) FILTER (WHERE exit) AS exit_price
FROM a GROUP BY symbol, param_id, h HAVING count(*) FILTER (WHERE entry) > 0"""


@query("ag38_trade_details", """
SELECT symbol, param_id, entry_t, entry_price, exit_t, exit_price, exit_price - entry_price AS pnl,
  round((exit_price - entry_price) / entry_price, 6) AS ret FROM grid_trades""")
def _(spark, d):
    return rounded(S.pair_trades(exits(spark, d, events=True), ["symbol", "param_id"], "t", YEARS))


V.VIEW_SQL["daily_lists"] = """
SELECT DISTINCT l_suppkey AS code, dense_rank() OVER (ORDER BY t) AS date_no FROM (
  SELECT DISTINCT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS t FROM lineitem WHERE l_quantity >= 30)"""


def daily_lists(spark, d):
    """Suppliers that shipped a large line in a month; the month's rank comes from the distinct months only."""
    lists = V.table(spark, d, "lineitem").where("l_quantity >= 30").select(
        F.col("l_suppkey").alias("code"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("t")).distinct()
    calendar = lists.select("t").distinct().withColumn("_k", F.lit(0))
    calendar = calendar.withColumn("date_no", F.row_number().over(Window.partitionBy("_k").orderBy("t"))).drop("_k")
    return lists.join(calendar, "t").select("code", "date_no")


@query("wn25_consecutive_members", """
SELECT code, date_no FROM (SELECT *, count(*) OVER (PARTITION BY code ORDER BY date_no RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS n
  FROM daily_lists) WHERE n = 7""")
def _(spark, d):
    return S.consecutive_members(daily_lists(spark, d))


@query("ag32_frequency_risers", """
WITH m AS (SELECT max(date_no) AS l FROM daily_lists),
c AS (SELECT code, count(*) FILTER (WHERE l - date_no < 21) AS cur, count(*) FILTER (WHERE l - date_no < 41) AS long_count,
  count(*) FILTER (WHERE l - date_no >= 21 AND l - date_no < 42) AS prev FROM daily_lists, m GROUP BY 1)
SELECT code, cur, long_count, prev, cur > 0 AND prev > 0 AND cur - prev > 1 AS riser FROM c""")
def _(spark, d):
    return S.frequency_risers(daily_lists(spark, d), gap=1)


@query("tk09_most_common", "SELECT code, count(*) AS n FROM daily_lists GROUP BY 1 ORDER BY n DESC, code")
def _(spark, d):
    return daily_lists(spark, d).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


V.VIEW_SQL["rev"] = """
WITH a AS (SELECT symbol, t, pos, close, ln(close / lag(close) OVER w) AS lr, close / lag(close, 12) OVER w - 1 AS ret FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY t)),
b AS (SELECT *, stddev_pop(lr) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS sd, stddev_pop(close) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS vol
  FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t)),
e AS (SELECT * FROM b WHERE pos >= 13),
q AS (SELECT t, quantile_cont(sd, 0.8) AS cs, quantile_cont(vol, 0.7) AS cv FROM e GROUP BY 1)
SELECT symbol, t, ret, sd, vol, cs, cv FROM e JOIN q USING (t)"""


@query("wn30_mean_reversion", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ret, symbol) AS lo, row_number() OVER (PARTITION BY t ORDER BY ret DESC, symbol) AS hi,
  count(*) OVER (PARTITION BY t) AS n FROM rev WHERE sd <= cs OR vol <= cv)
SELECT symbol, t, round(ret, 6) AS ret, round(CASE WHEN hi <= 10 THEN -0.95 / least(10, n) ELSE 0.95 / least(10, n) END, 6) AS weight
FROM r WHERE lo <= 10 OR hi <= 10""")
def _(spark, d):
    return rounded(S.reversion_targets(stocks(spark, d, 30), "t", 12, 1, 10, 0.2, 0.3, vol_rows=24))


@query("wn30_mean_reversion_quantile", """
WITH c AS (SELECT t, quantile_cont(ret, 0.1) AS a, quantile_cont(ret, 0.9) AS b FROM rev GROUP BY 1)
SELECT symbol, t, round(ret, 6) AS ret, CASE WHEN ret >= b THEN 'short' ELSE 'long' END AS side FROM rev JOIN c USING (t) WHERE ret >= b OR ret <= a""")
def _(spark, d):
    s = stocks(spark, d, 13)
    rows = s.add(ret=s.full(F.col("close") / s.lag("close", 12) - 1, 13)).close().where("ret is not null")
    return rounded(S.reversion_quantile(rows.select("symbol", "t", "ret"), "t", 0.1))


@query("tk04_extremes_per_date", """
SELECT symbol, t, round(ret, 6) AS ret, side, rnk FROM (
  SELECT symbol, t, ret, 'low' AS side, row_number() OVER (PARTITION BY t ORDER BY ret, symbol) AS rnk FROM rev
  UNION ALL SELECT symbol, t, ret, 'high', row_number() OVER (PARTITION BY t ORDER BY ret DESC, symbol) FROM rev) WHERE rnk <= 3""")
def _(spark, d):
    s = stocks(spark, d, 13)
    rows = s.add(ret=s.full(F.col("close") / s.lag("close", 12) - 1, 13)).close().where("ret is not null").select("symbol", "t", "ret")
    low = S.ranked(rows, "t", 3, F.asc("ret"), F.asc("symbol")).withColumn("side", F.lit("low"))
    high = S.ranked(rows, "t", 3, F.desc("ret"), F.asc("symbol")).withColumn("side", F.lit("high"))
    return rounded(low.unionByName(high))


@query("wn31_inverse_volatility", """
WITH a AS (SELECT symbol, t, pos, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS lr FROM pm),
b AS (SELECT symbol, t, CASE WHEN pos >= 22 THEN stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY t ROWS 20 PRECEDING) END AS sd FROM a)
SELECT symbol, t, round(1 / sd / sum(1 / sd) OVER (PARTITION BY t) * 0.95, 6) AS weight FROM b WHERE sd > 0""")
def _(spark, d):
    return rounded(S.inverse_volatility(stocks(spark, d, 22), "t"))


@query("wn32_pair_switch", """
WITH p AS (SELECT a.symbol, a.t, a.close AS ca, b.close AS cb FROM bars_m a JOIN bars_m b ON b.symbol = a.symbol + 1 AND a.t = b.t WHERE a.symbol % 2 = 0),
x AS (SELECT *, row_number() OVER w AS pos, ln(ca / lag(ca, 12) OVER w) AS ra, ln(cb / lag(cb, 12) OVER w) AS rb FROM p WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, CASE WHEN ra > rb THEN 'ca' ELSE 'cb' END AS pick, 0.95::DOUBLE AS weight FROM x WHERE (pos - 1) % 3 = 0 AND pos >= 13""")
def _(spark, d):
    bars = V.bars_m(spark, d)
    a = bars.where("symbol % 2 = 0").select("symbol", "t", F.col("close").alias("ca"))
    b = bars.where("symbol % 2 = 1").select((F.col("symbol") - 1).alias("symbol"), "t", F.col("close").alias("cb"))
    s = open_series(a.join(b, ["symbol", "t"]), K, T, YEARS, 13)
    return S.pair_switch(s, "t", "ca", "cb", 12, 3)


@query("wn33_static_weights", """
WITH m AS (SELECT symbol, t, (close - open) / 100 AS x FROM bars_m)
SELECT symbol, t, round(1.0 / count(*) OVER p, 6) AS equal, round(CASE WHEN x > 0 THEN x / sum(x) FILTER (WHERE x > 0) OVER p
  WHEN x < 0 THEN -x / sum(x) FILTER (WHERE x < 0) OVER p ELSE 0 END, 6) AS held, round(-0.95 * abs(x) / sum(abs(x)) OVER p, 6) AS levered
FROM m WINDOW p AS (PARTITION BY t)""")
def _(spark, d):
    rows = V.bars_m(spark, d).select("symbol", "t", ((F.col("close") - F.col("open")) / 100).alias("x"))
    rows = S.equal_weights(rows, "t").withColumnRenamed("weight", "equal")
    rows = S.hold_weights(rows, "x", "t").withColumnRenamed("weight", "held")
    rows = S.leveraged_weights(rows, "x", "t").withColumnRenamed("weight", "levered")
    return rounded(rows.drop("x"))


@query("wn35_half_kelly", """
WITH a AS (SELECT symbol AS run_id, t, pos, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM pm),
b AS (SELECT *, avg(r) OVER w AS mu, stddev_pop(r) OVER w AS sd FROM a WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS 18 PRECEDING))
SELECT run_id, t, CASE WHEN pos > 20 AND sd > 0 THEN round(greatest(0.2, least(2.0, mu / (sd * sd) / 2)), 6) END AS kelly FROM b""")
def _(spark, d):
    s = S.half_kelly(open_series(V.equity(spark, d), ["run_id"], T, YEARS, 20), "value")
    out = s.close().select("run_id", "t", "kelly")
    return rounded(out)


@query("wn46_rebalance_clock", """
SELECT symbol, t, pos::BIGINT AS bar_no FROM pm WHERE pos % 5 = 0 AND pos > 13""")
def _(spark, d):
    rows = number_rows(V.bars_m(spark, d), K, T, YEARS)
    return S.rebalance_clock(rows, K, "t", 5, 0, 13).select("symbol", "t", F.col(POS).cast("bigint").alias("bar_no"))


@query("wn44_day_gainers", """
SELECT symbol, t, round(gain, 6) AS gain FROM (SELECT symbol, t, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS gain,
  row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS rd FROM bars_m) WHERE rd = 1 AND gain > 0.05""")
def _(spark, d):
    return rounded(S.day_gainers(stocks(spark, d, 1), "t", 0.05))


@query("tk05_last_rows", "SELECT symbol, t, close FROM bars_m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1")
def _(spark, d):
    return S.latest(V.bars_m(spark, d).select("symbol", "t", "close"), K, "t")


@query("tk05_last_n_rows", "SELECT symbol, t, close FROM bars_m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 5")
def _(spark, d):
    from tidemark.operators.risk import last_n
    return last_n(V.bars_m(spark, d), K, "t", YEARS, 5).select("symbol", "t", "close")


@query("wn16_rolling_alpha", """
WITH m AS (SELECT t, sum(r) / count(r) AS m FROM returns_m GROUP BY 1),
a AS (SELECT r.symbol, r.t, r.r, m.m, 0.001::DOUBLE AS f FROM returns_m r JOIN m USING (t)),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS pos, sum(m) OVER w AS x, sum(r) OVER w AS y, sum(m * r) OVER w AS xy, sum(m * m) OVER w AS xx,
  exp(sum(ln(1 + r)) OVER w) - 1 AS rn, exp(sum(ln(1 + m)) OVER w) - 1 AS mn, exp(sum(ln(1 + f)) OVER w) - 1 AS fn
  FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 11 PRECEDING)),
c AS (SELECT *, (xy - x * y / 12) / (xx - x * x / 12) AS beta FROM b WHERE pos >= 12)
SELECT symbol, t, round(beta, 5) AS beta, round(rn, 5) AS r_n, round(rn - fn - beta * (mn - fn), 4) AS alpha FROM c""")
def _(spark, d):
    s = alpha(spark, d)
    return s.close().where("beta is not null").select("symbol", "t", F.round("beta", 5).alias("beta"), F.round("r_n", 5).alias("r_n"),
                            F.round("alpha", 4).alias("alpha"))


def alpha(spark, d):
    r = V.returns_m(spark, d)
    market = r.groupBy("t").agg((F.sum("r") / F.count("r")).alias("m"))
    rows = r.join(market, "t").withColumn("f", F.lit(0.001))
    return S.rolling_alpha(open_series(rows, K, T, YEARS, 12), 12)


@query("wn16_top_alpha", """
WITH m AS (SELECT t, sum(r) / count(r) AS m FROM returns_m GROUP BY 1),
a AS (SELECT r.symbol, r.t, r.r, m.m, 0.001::DOUBLE AS f FROM returns_m r JOIN m USING (t)),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS pos, sum(m) OVER w AS x, sum(r) OVER w AS y, sum(m * r) OVER w AS xy, sum(m * m) OVER w AS xx,
  exp(sum(ln(1 + r)) OVER w) - 1 AS rn, exp(sum(ln(1 + m)) OVER w) - 1 AS mn, exp(sum(ln(1 + f)) OVER w) - 1 AS fn
  FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 11 PRECEDING)),
c AS (SELECT *, rn - fn - (xy - x * y / 12) / (xx - x * x / 12) * (mn - fn) AS alpha FROM b WHERE pos >= 12 AND t = (SELECT max(t) FROM bars_m))
SELECT symbol, round(alpha, 4) AS alpha FROM c ORDER BY c.alpha DESC, symbol LIMIT 10""")
def _(spark, d):
    rows = alpha(spark, d).close().where("alpha is not null")
    last = V.bars_m(spark, d).agg(F.max("t").alias("t"))
    best = S.top(rows.join(F.broadcast(last), "t"), 10, F.desc("alpha"), F.asc("symbol"))  # one row
    return best.select("symbol", F.round("alpha", 4).alias("alpha"))


@query("udf01_strategy_registry", """
WITH a AS (SELECT symbol, t, CASE WHEN pos >= 8 THEN avg(close) OVER (w ROWS 2 PRECEDING) - avg(close) OVER (w ROWS 7 PRECEDING) END AS g FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY t)),
c AS (SELECT symbol, t, pos, close, max(high) OVER (w ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS u, min(low) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, 'cross_over' AS name, CASE WHEN g > 0 AND lag(g) OVER w <= 0 THEN 1 WHEN g < 0 AND lag(g) OVER w >= 0 THEN -1 ELSE 0 END AS signal FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t)
UNION ALL SELECT symbol, t, 'channel_breakout', CASE WHEN pos >= 10 AND close > u THEN 1 WHEN pos >= 5 AND close < l THEN -1 ELSE 0 END FROM c""")
def _(spark, d):
    from tidemark.functions.registry import run_strategy
    bars = stage(V.bars_m(spark, d))
    cross = run_strategy("cross_over", bars, fast=3, slow=8, bucket=YEARS).withColumn("name", F.lit("cross_over"))
    channel = run_strategy("channel_breakout", bars, entry=10, exit=5, bucket=YEARS).withColumn("name", F.lit("channel_breakout"))
    return cross.unionByName(channel)
