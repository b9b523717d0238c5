"""Return, risk, trade and walk-forward queries."""

import math

from pyspark.sql import functions as F

from tidemark.functions.series import open_series
from tidemark.operators import joins as J
from tidemark.operators import risk as R
from tidemark.operators import screens as S
from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.queries_flow import rounded
from tidemark.plans.queries_screens import K, T, YEARS, exits
from tidemark.session import stage

RUN = ["run_id"]


def cols(df, **digits):
    """Round the named columns; the others pass."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


V.VIEW_SQL["legs"] = """
WITH a AS (SELECT symbol, t, pos, close, volume, min(close) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS lo FROM pm),
e AS (SELECT symbol, arg_max(t, (((close - lo) / lo), -t)) AS end_t, max((close - lo) / lo) AS max_gain FROM a GROUP BY 1 HAVING max((close - lo) / lo) > 0),
st AS (SELECT symbol, end_t, max_gain, arg_min(t, (close, t)) AS start_t FROM a JOIN e USING (symbol) WHERE t <= end_t GROUP BY ALL),
l AS (SELECT a.*, start_t, end_t, max_gain FROM a JOIN st USING (symbol) WHERE t BETWEEN start_t AND end_t),
m AS (SELECT *, max(close) OVER w AS pk, CASE WHEN t > start_t THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 END AS r
  FROM l WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)),
x AS (SELECT symbol, start_t, end_t, max_gain, arg_min(pos, ((close - pk) / pk, pos)) AS trough, min((close - pk) / pk) AS mdd, avg(r) AS mean, stddev_pop(r) AS sd,
  sum(volume) / count(*) AS mean_volume, median(volume) AS median_volume FROM m GROUP BY ALL),
p AS (SELECT symbol, arg_max(m.pos, (m.close, -m.pos)) AS peak FROM m JOIN x USING (symbol) WHERE m.pos <= x.trough GROUP BY 1)
SELECT symbol, max_gain, start_t, end_t, end_t - start_t AS duration, mdd, (trough - peak)::BIGINT AS mdd_duration, max_gain / (abs(mdd) + 0.10) AS calmar,
  coalesce(CASE WHEN sd > 0 THEN (mean - 0.02 / 244) / sd * sqrt(244) END, 0) AS sharpe, mean_volume, median_volume FROM x JOIN p USING (symbol)"""
LEG_ROUND = dict(max_gain=5, mdd=6, calmar=4, sharpe=4, mean_volume=6, median_volume=6)
LEG_SQL = ", ".join(f"round({c}, {n}) AS {c}" for c, n in LEG_ROUND.items())


def legs(spark, d):
    return R.best_leg(V.bars_m(spark, d), K, "t", YEARS)


@query("ag17_best_leg", f"SELECT symbol, start_t, end_t, duration, mdd_duration, {LEG_SQL} FROM legs")
def _(spark, d):
    return cols(legs(spark, d), **LEG_ROUND)


@query("ag35_leg_volume", """
SELECT symbol, round(mean_volume, 6) AS mean_volume, round(median_volume, 6) AS median_volume,
  (SELECT max(volume) FROM bars_m b WHERE b.symbol = legs.symbol AND b.t BETWEEN start_t AND end_t) AS max_volume FROM legs""")
def _(spark, d):
    leg = legs(spark, d)
    bars = V.bars_m(spark, d).select("symbol", "t", "volume")
    top = bars.join(leg.select("symbol", "start_t", "end_t"), "symbol").where("t between start_t and end_t")
    top = top.groupBy("symbol").agg(F.max("volume").alias("max_volume"))
    return rounded(leg.join(top, "symbol").select("symbol", "mean_volume", "median_volume", "max_volume"))


V.VIEW_SQL["scored"] = """
WITH f AS (SELECT symbol, round(max_gain, 9) AS max_gain, round(calmar, 9) AS calmar, round(sharpe, 9) AS sharpe FROM legs WHERE mdd > -0.95 AND duration >= 3 AND max_gain > 1)
SELECT symbol, max_gain, """ + ", ".join(
    f"((rank() OVER (ORDER BY {c})) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER () AS r_{c}"
    for c in ("max_gain", "calmar", "sharpe")) + " FROM f"


@query("wn29_composite_screen", """
SELECT symbol, round(max_gain, 5) AS max_gain, round(r_max_gain * r_max_gain * 0.6 + r_calmar * 0.25 + r_sharpe * 0.15, 6) AS final_score
FROM scored""")
def _(spark, d):
    return screened(spark, d, None)


@query("tk03_top_legs", """
WITH s AS (SELECT symbol, round(max_gain, 5) AS max_gain, round(r_max_gain * r_max_gain * 0.6 + r_calmar * 0.25 + r_sharpe * 0.15, 6) AS final_score
FROM scored)
SELECT * FROM s ORDER BY final_score DESC, max_gain DESC, symbol LIMIT 30""")
def _(spark, d):
    return screened(spark, d, 30)


def screened(spark, d, n):
    rows = cols(legs(spark, d), max_gain=9, calmar=9, sharpe=9)
    best = S.composite_screen(rows, n, -0.95, 3, 1.0)
    return best.select("symbol", F.round("max_gain", 5).alias("max_gain"), F.round("final_score", 6).alias("final_score"))


@query("wn17_running_extremes", """
WITH a AS (SELECT symbol, t, pos, close, min(close) OVER w AS lo, max(close) OVER w AS hi,
  max(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM pm WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT symbol, t, round(close / lo - 1, 6) AS gain, round((hi - close) / hi, 6) AS drawdown,
  (pos - max(CASE WHEN ph IS NULL OR close > ph THEN pos END) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING))::BIGINT AS bars_down FROM a""")
def _(spark, d):
    from tidemark.functions.series import running
    rows = R.drawdown_rows(V.bars_m(spark, d).select("symbol", "t", F.col("close").alias("value")), K, "t", YEARS)
    rows = running(rows, K, T, YEARS, {"lo": ("min", F.col("value"))})
    return rounded(rows.select("symbol", "t", (F.col("value") / F.col("lo") - 1).alias("gain"), "drawdown",
                               F.col("bars_down").cast("bigint").alias("bars_down")))


V.VIEW_SQL["eq_dd"] = """
WITH a AS (SELECT run_id, t, value, row_number() OVER (PARTITION BY run_id ORDER BY t) AS i, max(value) OVER w AS pk,
  max(value) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph, value / lag(value) OVER (PARTITION BY run_id ORDER BY t) - 1 AS r
  FROM equity WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT *, i - max(CASE WHEN value > coalesce(ph, 0) THEN i END) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS down FROM a"""
V.VIEW_SQL["pscore"] = """
SELECT run_id, count(*) AS n, arg_min(value, t) AS init, arg_max(value, t) AS final_value, max((pk - value) / pk) AS max_dd, max(down)::BIGINT AS dd_days,
  avg(CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r IS NOT NULL THEN 0 END) AS win_rate, pow(arg_max(value, t) / arg_min(value, t), 244.0 / count(*)) - 1 AS ann_ret,
  CASE WHEN stddev_pop(r) > 1e-9 THEN avg(r) / stddev_pop(r) * sqrt(244) ELSE 0 END AS sharpe FROM eq_dd GROUP BY 1"""


@query("ag18_portfolio_scores", """
SELECT run_id, n, final_value, round(max_dd, 6) AS max_dd, dd_days, round(ann_ret, 4) AS ann_ret, round(sharpe, 5) AS sharpe FROM pscore""")
def _(spark, d):
    p = R.portfolio_scores(V.equity(spark, d), RUN, "t", YEARS)
    return cols(p.select("run_id", "n", "final_value", "max_dd", "dd_days", "ann_ret", "sharpe"), max_dd=6, ann_ret=4, sharpe=5)


@query("ag19_composite_scores", """
SELECT run_id, round(0.4 * ann_ret / greatest(max_dd, 0.001) + 0.2 * greatest(-5, least(5, sharpe)) + 0.2 * win_rate, 4) AS grid_score,
  round(0.4 * greatest(-0.99, least(2.0, ann_ret)) / greatest(max_dd, 0.01) + 0.2 * greatest(0, least(1, 1 - dd_days / 244))
    + 0.2 * greatest(-5, least(5, sharpe)) + 0.2 * win_rate, 5) AS single_score FROM pscore""")
def _(spark, d):
    p = R.portfolio_scores(V.equity(spark, d), RUN, "t", YEARS)
    return cols(p.select("run_id", R.grid_score().alias("grid_score"), R.single_score().alias("single_score")), grid_score=4, single_score=5)


V.VIEW_SQL["wf_bounds"] = "SELECT min(t) AS a, max(t) AS b FROM bars_m"
V.VIEW_SQL["wf_slices"] = """
SELECT k AS slice_no, a + k * 6 AS s, least(a + k * 6 + 24, b) AS e FROM (SELECT *, unnest(range(0, b - a + 1)) AS k FROM wf_bounds)
WHERE k = 0 OR k * 6 + 1 < b - a"""


@query("wn43_walk_forward_slices", """
SELECT symbol, t, slice_no::INTEGER AS slice_no FROM (SELECT symbol, t, slice_no, count(*) OVER (PARTITION BY symbol, slice_no) AS n
FROM bars_m JOIN wf_slices ON t BETWEEN s AND e) WHERE n >= 20""")
def _(spark, d):
    return J.in_slices(V.bars_m(spark, d), "symbol", "t", 24, 6, 20).select("symbol", "t", "slice_no")


V.VIEW_SQL["wf_scores"] = """
SELECT slice_no::INTEGER AS slice_no, param_id, avg((exit_price - entry_price) / entry_price) + 0.0 AS score, count(*) AS n
FROM (SELECT * FROM grid_trades WHERE exit_t IS NOT NULL) JOIN wf_slices ON entry_t BETWEEN s AND e GROUP BY 1, 2"""


def wf_scores(spark, d):
    trades = S.pair_trades(exits(spark, d, events=True), ["symbol", "param_id"], "t", YEARS).where("exit_t is not null")
    sliced = J.in_slices(trades, "symbol", "entry_t", 24, 6, 0, V.bars_m(spark, d).select(F.col("t").alias("entry_t")))
    return stage(sliced.groupBy("slice_no", "param_id").agg(
        F.avg("ret").alias("score"), F.count("*").alias("n")))


@query("ag20_robustness", """
WITH r AS (SELECT param_id, avg(score) AS m, coalesce(stddev_samp(score), 1) AS sd, avg(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win FROM wf_scores GROUP BY 1)
SELECT param_id, round(m, 6) AS avg_score, round(sd, 6) AS score_std, round(win, 6) AS profitable_slice_pct, round(m / (sd + 1e-6), 4) AS stability_sharpe,
  round(m / (sd + 1e-6) * win, 4) AS final_robust_rank, round(m / (1 + sd), 6) AS stability_score FROM r""")
def _(spark, d):
    out = R.robustness(wf_scores(spark, d), ["param_id"])
    return cols(out, avg_score=6, score_std=6, profitable_slice_pct=6, stability_sharpe=4, final_robust_rank=4, stability_score=6)


@query("tk08_best_params", """
WITH r AS (SELECT param_id, avg(score) AS m, coalesce(stddev_samp(score), 1) AS sd FROM wf_scores GROUP BY 1)
SELECT param_id, round(m / (1 + sd), 6) AS stability_score FROM r ORDER BY round(m / (1 + sd), 6) DESC, param_id LIMIT 3""")
def _(spark, d):
    out = cols(R.robustness(wf_scores(spark, d), ["param_id"]).select("param_id", "stability_score"), stability_score=6)
    return S.top(out, 3, F.desc("stability_score"), F.asc("param_id"))


@query("ag21_heat_table", """
SELECT slice_no, round(avg(score) FILTER (WHERE param_id % 2 = 0), 6) AS k0, round(avg(score) FILTER (WHERE param_id % 2 = 1), 6) AS k1 FROM wf_scores GROUP BY 1""")
def _(spark, d):
    table = R.heat_table(wf_scores(spark, d).withColumn("k", F.col("param_id") % 2), "slice_no", "k", [0, 1])
    return rounded(table.withColumnsRenamed({"0": "k0", "1": "k1"}))


@query("ag21_sensitivity", """
SELECT param_id, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS q2, round(quantile_cont(score, 0.75), 6) AS q3 FROM wf_scores GROUP BY 1""")
def _(spark, d):
    from tidemark.functions.series import exact_percentiles
    return rounded(exact_percentiles(wf_scores(spark, d), ["param_id"], "score", {"q1": 0.25, "q2": 0.5, "q3": 0.75}))


@query("ag22_total_returns", """
SELECT symbol, round(arg_max(close, t) / arg_min(close, t) - 1, 6) AS total_return, count(*) AS n,
  round(pow(arg_max(close, t) / arg_min(close, t), 255.0 / count(*)) - 1, 3) AS annual_return FROM bars_m GROUP BY 1""")
def _(spark, d):
    return cols(R.total_returns(V.bars_m(spark, d), K, "t"), total_return=6, annual_return=3)


V.VIEW_SQL["lr"] = """
SELECT symbol, ts, pos, close, r FROM (SELECT symbol, ts, pos, close, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM pb) WHERE r IS NOT NULL"""


def log_returns(spark, d):
    s = open_series(V.bars_h(spark, d), K, ["ts"], "ts div 2592000", 1)
    return s.add(r=F.log(F.col("close") / s.lag("close"))).close().where("r is not null").select("symbol", "ts", "close", "r")


@query("ag23_moments", """
WITH m AS (SELECT symbol, count(*) AS n, avg(r) AS mu, var_samp(r) AS v FROM lr GROUP BY 1)
SELECT symbol, any_value(n) AS n, round(any_value(mu), 6) AS mean, round(any_value(v), 6) AS variance,
  round(avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5), 5) AS skew, round(avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3, 5) AS kurt
FROM lr JOIN m USING (symbol) GROUP BY 1""")
def _(spark, d):
    return cols(R.moments(log_returns(spark, d), K), mean=6, variance=6, skew=5, kurt=5)


@query("ag24_value_at_risk", """
WITH a AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM lr),
v AS (SELECT symbol, min(r) FILTER (WHERE i >= ceil(0.05 * (n - 1)) + 1) AS var FROM a GROUP BY 1)
SELECT symbol, round(var, 6) AS var, round(avg(r), 6) AS cvar FROM lr JOIN v USING (symbol) WHERE r < var GROUP BY 1, v.var""")
def _(spark, d):
    return rounded(R.value_at_risk(log_returns(spark, d), K))


@query("ag25_recent_std", """
SELECT symbol, round(stddev_samp(close), 5) AS price_std, round(stddev_samp(r), 6) AS return_std FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rd FROM lr) WHERE rd <= 60 GROUP BY 1""")
def _(spark, d):
    rows = R.last_n(log_returns(spark, d), K, "ts", "ts div 2592000", 60)
    return rows.groupBy("symbol").agg(F.round(F.stddev_samp("close"), 5).alias("price_std"), F.round(F.stddev_samp("r"), 6).alias("return_std"))


def log_close(spark, d, back):
    s = open_series(V.bars_h(spark, d), K, ["ts"], "ts div 2592000", back)
    return s.add(x=F.log("close"))


@query("ag26_hurst", """
WITH x AS (SELECT symbol, pos, ln(close) AS x FROM pb),
s AS (SELECT a.symbol, k, ln(sqrt(stddev_pop(a.x - b.x))) AS y FROM range(2, 100) r(k), x a JOIN x b ON a.symbol = b.symbol AND a.pos = b.pos + k GROUP BY 1, 2)
SELECT symbol, round(regr_slope(y, ln(k)) * 2, 6) AS hurst FROM s GROUP BY 1""")
def _(spark, d):
    return rounded(R.hurst(log_close(spark, d, 99), "x"))


@query("ag27_variance_ratio", """
WITH x AS (SELECT symbol, ln(close) AS x, ln(close / lag(close) OVER w) AS d, ln(close) - ln(lag(close, 2) OVER w) AS k FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
m AS (SELECT symbol, count(*)::DOUBLE AS n, sum(d) / count(*) AS mu FROM x GROUP BY 1),
s AS (SELECT symbol, n, sum(pow(d - mu, 2)) / (n - 1) AS b, sum(pow(k - 2 * mu, 2)) / ((n - 1) * (1 - 2 / n)) AS t FROM x JOIN m USING (symbol) GROUP BY 1, 2)
SELECT symbol, round(t / (2 * b), 6) AS variance_ratio FROM s""")
def _(spark, d):
    return rounded(R.variance_ratio(log_close(spark, d, 2), "x"))


@query("ag28_half_life", """
WITH x AS (SELECT symbol, coalesce(lag(close) OVER w, 0) AS l, coalesce(close - lag(close) OVER w, 0) AS d FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, round(regr_slope(l, d), 6) AS slope, round(-ln(2) / regr_slope(l, d), 5) AS half_life, round(regr_slope(d, l), 6) AS swapped FROM x GROUP BY 1""")
def _(spark, d):
    s = open_series(V.bars_h(spark, d), K, ["ts"], "ts div 2592000", 1)
    other = R.half_life(s, "close", True).select("symbol", F.col("slope").alias("swapped"))
    return cols(R.half_life(s, "close").join(other, "symbol"), slope=6, half_life=5, swapped=6)


TRADE_ORDER = ["day", "seq", "pnl", "entry"]
_DIR = ", ".join(
    f"count(*) FILTER (WHERE direction = '{x}') AS {x}, count(*) FILTER (WHERE direction = '{x}' AND pnl >= 0) AS {x}_won, "
    f"coalesce(sum(pnl) FILTER (WHERE direction = '{x}'), 0)::BIGINT AS {x}_net" for x in ("long", "short"))


@query("ag29_trade_statistics", f"""
WITH o AS (SELECT *, row_number() OVER w - row_number() OVER v AS g FROM trades
  WINDOW w AS (PARTITION BY run_id ORDER BY day, seq, pnl, entry), v AS (PARTITION BY run_id, pnl >= 0 ORDER BY day, seq, pnl, entry)),
k AS (SELECT run_id, pnl >= 0 AS won, g, count(*) AS len FROM o GROUP BY 1, 2, 3),
s AS (SELECT run_id, coalesce(max(len) FILTER (WHERE won), 0) AS longest_win, coalesce(max(len) FILTER (WHERE NOT won), 0) AS longest_loss FROM k GROUP BY 1),
a AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE pnl >= 0) AS won, count(*) FILTER (WHERE pnl < 0) AS lost, sum(pnl)::BIGINT AS net,
  coalesce(sum(pnl) FILTER (WHERE pnl >= 0), 0)::BIGINT AS gross_won, coalesce(sum(pnl) FILTER (WHERE pnl < 0), 0)::BIGINT AS gross_lost,
  max(pnl) FILTER (WHERE pnl >= 0) AS max_won, min(pnl) FILTER (WHERE pnl < 0) AS max_lost, {_DIR}, sqrt(count(*)) * avg(pnl) / stddev_pop(pnl) AS q FROM trades GROUP BY 1)
SELECT a.* EXCLUDE (q), longest_win, longest_loss, round(net / total, 3) AS avg_net, round(gross_won / won, 3) AS avg_won, round(gross_lost / lost, 3) AS avg_lost,
  round(won / total * 100, 6) AS pct_winning, round(gross_won / -gross_lost, 6) AS profit_factor, round(q, 6) AS sqn,
  CASE WHEN q < 1.6 THEN 'Poor' WHEN q < 1.9 THEN 'Below average' WHEN q < 2.4 THEN 'Average' WHEN q < 2.9 THEN 'Good'
    WHEN q < 5.0 THEN 'Excellent' WHEN q < 6.9 THEN 'Superb' ELSE 'Holy Grail' END AS sqn_rating
FROM a JOIN s USING (run_id)""")
def _(spark, d):
    t = R.trade_statistics(V.trades(spark, d), RUN, TRADE_ORDER, "day div 366")
    return cols(t, avg_net=3, avg_won=3, avg_lost=3, pct_winning=6, profit_factor=6, sqn=6)


@query("ag30_equity_statistics", f"""
WITH b AS (SELECT run_id, count(*) AS n, arg_min(value, t) AS s, arg_max(value, t) AS e, avg(r - {1.035 ** (1 / 252) - 1!r}::DOUBLE) AS m, stddev_pop(r - {1.035 ** (1 / 252) - 1!r}::DOUBLE) AS sd,
  sqrt(avg(CASE WHEN r IS NOT NULL THEN pow(least(r - {1.035 ** (1 / 252) - 1!r}::DOUBLE, 0), 2) END)) AS dn, max((pk - value) / pk) AS dd, max(pk - value) AS md, max(down)::BIGINT AS ln_ FROM eq_dd GROUP BY 1),
c AS (SELECT *, ln(e / s) / (n - 1) AS rate FROM b),
g AS (SELECT run_id, stddev_samp(value / (s * exp(rate * (i - 1))) - 1) AS gap FROM eq_dd JOIN c USING (run_id) GROUP BY 1)
SELECT run_id, n, s AS start_value, e AS end_value, round((e / s - 1) * 100, 5) AS roi, round((exp(rate * 252) - 1) * 100, 2) AS cagr,
  round(m / sd * {math.sqrt(252)!r}::DOUBLE, 5) AS sharpe, round(m * {math.sqrt(252)!r}::DOUBLE / dn, 5) AS sortino, round(dd * 100, 5) AS max_drawdown, md AS max_money_drawdown,
  ln_ AS max_drawdown_length FROM c JOIN g USING (run_id)""")
def _(spark, d):
    e = R.equity_statistics(V.equity(spark, d), RUN, "t", YEARS).drop("vwr")
    return cols(e, roi=5, cagr=2, sharpe=5, sortino=5, max_drawdown=5)


@query("ag30_variability_weighted", """
WITH b AS (SELECT run_id, count(*) AS n, arg_min(value, t) AS s, arg_max(value, t) AS e FROM eq_dd GROUP BY 1),
c AS (SELECT *, ln(e / s) / (n - 1) AS rate FROM b),
g AS (SELECT run_id, any_value(rate) AS rate, stddev_samp(value / (s * exp(rate * (i - 1))) - 1) AS gap FROM eq_dd JOIN c USING (run_id) GROUP BY 1)
SELECT run_id, round((exp(rate * 12) - 1) * 100 * (1 - pow(gap / 2.0, 2)), 4) AS vwr FROM g""")
def _(spark, d):
    e = R.equity_statistics(V.equity(spark, d), RUN, "t", YEARS, periods=12, sigma_max=2.0)
    return cols(e.select("run_id", "vwr"), vwr=4)


@query("ag30_yearly_returns", """
WITH y AS (SELECT run_id, t // 12 AS period, arg_max(value, t) AS value FROM equity GROUP BY 1, 2)
SELECT run_id, period, value, round((value / lag(value) OVER (PARTITION BY run_id ORDER BY period) - 1) * 100, 5) AS ret FROM y""")
def _(spark, d):
    p = R.period_returns(V.equity(spark, d), RUN, "t", F.expr("cast(t div 12 as int)"), "period div 50")
    return cols(p.select("run_id", "period", "value", "ret"), ret=5)


@query("ag30_exposure", """
WITH d AS (SELECT symbol AS run_id, t, sum(abs(x)) AS gross, count(*) FILTER (WHERE x <> 0) AS n FROM (
  SELECT l_suppkey AS symbol, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS t, l_partkey % 7 AS name, (sum(l_quantity) - 30)::BIGINT AS x FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT run_id, round(avg(n), 6) AS avg_positions, round(avg(abs(gross / value)) * 100000, 6) AS avg_leverage FROM d JOIN equity USING (run_id, t) GROUP BY 1""")
def _(spark, d):
    held = V.table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("run_id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("t"),
        (F.col("l_partkey") % 7).alias("name")).agg((F.sum("l_quantity") - 30).cast("bigint").alias("amount"))
    out = R.exposure(held, V.equity(spark, d), RUN, "t")
    return rounded(out.withColumn("avg_leverage", F.col("avg_leverage") * 100000))


@query("ag31_period_returns", """
WITH y AS (SELECT symbol, ts // 86400 AS period, arg_max(close, ts) AS value FROM bars_h GROUP BY 1, 2)
SELECT symbol, period, value, round((value / lag(value) OVER (PARTITION BY symbol ORDER BY period) - 1) * 100, 5) AS ret FROM y""")
def _(spark, d):
    curve = V.bars_h(spark, d).select("symbol", "ts", F.col("close").alias("value"))
    p = R.period_returns(curve, K, "ts", F.expr("ts div 86400"), "period div 366")
    return cols(p.select("symbol", "period", "value", "ret"), ret=5)


@query("ag31_normalised_curves", """
SELECT symbol, ts, round(close / first_value(close) OVER w * 100, 5) AS curve, round(open / first_value(open) OVER w * 100, 5) AS buy_hold
FROM bars_h WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    bars = V.bars_h(spark, d)
    curve = R.normalised(bars, K, "ts", "close").withColumnRenamed("curve", "c1")
    both = R.normalised(curve, K, "ts", "open")
    return both.select("symbol", "ts", F.round("c1", 5).alias("curve"), F.round("curve", 5).alias("buy_hold"))


@query("ag33_mean_and_covariance", """
WITH r AS (SELECT sector, t, r FROM (SELECT sector, t, close / lag(close) OVER (PARTITION BY sector ORDER BY t) - 1 AS r,
  row_number() OVER (PARTITION BY sector ORDER BY t DESC) AS rd FROM sector_bars) WHERE r IS NOT NULL AND rd <= 60)
SELECT a.sector AS a, b.sector AS b, round(covar_samp(a.r, b.r) * 252, 6) AS cov, round(avg(a.r) * 252, 5) AS mean_a FROM r a JOIN r b USING (t) GROUP BY 1, 2""")
def _(spark, d):
    s = open_series(V.sector_bars(spark, d), ["sector"], T, YEARS, 1)
    r = s.add(r=s.pct("close")).close().select("sector", "t", "r")
    r = R.last_n(r, ["sector"], "t", YEARS, 60).where("r is not null")
    return cols(R.mean_and_covariance(r, "sector", "t"), cov=6, mean_a=5)


@query("ag34_fit_and_laplace_ks", """
WITH f AS (SELECT symbol, avg(r) AS mean, stddev_pop(r) AS std, median(r) AS median FROM lr GROUP BY 1),
g AS (SELECT symbol, avg(abs(r - median)) AS scale FROM lr JOIN f USING (symbol) GROUP BY 1),
k AS (SELECT symbol, r, cume_dist() OVER (PARTITION BY symbol ORDER BY r) AS hi, (rank() OVER (PARTITION BY symbol ORDER BY r) - 1) / count(*) OVER (PARTITION BY symbol) AS lo FROM lr),
c AS (SELECT symbol, hi, lo, CASE WHEN r < median THEN exp((r - median) / scale) / 2 ELSE 1 - exp(-(r - median) / scale) / 2 END AS cdf FROM k JOIN f USING (symbol) JOIN g USING (symbol))
SELECT symbol, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(any_value(median), 6) AS median, round(any_value(scale), 6) AS scale,
  round(max(greatest(hi - cdf, cdf - lo)), 6) AS ks_laplace FROM c JOIN f USING (symbol) JOIN g USING (symbol) GROUP BY 1""")
def _(spark, d):
    r = log_returns(spark, d)
    return rounded(R.fits(r, K).join(R.ks_distances(r, K, normal=False), "symbol"))


_Z = "(r - mean) / std"
_T = f"(1 / (1 + {R.ERF_SCALE}::DOUBLE * abs({_Z}) / sqrt(2)))"
_TAIL = "(" + " + ".join(f"{a}::DOUBLE * pow({_T}, {i + 1})" for i, a in enumerate(R.ERF)) + f") * exp(-pow({_Z}, 2) / 2) / 2"


@query("ag34_normal_ks", f"""
WITH f AS (SELECT symbol, avg(r) AS mean, stddev_pop(r) AS std, median(r) AS median FROM lr GROUP BY 1),
g AS (SELECT symbol, avg(abs(r - median)) AS scale FROM lr JOIN f USING (symbol) GROUP BY 1),
k AS (SELECT symbol, r, cume_dist() OVER (PARTITION BY symbol ORDER BY r) AS hi, (rank() OVER (PARTITION BY symbol ORDER BY r) - 1) / count(*) OVER (PARTITION BY symbol) AS lo FROM lr),
c AS (SELECT symbol, hi, lo, CASE WHEN r < median THEN exp((r - median) / scale) / 2 ELSE 1 - exp(-(r - median) / scale) / 2 END AS l,
  CASE WHEN r > mean THEN 1 - {_TAIL} ELSE {_TAIL} END AS n FROM k JOIN f USING (symbol) JOIN g USING (symbol))
SELECT symbol, round(max(greatest(hi - l, l - lo)), 6) AS ks_laplace, round(max(greatest(hi - n, n - lo)), 6) AS ks_normal FROM c GROUP BY 1""")
def _(spark, d):
    return rounded(R.ks_distances(log_returns(spark, d), K))


@query("ag37_compare_series", """
WITH j AS (SELECT symbol, t, abs(a - b) AS d, abs(a - b) <= 1e-5 + 1e-5 * abs(b) AS ok FROM (
  SELECT symbol, t, close AS a, close + CASE WHEN t % 7 = 0 THEN symbol ELSE 0 END AS b FROM bars_m))
SELECT count(*) AS n, max(d) AS max_diff, round(avg(d), 6) AS mean_diff, bool_and(ok) AS all_close,
  arg_max(symbol, (d, -symbol, -t)) AS worst_symbol, arg_max(t, (d, -symbol, -t)) AS worst_t FROM j""")
def _(spark, d):
    a = V.bars_m(spark, d).select("symbol", "t", "close")
    b = a.withColumn("close", F.col("close") + F.when(F.col("t") % 7 == 0, F.col("symbol")).otherwise(0))
    return rounded(R.compare(a, b, ["symbol", "t"], "close"))
