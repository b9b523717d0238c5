"""Return and risk statistics on price, trade and equity tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.functions.series import (
    BKT, POS, Series, _distribution, exact_percentiles, number_rows, open_series, running,
)
from tidemark.session import stage

YEAR_DAYS = 244


def last_n(df: DataFrame, keys: list[str], t: str, bucket: str, n: int) -> DataFrame:
    """Last ``n`` rows of each key, by position and key size."""
    rows = number_rows(df, keys, [t], bucket)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return rows.join(size, keys).where(F.col(POS) > F.col("_size") - n).drop("_size", POS)


def best_leg(bars: DataFrame, keys: list[str], t: str, bucket: str, days: Column | None = None) -> DataFrame:
    """Largest rise against the running low, and the risk inside that leg.

    The running minimum carries its own position, so the row of the largest gain already knows the start of
    its leg; the running maximum inside the leg likewise knows the peak before the trough.
    ``days`` is the calendar length from ``start_t`` and ``end_t``; bars by default.
    """
    close, pos = F.col("close"), F.col(POS)
    rows = stage(number_rows(bars.select(*keys, t, "close", "volume"), keys, [t], bucket))
    low = running(rows, keys, [t], bucket, {"_low": ("min", F.struct(close.alias("c"), pos.alias("p"), F.col(t).alias("t")))})
    gain = (close - F.col("_low.c")) / F.col("_low.c")
    legs = (
        low.groupBy(*keys)
        .agg(
            F.max(F.struct(gain.alias("g"), (-pos).alias("np"), F.col(t).alias("t"), F.col("_low.p").alias("sp"),
                           F.col("_low.t").alias("st"))).alias("_b"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .select(*keys, F.col("_b.g").alias("max_gain"), F.col("_b.st").alias("start_t"), F.col("_b.t").alias("end_t"),
                F.col("_b.sp").alias("_sp"), (-F.col("_b.np")).alias("_ep"))
        .where("max_gain > 0")
    )
    legs = stage(legs)
    inside = stage(rows.join(legs, keys).where(pos.between(F.col("_sp"), F.col("_ep"))))
    peak = running(inside, keys, [t], bucket, {"_peak": ("max", F.struct(close.alias("c"), (-pos).alias("np")))})
    dd = (close - F.col("_peak.c")) / F.col("_peak.c")
    s = open_series(peak.withColumn("_dd", dd), keys, [t], bucket, back=1)
    s = s.add(_r=F.when(pos > F.col("_sp"), s.pct("close")))
    stats = s.close(keep_pos=True).groupBy(*keys).agg(
        F.min(F.struct(F.col("_dd").alias("d"), pos.alias("p"), F.col("_peak.np").alias("np"))).alias("_w"),
        F.avg("_r").alias("_mean"), F.stddev_pop("_r").alias("_std"),
        (F.sum("volume") / F.count("volume")).alias("mean_volume"),
    )
    median = exact_percentiles(inside, keys, "volume", {"median_volume": 0.5})
    sharpe = F.when(F.col("_std") > 0, (F.col("_mean") - 0.02 / YEAR_DAYS) / F.col("_std") * math.sqrt(YEAR_DAYS))
    mdd = F.col("_w.d")
    return legs.join(stats, keys).join(median, keys).select(
        *keys, "max_gain", "start_t", "end_t",
        (days if days is not None else F.col("end_t") - F.col("start_t")).alias("duration"),
        mdd.alias("mdd"), (F.col("_w.p") + F.col("_w.np")).alias("mdd_duration"),
        (F.col("max_gain") / (F.abs(mdd) + 0.10)).alias("calmar"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"),
        "mean_volume", "median_volume",
    )


def drawdown_rows(equity: DataFrame, keys: list[str], t: str, bucket: str) -> DataFrame:
    """Each row with position, running peak, drawdown (share and money) and bars since the last new high.

    The running maximum carries the first position of its value, which is the last strict new high.
    """
    rows = stage(number_rows(equity, keys, [t], bucket))
    best = F.struct(F.col("value").alias("v"), (-F.col(POS)).alias("np"))
    out = running(rows, keys, [t], bucket, {"_peak": ("max", best)}).withColumn("peak", F.col("_peak.v"))
    drop = F.col("peak") - F.col("value")
    return out.withColumns(
        {"drawdown": drop / F.col("peak"), "money": drop, "bars_down": F.col(POS) + F.col("_peak.np")}
    ).drop("_peak")


def portfolio_scores(equity: DataFrame, keys: list[str], t: str, bucket: str) -> DataFrame:
    """Annual return, maximum drawdown and its duration, Sharpe and final value per run."""
    s = open_series(drawdown_rows(equity, keys, t, bucket), keys, [t], bucket, back=1)
    rows = s.add(_r=s.pct("value")).close()
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", t).alias("init"), F.max_by("value", t).alias("final_value"),
        F.max("drawdown").alias("max_dd"), F.max("bars_down").alias("dd_days"),
        F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"), F.avg((F.col("_r") > 0).cast("double")).alias("win_rate"),
    )
    ratio = F.col("final_value") / F.col("init")
    ann = F.when(ratio > 0, F.pow(ratio, F.lit(YEAR_DAYS) / F.col("n")) - 1).otherwise(-1.0)
    sharpe = F.when(F.col("_s") > 1e-9, F.col("_m") / F.col("_s") * math.sqrt(YEAR_DAYS)).otherwise(0.0)
    return stats.withColumns({"ann_ret": ann, "sharpe": sharpe}).drop("_m", "_s")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def grid_score() -> Column:
    """Score of a grid point from ann_ret, max_dd, sharpe and win_rate."""
    calmar = F.col("ann_ret") / F.greatest(F.col("max_dd"), F.lit(0.001))
    return 0.4 * calmar + 0.2 * clip(F.col("sharpe"), -5.0, 5.0) + 0.2 * F.col("win_rate")


def single_score() -> Column:
    """Score of one run; the return is clipped and the drawdown length counts."""
    calmar = clip(F.col("ann_ret"), -0.99, 2.0) / F.greatest(F.col("max_dd"), F.lit(0.01))
    length = clip(1 - F.col("dd_days") / YEAR_DAYS, 0.0, 1.0)
    return 0.4 * calmar + 0.2 * length + 0.2 * clip(F.col("sharpe"), -5.0, 5.0) + 0.2 * F.col("win_rate")


def robustness(slices: DataFrame, params: list[str]) -> DataFrame:
    """Mean, spread, stability and share of profitable slices of each parameter set."""
    out = slices.groupBy(*params).agg(
        F.avg("score").alias("avg_score"), F.coalesce(F.stddev_samp("score"), F.lit(1.0)).alias("score_std"),
        F.avg((F.col("score") > 0).cast("double")).alias("profitable_slice_pct"),
    )
    sharpe = F.col("avg_score") / (F.col("score_std") + 1e-6)
    return out.withColumns({
        "stability_sharpe": sharpe, "final_robust_rank": sharpe * F.col("profitable_slice_pct"),
        "stability_score": F.col("avg_score") / (1 + F.col("score_std")),
    })


def heat_table(scores: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Mean score by two parameters; the column values are given, so the schema is fixed."""
    return scores.groupBy(row).pivot(column, values).agg(F.avg("score"))


def total_returns(bars: DataFrame, keys: list[str], t: str) -> DataFrame:
    first, last = F.min_by("close", t), F.max_by("close", t)
    rows = bars.groupBy(*keys).agg((last / first - 1).alias("total_return"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("annual_return", F.pow(1 + F.col("total_return"), F.lit(255) / F.col("n")) - 1)


def moments(returns: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    return returns.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.var_samp(r).alias("variance"),
        F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"),
    )


def value_at_risk(returns: DataFrame, keys: list[str], r: str = "r", p: float = 0.05) -> DataFrame:
    """Historical VaR (the next observation above the quantile) and the mean strictly below it."""
    var = exact_percentiles(returns, keys, r, {"var": p}, method="higher")
    tail = returns.join(var, keys).groupBy(*keys).agg(
        F.first("var").alias("var"), F.avg(F.when(F.col(r) < F.col("var"), F.col(r))).alias("cvar"))
    return tail


def hurst(s: Series, column: str, lags: range = range(2, 100)) -> DataFrame:
    """Twice the slope of log sqrt(std of lagged differences) on log lag; one pass for all lags."""
    top = max(lags)
    s = s.add(_past=F.collect_list(column).over(s.rows(-top, 0)))
    # The array ends with the current value; a lag longer than the array is not there yet.
    reach = F.filter(F.array(*[F.lit(n) for n in lags]), lambda n: n < F.size("_past"))
    reach = F.transform(reach, lambda n: F.struct(
        n.alias("lag"), (F.col(column) - F.element_at("_past", F.size("_past") - n)).alias("d")))
    rows = s.df.where("_core").select(*s.keys, F.explode(reach).alias("_p")).select(*s.keys, "_p.*")
    spread = rows.groupBy(*s.keys, "lag").agg(F.stddev_pop("d").alias("_s"))
    return spread.groupBy(*s.keys).agg(
        (F.regr_slope(F.log(F.sqrt("_s")), F.log("lag")) * 2).alias("hurst"))


def variance_ratio(s: Series, column: str, lag: int = 2) -> DataFrame:
    """Variance of ``lag``-row differences against ``lag`` times that of one-row differences."""
    s = s.add(_d=F.col(column) - s.lag(column), _k=F.col(column) - s.lag(column, lag))
    sums = s.df.where("_core").groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_d").alias("d"), F.sum(F.col("_d") ** 2).alias("dd"),
        F.sum("_k").alias("k"), F.sum(F.col("_k") ** 2).alias("kk"))
    n, mu = F.col("n"), F.col("d") / F.col("n")
    b = (F.col("dd") - 2 * mu * F.col("d") + (n - 1) * mu * mu) / (n - 1)
    m = (n - lag + 1) * (1 - F.lit(lag) / n)
    t = (F.col("kk") - 2 * lag * mu * F.col("k") + (n - lag) * (lag * mu) ** 2) / m
    return sums.select(*s.keys, (t / (lag * b)).alias("variance_ratio"))


def half_life(s: Series, column: str, swapped: bool = False) -> DataFrame:
    """Mean-reversion half-life from the slope between levels and changes (first elements are 0).

    By default the level is regressed on the change; ``swapped`` regresses the change on the level.
    """
    s = s.add(_lag=F.coalesce(s.lag(column), F.lit(0)), _d=F.coalesce(F.col(column) - s.lag(column), F.lit(0)))
    y, x = ("_d", "_lag") if swapped else ("_lag", "_d")
    slope = s.df.where("_core").groupBy(*s.keys).agg(F.regr_slope(y, x).alias("slope"))
    return slope.withColumn("half_life", -math.log(2) / F.col("slope"))


def trade_statistics(trades: DataFrame, keys: list[str], order: list[str], bucket: str) -> DataFrame:
    """Counts, sums, averages, extremes, streaks, profit factor and quality per run, by direction too.

    A streak of wins keeps ``trades so far - wins so far`` constant, a streak of losses keeps the wins so
    far, so two running sums identify all streaks.
    """
    won = F.col("pnl") >= 0
    pnl = F.col("pnl")
    cum = running(trades, keys, order, bucket, {"_n": ("sum", F.lit(1)), "_w": ("sum", won.cast("bigint"))})
    run = F.when(won, F.col("_n") - F.col("_w")).otherwise(F.col("_w"))
    streaks = (
        cum.groupBy(*keys, won.alias("_won"), run.alias("_s")).agg(F.count(F.lit(1)).alias("_len"))
        .groupBy(*keys).agg(
            F.coalesce(F.max(F.when(F.col("_won"), F.col("_len"))), F.lit(0)).alias("longest_win"),
            F.coalesce(F.max(F.when(~F.col("_won"), F.col("_len"))), F.lit(0)).alias("longest_loss"))
    )
    out = [
        F.count(F.lit(1)).alias("total"), F.count(F.when(won, 1)).alias("won"), F.count(F.when(~won, 1)).alias("lost"),
        F.sum(pnl).alias("net"), F.coalesce(F.sum(F.when(won, pnl)), F.lit(0)).alias("gross_won"),
        F.coalesce(F.sum(F.when(~won, pnl)), F.lit(0)).alias("gross_lost"),
        F.max(F.when(won, pnl)).alias("max_won"), F.min(F.when(~won, pnl)).alias("max_lost"),
        F.avg(pnl).alias("_avg"), F.stddev_pop(pnl).alias("_std"),
    ]
    for d in ("long", "short"):
        on = F.col("direction") == d
        out += [F.count(F.when(on, 1)).alias(d), F.count(F.when(on & won, 1)).alias(f"{d}_won"),
                F.coalesce(F.sum(F.when(on, pnl)), F.lit(0)).alias(f"{d}_net")]
    stats = trades.groupBy(*keys).agg(*out).join(streaks, keys)
    sqn = F.when(F.col("_std") > 0, F.sqrt("total") * F.col("_avg") / F.col("_std"))
    return stats.withColumns({
        "avg_net": F.col("net") / F.col("total"),
        "avg_won": F.try_divide("gross_won", "won"), "avg_lost": F.try_divide("gross_lost", "lost"),
        "pct_winning": F.col("won") / F.col("total") * 100,
        "profit_factor": F.try_divide(F.col("gross_won"), -F.col("gross_lost")),
        "sqn": sqn, "sqn_rating": C.quality_band(sqn),
    }).drop("_avg", "_std")


def equity_statistics(equity: DataFrame, keys: list[str], t: str, bucket: str, periods: int = 252,
                      risk_free: float = 0.035, sigma_max: float = 0.2, tau: float = 2.0) -> DataFrame:
    """Growth rate, Sharpe, Sortino, drawdown (percent, money, length) and variability-weighted return."""
    free = (1 + risk_free) ** (1 / periods) - 1
    s = open_series(drawdown_rows(equity, keys, t, bucket), keys, [t], bucket, back=1)
    rows = stage(s.add(_x=s.pct("value") - free).close(keep_pos=True))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", t).alias("start_value"), F.max_by("value", t).alias("end_value"),
        F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"),
        F.sqrt(F.avg(F.when(F.col("_x") < 0, F.col("_x") ** 2).when(F.col("_x") >= 0, 0.0))).alias("_down"),
        F.max("drawdown").alias("_dd"), F.max("money").alias("max_money_drawdown"),
        F.max("bars_down").alias("max_drawdown_length"),
    )
    rate = F.log(F.col("end_value") / F.col("start_value")) / (F.col("n") - 1)
    base = base.withColumn("_rate", rate)
    trend = rows.select(*keys, F.col(POS), "value").join(base.select(*keys, "start_value", "_rate"), keys)
    gap = F.col("value") / (F.col("start_value") * F.exp(F.col("_rate") * (F.col(POS) - 1))) - 1
    spread = trend.groupBy(*keys).agg(F.stddev_samp(gap).alias("_gap"))
    growth = (F.exp(F.col("_rate") * periods) - 1) * 100
    year = math.sqrt(periods)
    return base.join(spread, keys).select(
        *keys, "n", "start_value", "end_value",
        ((F.col("end_value") / F.col("start_value") - 1) * 100).alias("roi"), growth.alias("cagr"),
        (F.col("_m") / F.col("_s") * year).alias("sharpe"), F.try_divide(F.col("_m") * year, F.col("_down")).alias("sortino"),
        (F.col("_dd") * 100).alias("max_drawdown"), "max_money_drawdown", "max_drawdown_length",
        (growth * (1 - F.pow(F.col("_gap") / sigma_max, tau))).alias("vwr"),
    )


def exposure(positions: DataFrame, equity: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Mean number of open positions and mean gross leverage per run; ``positions``: run, t, name, amount."""
    day = positions.groupBy(*keys, t).agg(
        F.count(F.when(F.col("amount") != 0, 1)).alias("_open"), F.sum(F.abs("amount")).alias("_gross"))
    return day.join(equity, [*keys, t]).groupBy(*keys).agg(
        F.avg("_open").alias("avg_positions"), F.avg(F.abs(F.col("_gross") / F.col("value"))).alias("avg_leverage"))


def period_returns(equity: DataFrame, keys: list[str], t: str, period: Column, bucket: str) -> DataFrame:
    """Last value per period and its percent change on the period before."""
    last = equity.withColumn("period", period).groupBy(*keys, "period").agg(F.max_by("value", t).alias("value"))
    s = open_series(last, keys, ["period"], bucket, back=1)
    return s.add(ret=s.pct("value") * 100).close()


def normalised(df: DataFrame, keys: list[str], t: str, value: str, base: float = 100.0) -> DataFrame:
    """Curve with its first value set to ``base``."""
    first = df.groupBy(*keys).agg(F.min_by(value, t).alias("_first"))
    return df.join(first, keys).withColumn("curve", F.col(value) / F.col("_first") * base).drop("_first")


def mean_and_covariance(returns: DataFrame, name: str, t: str, periods: int = 252) -> DataFrame:
    """Annualised covariance of every pair of assets of a portfolio (the matrix is the result) and means."""
    a = returns.select(F.col(name).alias("a"), t, F.col("r").alias("x"))
    b = returns.select(F.col(name).alias("b"), t, F.col("r").alias("y"))
    return a.join(b, t).groupBy("a", "b").agg(
        (F.covar_samp("x", "y") * periods).alias("cov"), (F.avg("x") * periods).alias("mean_a"))


# Rational approximation of the error function (Abramowitz and Stegun, 7.1.26), off by 1.5e-7 at most.
ERF_SCALE = 0.3275911
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Spark has no error function)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + ERF_SCALE * x)
    series = F.lit(0.0)
    for a in reversed(ERF):
        series = (series + a) * t
    tail = series * F.exp(-x * x) / 2
    return F.when(z > 0, 1 - tail).otherwise(tail)


def fits(returns: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    """Normal (mean, population std) and Laplace (median, mean absolute deviation) parameters."""
    median = exact_percentiles(returns, keys, r, {"median": 0.5})
    return returns.join(median, keys).groupBy(*keys).agg(
        F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.first("median").alias("median"),
        F.avg(F.abs(F.col(r) - F.col("median"))).alias("scale"))


def ks_distances(returns: DataFrame, keys: list[str], r: str = "r", normal: bool = True) -> DataFrame:
    """Kolmogorov-Smirnov distance of both fits, from cumulative counts of distinct values."""
    from pyspark.sql import Window

    dist, buckets = _distribution(returns, keys, r)
    inside = Window.partitionBy(*keys, BKT).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = dist.join(buckets, [*keys, BKT]).withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    rows = rows.join(fits(returns, keys, r), keys)
    high, low = F.col("_upto") / F.col("_total"), (F.col("_upto") - F.col("_n")) / F.col("_total")
    d = (F.col("_v") - F.col("median")) / F.col("scale")
    laplace = F.when(d < 0, F.exp(d) / 2).otherwise(1 - F.exp(-d) / 2)
    out = [F.max(F.greatest(high - laplace, laplace - low)).alias("ks_laplace")]
    if normal:
        rows = rows.withColumn("_cdf", normal_cdf((F.col("_v") - F.col("mean")) / F.col("std")))
        out.append(F.max(F.greatest(high - F.col("_cdf"), F.col("_cdf") - low)).alias("ks_normal"))
    return rows.groupBy(*keys).agg(*out)


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str, atol: float = 1e-5) -> DataFrame:
    """Largest and mean absolute difference, closeness flag, and where the largest is (lowest key on ties)."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys)
    diff = F.abs(F.col("x") - F.col("y"))
    rows = both.withColumns({"d": diff, "close": diff <= atol + 1e-5 * F.abs(F.col("y"))})
    worst = F.max_by(F.struct(*keys), F.struct(F.col("d"), *[(-F.col(k)).alias(f"n_{k}") for k in keys]))
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max("d").alias("max_diff"), (F.sum("d") / F.count("d")).alias("mean_diff"),
        F.bool_and("close").alias("all_close"), worst.alias("_w"))
    return out.select("n", "max_diff", "mean_diff", "all_close", *[F.col(f"_w.{k}").alias(f"worst_{k}") for k in keys])
