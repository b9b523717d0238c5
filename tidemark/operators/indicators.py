"""Technical indicators as columns of a ``Series`` (bounded frames) or as ``decay`` recursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import POS, Decay, Series, decay, number_rows, open_series

EPS = 1e-8


def true_range(s: Series) -> Column:
    prev = s.lag("close")
    return F.when(
        F.col(POS) > 1,
        F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )


def emas(bars: DataFrame, keys: list[str], order: list[str], bucket: str, column: str, spans: list[int],
         block: int | None = None) -> DataFrame:
    """EMA columns ``ema_n``; the numbered rows keep ``_pos``."""
    rows = bars if POS in bars.columns else number_rows(bars, keys, order, bucket)
    specs = [Decay(f"ema_{n}", column, n) for n in spans]
    return decay(rows, keys, specs, **({"block": block} if block else {}))


def macd(bars: DataFrame, keys: list[str], order: list[str], bucket: str,
         fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, its signal line, and the sign of their crossing (1 up, -1 down, 0 none)."""
    e = emas(bars, keys, order, bucket, "close", [fast, slow])
    e = e.withColumn("macd", F.col(f"ema_{slow}") * -1 + F.col(f"ema_{fast}"))
    e = decay(e, keys, [Decay("signal", "macd", signal, start=slow)])
    s = open_series(e, keys, order, bucket, back=1)
    gap = F.col("macd") - F.col("signal")
    return s.add(_gap=gap).add(cross=crossing(s.add(_gap=gap), "_gap")).close(keep_pos=True).drop("_gap")


def crossing(s: Series, gap: str) -> Column:
    """Sign of a crossing: 1 where ``gap`` turns positive from <= 0, -1 where it turns negative."""
    before = s.lag(gap)
    return (
        F.when((F.col(gap) > 0) & (before <= 0), 1).when((F.col(gap) < 0) & (before >= 0), -1).otherwise(0)
    )


def atr(bars: DataFrame, keys: list[str], order: list[str], bucket: str, n: int = 14,
        out: str = "atr") -> DataFrame:
    """Wilder ATR: true range from the second bar, seeded with its mean, then ``(n-1)/n`` smoothing."""
    s = open_series(bars, keys, order, bucket, back=1)
    rows = s.add(tr=true_range(s)).close(keep_pos=True)
    return decay(rows, keys, [Decay(out, "tr", n, alpha=1.0 / n, start=2)])


def mfi(s: Series, n: int = 14) -> Series:
    """Money flow index from typical price (scaled by 3, which cancels) and volume."""
    s = s.add(_tp=F.col("high") + F.col("low") + F.col("close"))
    s = s.add(_prev=s.lag("_tp"))
    flow = F.col("_tp") * F.col("volume")
    s = s.add(
        _up=F.when(F.col("_tp") > F.col("_prev"), flow).otherwise(0),
        _down=F.when(F.col("_tp") < F.col("_prev"), flow).otherwise(0),
    )
    up, down = F.sum("_up").over(s.last(n)), F.sum("_down").over(s.last(n))
    return s.add(mfi=s.full(F.coalesce(F.try_divide(up, up + down), F.lit(0.0)) * 100, n + 1))


def stochastic(s: Series, k: int = 14, d: int = 3, atr_n: int = 14, min_atr: float = 0.02) -> Series:
    """%K, %D, and entry/exit flags with a minimum ATR/price."""
    low, high = F.min("low").over(s.last(k)), F.max("high").over(s.last(k))
    s = s.add(k=s.full(F.try_divide(F.col("close") - low, high - low) * 100, k), _tr=true_range(s))
    s = s.add(
        d=s.full(F.avg("k").over(s.last(d)), k + d - 1),
        atr=s.full(F.avg("_tr").over(s.last(atr_n)), atr_n + 1),
    )
    lively = F.col("atr") / F.col("close") > min_atr
    return s.add(
        entry=F.coalesce((F.col("k") < 20) & (F.col("k") > F.col("d")) & lively, F.lit(False)),
        exit=F.coalesce(F.col("k") > 80, F.lit(False)),
    )


def row_cv(columns: list[str], eps: float = 0.0, population: bool = False) -> Column:
    """Coefficient of variation (percent) of several columns of one row."""
    n = len(columns)
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / n
    squares = sum(((F.col(c) - mean) ** 2 for c in columns[1:]), (F.col(columns[0]) - mean) ** 2)
    return F.sqrt(squares / (n if population else n - 1)) / (mean + eps) * 100


def convergence(s: Series, column: str, spans: list[int]) -> Series:
    """Moving averages ``ma_n`` and their coefficient of variation ``conv``."""
    s = s.add(**{f"ma_{n}": s.sma(column, n) for n in spans})
    return s.add(conv=row_cv([f"ma_{n}" for n in spans]))


def quotient(x: Column, y: Column) -> Column:
    """``x / y`` as a double. By zero it is the limit, infinity with the sign of ``x`` (NaN for 0/0), instead of an error: a range over
    a price of 0 is greater than any other."""
    return F.coalesce(F.try_divide(x, y), x * F.lit(float("inf")))


def vcp(s: Series, n: int, threshold: float) -> Series:
    """Volatility contraction: calmer than ``n`` rows ago in mean and spread, and close above the pivot."""
    s = s.add(vcp=quotient(F.col("high") - F.col("low"), F.col("low")))
    s = s.add(vcp_range=s.sma("vcp", n), vcp_std=s.std("vcp", n), _high=s.high("high", n))
    s = s.add(_r=s.lag("vcp_range", n), _s=s.lag("vcp_std", n), pivot_high=s.lag("_high"))
    calm = (F.col("vcp_range") < F.col("_r") * threshold) & (F.col("vcp_std") < F.col("_s") * threshold)
    return s.add(vcp_signal=F.coalesce(calm & (F.col("close") > F.col("pivot_high")), F.lit(False)))


def range_contraction(s: Series, n: int = 20, long: int = 60, ratio: float = 0.6) -> Series:
    """Range of ``n`` rows below ``ratio`` times its own mean, and a close above the prior ``n``-row high."""
    high, low = s.high("high", n), s.low("low", n)
    s = s.add(price_range=quotient(high - low, low))
    s = s.add(
        _mean=s.full(F.avg("price_range").over(s.last(long)), n + long - 1), _prior=s.lag(high := s.high("high", n)))
    s = s.add(contracted=F.coalesce(F.col("price_range") < F.col("_mean") * ratio, F.lit(False)))
    return s.add(
        breakout=F.coalesce(F.col("close") > F.col("_prior"), F.lit(False)),
        after_contraction=F.coalesce(s.lag("contracted"), F.lit(False)),
    )


def donchian(s: Series, n: int) -> dict[str, Column]:
    """Channel of the ``n-1`` rows before the current one."""
    prior = s.rows(-(n - 1), -1)
    return {
        f"upper_{n}": s.full(F.max("high").over(prior), n), f"lower_{n}": s.full(F.min("low").over(prior), n)}


def trend_line(s: Series, column: str, n: int) -> dict[str, Column]:
    """Least-squares slope and current value over the last ``n`` rows."""
    x = F.col(POS).cast("double")
    y = F.col(column).cast("double")
    slope, start = F.regr_slope(y, x).over(s.last(n)), F.regr_intercept(y, x).over(s.last(n))
    return {"slope": s.full(slope, n), "fitted": s.full(start + slope * x, n)}


def log_slope(s: Series, column: str, span: int, window: int) -> Column:
    """Ten times the least-squares slope of ln(SMA) over ``window`` rows; ``ln_span`` must exist."""
    y, x = F.col(f"ln_{span}"), F.col(POS).cast("double")
    return s.full(F.regr_slope(y, x).over(s.last(window)) * 10, span + window - 1)


def rolling_r2(s: Series, column: str, n: int) -> Column:
    """R squared of a straight line over ``n`` rows; 0 where the values do not vary."""
    y, x = F.col(column).cast("double"), F.col(POS).cast("double")
    varies = F.max(y).over(s.last(n)) > F.min(y).over(s.last(n))
    return s.full(F.when(varies, F.regr_r2(y, x).over(s.last(n))).otherwise(0.0), n)


def sector_trend(s: Series, column: str = "ohlc", window: int = 5, r2_window: int = 5,
                 threshold: float = 5.0) -> Series:
    """Mixed slope of three averages, straightness, and the selection flag."""
    s = s.add(**{f"ln_{n}": F.log(s.sma(column, n)) for n in (5, 10, 20)})
    s = s.add(**{f"slope_{n}": log_slope(s, column, n, window) for n in (5, 10, 20)})
    s = s.add(
        avg_slope=0.4 * F.col("slope_5") + 0.2 * F.col("slope_10") + 0.4 * F.col("slope_20"),
        r2=rolling_r2(s, column, r2_window),
    )
    angle = F.degrees(F.atan(15 * F.col("r2") * F.col("avg_slope")))
    return s.add(angle=angle, selected=F.coalesce((angle > threshold) & (F.col("slope_20") > 0.001), F.lit(False)))


def log_return(s: Series, column: str = "close", n: int = 1) -> Column:
    return F.log(F.col(column) / s.lag(column, n))
