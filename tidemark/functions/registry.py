"""Named strategies: pure functions from a bars table and parameters to a signal or weight table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import Series, open_series
from tidemark.operators import indicators as I
from tidemark.operators import screens as S

Strategy = Callable[..., DataFrame]
_STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    def add(fn: Strategy) -> Strategy:
        _STRATEGIES[name] = fn
        return fn

    return add


def run_strategy(name: str, bars: DataFrame, **params) -> DataFrame:
    """Signals of a registered strategy; unknown names list the known ones."""
    if name not in _STRATEGIES:
        raise KeyError(f"no strategy {name!r}; known: {sorted(_STRATEGIES)}")
    return _STRATEGIES[name](bars, **params)


def _series(bars: DataFrame, back: int, bucket: str) -> Series:
    return open_series(bars, ["symbol"], ["t"], bucket, back)


@strategy("cross_over")
def cross_over(bars: DataFrame, fast: int = 5, slow: int = 20, bucket: str = "t div 250") -> DataFrame:
    s = _series(bars, slow + 1, bucket)
    s = s.add(_gap=s.full(s.sma("close", fast) - s.sma("close", slow), slow))
    return s.add(signal=I.crossing(s, "_gap")).close().select("symbol", "t", "signal")


@strategy("channel_breakout")
def channel_breakout(bars: DataFrame, entry: int = 20, exit: int = 10, bucket: str = "t div 250") -> DataFrame:
    s = _series(bars, max(entry, exit), bucket)
    s = s.add(**I.donchian(s, entry), **{k: v for k, v in I.donchian(s, exit).items()})
    up, down = F.col("close") > F.col(f"upper_{entry}"), F.col("close") < F.col(f"lower_{exit}")
    return s.add(signal=F.when(up, 1).when(down, -1).otherwise(0)).close().select("symbol", "t", "signal")


@strategy("inverse_volatility")
def inverse_volatility(bars: DataFrame, n: int = 21, bucket: str = "t div 250") -> DataFrame:
    return S.inverse_volatility(_series(bars, n + 1, bucket), "t", n)


@strategy("mean_reversion")
def mean_reversion(bars: DataFrame, lookback: int = 60, offset: int = 1, n: int = 25, q_std: float = 0.1,
                   q_vol: float = 0.1, mode: str = "union", bucket: str = "t div 250") -> DataFrame:
    s = _series(bars, max(lookback, 126) + offset + 1, bucket)
    return S.reversion_targets(s, "t", lookback, offset, n, q_std, q_vol, mode)
