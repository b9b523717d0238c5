"""The daily metric job: bars, sweeps, volume profile, size tiers, minute flow and cancels of every stock-day from one pass over the deals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.operators import flow as O
from tidemark.operators import profile as P
from tidemark.session import stage

DAY = ["SecuCode", "TradingDay"]
CANCELS = [f"cancel{side}_vol_{tier}" for side in ("buy", "sell") for tier in C.TIERS]


def daily_bars(deals: DataFrame) -> DataFrame:
    """Open, high, low, close, volume, turnover and number of the trades of a stock-day."""
    trades = deals.where(C.is_trade(F.col("Side")))
    return trades.groupBy(*DAY).agg(
        F.min_by("Price", O.deal_key()).alias("open"), F.max("Price").alias("high"), F.min("Price").alias("low"),
        F.max_by("Price", O.deal_key()).alias("close"), F.sum("Volume").alias("volume"),
        F.sum(F.col("Price") * F.col("Volume")).alias("turnover"), F.count(F.lit(1)).alias("trades"))


def daily_metrics(
    deals: DataFrame, cuts: DataFrame, cancel_cuts: DataFrame, pairs: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """One row per stock-day that trades. The deals are written once, and every part reads its columns of that table.

    ``cuts`` and ``cancel_cuts``: tier limits by stock and book, of orders and of cancels. ``pairs``: volume at price to the days that make
    up each day's profile. The tier baseline (p70, p95, p995 of all orders) is the stock's over all days given, and stands on
    each of its days.
    """
    deals = stage(deals.select(*DAY, "DealID", "DealTime", "BuyID", "SellID", "Price", "Volume", "Side"))
    bars = stage(daily_bars(deals))
    at_price = stage(P.volume_at_price(deals))
    profile = P.profile_metrics(at_price, stage(pairs(at_price)), bars.select(*DAY, "close"))
    flow = O.minute_flow(deals, cuts).groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("minutes"), *[F.sum(f"deal_{c}_vol_Mega").alias(f"{c}_mega") for c in O.CATEGORIES])
    cancels = O.minute_cancels(deals, cancel_cuts).groupBy(*DAY).agg(*[F.sum(c).alias(c) for c in CANCELS])
    orders = stage(O.order_sums(deals))  # for the sweeps and the tiers
    tiers = O.tier_thresholds(orders).where("book = 'total'").select(
        "SecuCode", *[F.col(p).alias(f"order_{p}") for p in ("p70", "p95", "p995")])
    out = bars.drop("close").join(O.order_sweep_metrics(orders), DAY).join(flow, DAY).join(profile, DAY).join(tiers, "SecuCode")
    return out.join(cancels, DAY, "left").fillna(0, CANCELS)
