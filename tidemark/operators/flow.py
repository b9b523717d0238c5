"""Order-flow metrics of executions: sweeps, size tiers, minute flow, cancels.

An order has few trades, a minute of a stock few orders: sums kept before the shuffle would hold nearly every row in the
memory of the task that reads it and shuffle wider rows. So the narrow rows are dealt out by order, or by minute of a
stock, and summed there; no task gets a whole stock or day. Days are made of those sums, combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.functions.series import dealt, exact_percentiles, open_series
from tidemark.session import stage

DAY = ["SecuCode", "TradingDay"]
ORDER = [*DAY, "_buy", "OrderID"]
EPS = 1e-8
TIER_PROBS = {"p70": 0.70, "p95": 0.95, "p995": 0.995}
CATEGORIES = ["act_buy", "pas_buy", "act_sell", "pas_sell"]


def deal_key() -> Column:
    """Order of deals inside a stock-day in one number: clock, then the deal's number, any non-negative long."""
    return C.order_key((F.col("DealTime"), 9), (F.col("DealID"), 19))


def both_sides(deals: DataFrame) -> DataFrame:
    """Each trade twice: once under its buy order, once under its sell order."""
    sides = F.array(
        F.struct(F.lit("buy").alias("side"), F.col("BuyID").alias("OrderID")),
        F.struct(F.lit("sell").alias("side"), F.col("SellID").alias("OrderID")),
    )
    return (
        deals.where(C.is_trade(F.col("Side")))
        .withColumn("_s", F.explode(sides))
        .select("*", F.col("_s.side").alias("order_side"), "_s.OrderID")
        .drop("_s")
    )


def _by_order(deals: DataFrame, *columns: str | Column) -> DataFrame:
    """Each trade under its buy (``_buy``) and its sell order, with all trades of an order in one task."""
    rows = both_sides(deals).select(*DAY, (F.col("order_side") == "buy").alias("_buy"), "OrderID", *columns)
    return dealt(rows, ORDER)


def _side_names(orders: DataFrame) -> DataFrame:
    names = [F.when(F.col("_buy"), "buy").otherwise("sell").alias("order_side") if c == "_buy" else c for c in orders.columns]
    return orders.select(*names)


def order_executions(deals: DataFrame) -> DataFrame:
    """Per order: times, price range, first/last price, volume, turnover, price levels and fills."""
    at = deal_key()
    return _side_names(_by_order(deals, "DealTime", "DealID", "Price", "Volume").groupBy(*ORDER).agg(
        F.min("DealTime").alias("start_time"),
        F.max("DealTime").alias("end_time"),
        F.min("Price").alias("price_min"),
        F.max("Price").alias("price_max"),
        F.min_by("Price", at).alias("price_first"),
        F.max_by("Price", at).alias("price_last"),
        F.sum("Volume").alias("volume"),
        F.sum(F.col("Price") * F.col("Volume")).alias("turnover"),
        F.count_distinct("Price").alias("depth"),
        F.count(F.lit(1)).alias("fills"),
        F.bool_or(C.in_auction(F.col("DealTime"))).alias("in_auction"),
    ))


def sweeps(deals: DataFrame) -> DataFrame:
    """Orders filled more than once."""
    return order_executions(deals).where("fills > 1")


def sweep_metrics(deals: DataFrame) -> DataFrame:
    """Daily sweep metrics; an empty side has depth 1 and zeros elsewhere."""
    return order_sweep_metrics(order_sums(deals))


def order_sums(deals: DataFrame) -> DataFrame:
    """Volume, turnover, price levels and fills of every order of a day."""
    return _side_names(_by_order(deals, "Price", "Volume").groupBy(*ORDER).agg(
        F.sum("Volume").alias("volume"), F.sum(F.col("Price") * F.col("Volume")).alias("turnover"),
        F.count_distinct("Price").alias("depth"), F.count(F.lit(1)).alias("fills")))


def order_sweep_metrics(orders: DataFrame) -> DataFrame:
    """``sweep_metrics`` of ``order_sums``."""

    def pick(side: str, column: str, deep: bool = False) -> Column:
        sweep = (F.col("order_side") == side) & (F.col("fills") > 1)
        return F.when(sweep & (F.col("depth") > 1) if deep else sweep, F.col(column))

    sums = [
        F.sum(F.when(F.col("order_side") == "buy", F.col("volume"))).alias("daily_total_volume"),
        F.sum(F.when(F.col("order_side") == "buy", F.col("turnover"))).alias("daily_total_turnover"),
    ]
    for s in ("buy", "sell"):
        sums += [
            F.coalesce(F.sum(pick(s, "volume")), F.lit(0)).alias(f"daily_{s}_sweep_vol"),
            F.coalesce(F.sum(pick(s, "turnover")), F.lit(0)).alias(f"daily_{s}_sweep_turnover"),
            F.count(pick(s, "fills")).alias(f"{s}_sweep_count"),
            F.coalesce(F.max(pick(s, "depth")), F.lit(1)).alias(f"{s}_max_sweepdepth"),
            F.coalesce(F.avg(pick(s, "depth")), F.lit(1.0)).alias(f"_{s}_depth"),
            F.count(pick(s, "fills", True)).alias(f"_{s}_deep_count"),
            F.coalesce(F.sum(pick(s, "volume", True)), F.lit(0)).alias(f"_{s}_deep_vol"),
        ]
    day = orders.groupBy(*DAY).agg(*sums)
    total = F.col("daily_total_volume")
    out = {}
    for s in ("buy", "sell"):
        vol, deep = F.col(f"daily_{s}_sweep_vol"), F.col(f"_{s}_deep_vol")
        out[f"{s}_sweep_ratio"] = vol / total
        out[f"{s}_multi_depth_ratio"] = F.col(f"_{s}_deep_count") / (F.col(f"{s}_sweep_count") + EPS)
        out[f"{s}_multi_depth_vol_ratio"] = deep / (vol + EPS)
        out[f"{s}_multi_depth_market_ratio"] = deep / total
    net = F.col("daily_buy_sweep_vol") - F.col("daily_sell_sweep_vol")
    out["net_sweep_volume"] = net
    out["sweep_power_bias"] = net / total
    out["buy_sell_sweep_ratio"] = F.col("daily_buy_sweep_turnover") / (F.col("daily_sell_sweep_turnover") + EPS)
    out["sweep_depth_bias"] = F.col("_buy_depth") - F.col("_sell_depth")
    helper = [c for c in day.columns if c.startswith("_")]
    return day.withColumns(out).drop(*helper)


def order_volumes(deals: DataFrame) -> DataFrame:
    """Executed volume of every order of a day."""
    return _side_names(_by_order(deals, "Volume").groupBy(*ORDER).agg(F.sum("Volume").alias("volume")))


def order_tier_sizes(deals: DataFrame) -> DataFrame:
    """Order sizes of every stock-day and side with how many orders have them, and the side's mean order.

    Read in order of ``volume`` and repeated ``orders`` times, the rows of a day and side are its sorted sizes.
    Counts stay small where an array would hold every order of a busy day.
    """
    side = [*DAY, "order_side"]
    counts = order_volumes(deals).groupBy(*side, "volume").agg(F.count(F.lit(1)).alias("orders"))
    means = counts.groupBy(*side).agg((F.sum(F.col("volume") * F.col("orders")) / F.sum("orders")).alias("volume_mean"))
    return counts.join(means, side)


def tier_thresholds(sizes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """70/95/99.5 % order-size cut-offs per stock over the baseline days, for bid, ask and both.

    Sizes are pooled relative to their day's mean, cut exactly, and scaled by the mean of day means.
    """
    by = by or ["SecuCode"]
    day_keys = [*by, "TradingDay"]
    one = F.when(F.col("order_side") == "buy", "bid").otherwise("ask")
    counts = sizes.groupBy(*day_keys, one.alias("book"), "volume").agg(F.count(F.lit(1)).alias("_n"))
    counts = stage(counts)  # sizes repeat, so the counts are far smaller than the orders
    rows = counts.withColumn("book", F.explode(F.array("book", F.lit("total"))))
    means = (
        rows.groupBy(*day_keys, "book")
        .agg((F.sum(F.col("volume") * F.col("_n")) / F.sum("_n")).alias("_mean"))
        .where("_mean > 0")
    )
    pool = rows.join(means, [*day_keys, "book"]).withColumn("_rel", F.col("volume") / F.col("_mean"))
    cuts = exact_percentiles(pool, [*by, "book"], "_rel", TIER_PROBS, weight="_n")
    scale = means.groupBy(*by, "book").agg(F.avg("_mean").alias("_scale"))
    return cuts.join(scale, [*by, "book"]).select(
        *by, "book", *[(F.col(p) * F.col("_scale")).alias(p) for p in TIER_PROBS]
    )


def with_tier(rows: DataFrame, volume: Column, side: Column, thresholds: DataFrame | None) -> DataFrame:
    """Add ``tier``: bid cut-offs for buys, ask cut-offs for sells, defaults where none are known."""
    names = {(book, p): f"_{book}_{p}" for book in ("bid", "ask") for p in TIER_PROBS}
    if thresholds is None:
        rows = rows.withColumns({n: F.lit(None).cast("double") for n in names.values()})
    else:
        cuts = thresholds.groupBy("SecuCode").agg(
            *[F.max(F.when(F.col("book") == book, F.col(p))).alias(n) for (book, p), n in names.items()])
        rows = rows.join(cuts, "SecuCode", "left")
    limit = [
        F.coalesce(
            F.when(side == "buy", F.col(names["bid", p])).otherwise(F.col(names["ask", p])), F.lit(default))
        for p, default in zip(TIER_PROBS, C.DEFAULT_TIERS)
    ]
    return rows.withColumn("tier", C.size_tier(volume, *limit)).drop(*names.values())


def minute_orders(deals: DataFrame) -> DataFrame:
    """(order, minute) sums with the order's day volume and whether it traded actively.

    The window spans the minutes of one order in one day, at most a few hundred rows.
    """
    per_minute = _by_order(deals, C.minute_of(F.col("DealTime")).alias("minute"), "Volume", "Side").groupBy(*ORDER, "minute").agg(
        F.sum("Volume").alias("volume"), F.min("Side").alias("_min"), F.max("Side").alias("_max"))
    order = Window.partitionBy(*ORDER)
    active = F.when(F.col("_buy"), F.min("_min").over(order) == 0).otherwise(F.max("_max").over(order) == 1)
    return _side_names(per_minute.withColumns(
        {"order_volume": F.sum("volume").over(order), "active": active}
    ).drop("_min", "_max"))


def _minute_sums(rows: DataFrame, names: Column, columns: list[str], volume: str) -> DataFrame:
    """Volume of each stock and minute in a column of its own for every name; 0 where there is none."""
    number = F.array_position(F.array(*[F.lit(c) for c in columns]), names) - 1
    rows = dealt(rows.select(*DAY, "minute", number.cast("byte").alias("_c"), volume), [*DAY, "minute"])
    return rows.groupBy(*DAY, "minute").agg(
        *[F.coalesce(F.sum(F.when(F.col("_c") == i, F.col(volume))), F.lit(0)).alias(c) for i, c in enumerate(columns)])


def minute_flow(deals: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Traded volume per minute by {active, passive} x {buy, sell} x tier; a fixed set of columns."""
    rows = with_tier(minute_orders(deals), F.col("order_volume"), F.col("order_side"), thresholds)
    category = F.concat(F.lit("deal_"), F.when(F.col("active"), "act_").otherwise("pas_"), F.col("order_side"), F.lit("_vol_"), F.col("tier"))
    return _minute_sums(rows, category, [f"deal_{c}_vol_{t}" for c in CATEGORIES for t in C.TIERS], "volume")


def minute_cancels(cancels: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Cancelled volume per minute by side x tier of the cancelled volume."""
    side = F.when(F.col("Side") == -1, "buy").otherwise("sell")
    rows = with_tier(
        cancels.where(C.is_cancel(F.col("Side"))).withColumn("_side", side), F.col("Volume"), F.col("_side"),
        thresholds,
    )
    rows = rows.withColumn("minute", C.minute_of(F.col("DealTime")))
    name = F.concat(F.lit("cancel"), F.col("_side"), F.lit("_vol_"), F.col("tier"))
    return _minute_sums(rows, name, [f"cancel{s}_vol_{t}" for s in ("buy", "sell") for t in C.TIERS], "Volume")


def minute_features(deals: DataFrame, thresholds: DataFrame | None = None, how: str = "left") -> DataFrame:
    """Flow and cancels of each minute: ``left`` keeps trading minutes, ``full_outer`` keeps all."""
    flow = minute_flow(deals, thresholds)
    return flow.join(minute_cancels(deals, thresholds), [*DAY, "minute"], how).na.fill(0)


def cancel_ratios(minutes: DataFrame) -> DataFrame:
    """Tiered cancel ratio ``c/(d+c)`` per side and cancel imbalance per tier; 0 when empty."""
    out = {}
    for t in C.TIERS:
        for s in ("buy", "sell"):
            dealt = F.col(f"deal_act_{s}_vol_{t}") + F.col(f"deal_pas_{s}_vol_{t}")
            cancelled = F.col(f"cancel{s}_vol_{t}")
            out[f"{s}_{t}_cancel_ratio"] = F.coalesce(F.try_divide(cancelled, dealt + cancelled), F.lit(0.0))
        b, a = F.col(f"cancelbuy_vol_{t}"), F.col(f"cancelsell_vol_{t}")
        out[f"{t}_cancel_imbalance"] = F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0))
    return minutes.select(*DAY, "minute", *[c.alias(n) for n, c in out.items()])


def large_cancels(cancels: DataFrame, tiers: tuple[str, ...] = ("Large",)) -> DataFrame:
    """Large cancels by distance from the touch (level 1, 2-5, deeper) and inverse-level weighted."""
    level, out = F.col("OBLevel"), []
    for name, code in (("buy", -1), ("sell", -11)):
        on = F.col("Side") == code
        for label, where in (("at_touch", level == 1), ("spoofing", level.between(2, 5)), ("deep", level >= 6)):
            out.append(F.coalesce(F.sum(F.when(on & where, F.col("Volume"))), F.lit(0)).alias(f"{name}_cancel_{label}"))
        weight = F.when(on & (level >= 1), F.col("Volume") / level)
        out.append(F.coalesce(F.sum(weight), F.lit(0.0)).alias(f"total_weighted_{name}_cancel"))
    return cancels.where(F.col("Layer").isin(*tiers)).groupBy(*DAY).agg(*out)


def cancel_asymmetry(daily: DataFrame, window: int = 20) -> DataFrame:
    """Rolling large-cancel asymmetry, its z-score against the earlier days, and a spoofing score.

    ``daily`` has large_{buy,sell}_{orders,cancels} per stock and day.
    """
    s = open_series(daily, ["SecuCode"], ["TradingDay"], "TradingDay div 366", back=window)
    ratio = lambda side, f: f(f"large_{side}_cancels") / (f(f"large_{side}_orders") + EPS)
    s = s.add(_day=ratio("buy", F.col) - ratio("sell", F.col))
    rolled = lambda c: F.sum(c).over(s.last(window))
    past = s.rows(-(window - 1), -1)
    s = s.add(
        rolling_buy_cancel_ratio=ratio("buy", rolled),
        rolling_sell_cancel_ratio=ratio("sell", rolled),
        _mean=F.coalesce(F.avg("_day").over(past), F.lit(0.0)),
        _std=F.when(F.count("_day").over(past) == 0, 1.0).otherwise(F.stddev_samp("_day").over(past)),
        actual_lookback_days=F.count("_day").over(s.last(window)),
    )
    asymmetry = F.col("rolling_buy_cancel_ratio") - F.col("rolling_sell_cancel_ratio")
    return s.close().select(
        *DAY, "rolling_buy_cancel_ratio", "rolling_sell_cancel_ratio",
        asymmetry.alias("cancel_asymmetry"),
        ((F.col("_day") - F.col("_mean")) / (F.col("_std") + EPS)).alias("cancel_asymmetry_zscore"),
        (F.col("rolling_buy_cancel_ratio") * F.greatest(F.lit(0.0), asymmetry)).alias("spoofing_score"),
        "actual_lookback_days",
    )


def cancel_pulse(orders: DataFrame, min_turnover: int) -> DataFrame:
    """Large cancelled orders: busiest minute, median of minute-mean lifetimes, mean minute fill rate.

    ``orders``: OrderID, side, start_ms, Volume, Turnover, cancel_ms, cancel_vol.
    """
    volume = F.col("Volume")
    fill = F.least(F.greatest((volume - F.col("cancel_vol")) / volume, F.lit(0.0)), F.lit(1.0))
    minutes = (
        orders.where(F.col("Turnover") >= min_turnover)
        .groupBy(*DAY, "side", F.expr("cancel_ms div 60000").alias("minute"))
        .agg(
            F.sum("cancel_vol").alias("pulse"),
            (F.sum(F.col("cancel_ms") - F.col("start_ms")) / 1000 / F.count(F.lit(1))).alias("life"),
            F.avg(fill).alias("fill"),
        )
    )
    out = []
    for s in ("buy", "sell"):
        on = F.col("side") == s
        out += [
            F.coalesce(F.max(F.when(on, F.col("pulse"))), F.lit(0)).alias(f"max_pulse_{s}_1m"),
            F.coalesce(F.median(F.when(on, F.col("life"))), F.lit(-1.0)).alias(f"median_lifetime_{s}_1m"),
            F.coalesce(F.avg(F.when(on, F.col("fill"))), F.lit(1.0)).alias(f"mean_fill_rate_{s}_1m"),
        ]
    return minutes.groupBy(*DAY).agg(*out)
