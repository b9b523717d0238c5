"""Volume at price, look-back selection and value area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.functions.series import dealt, open_series, running

DAY = ["SecuCode", "TradingDay"]
EPS = 1e-8


def volume_at_price(deals: DataFrame) -> DataFrame:
    return (
        deals.where(C.is_trade(F.col("Side"))).groupBy(*DAY, "Price").agg(F.sum("Volume").alias("Volume"))
    )


def lookback_fixed(days: DataFrame, n: int) -> DataFrame:
    """(SecuCode, target, TradingDay) pairs: the last ``n`` trading days up to each target."""
    s = open_series(days.select(*DAY), ["SecuCode"], ["TradingDay"], "TradingDay div 366", back=n - 1)
    s = s.add(_days=F.collect_list("TradingDay").over(s.last(n)))
    return s.close().select(
        "SecuCode", F.col("TradingDay").alias("target"), F.explode("_days").alias("TradingDay")
    )


def lookback_turnover(days: DataFrame, shares: DataFrame, turnover: float = 1.0) -> DataFrame:
    """Pairs back to where the volume since then reaches ``turnover`` times the free shares, inclusive.

    A day stays while the volume of the later days is below the target. With running volume ``c`` that is
    ``c(target) - c(day) < x``, so days are cut into steps of ``x`` and a target meets its own and the
    previous step only - not every earlier day.
    """
    limited = days.join(shares, "SecuCode").withColumn("_x", F.col("free_shares") * F.lit(turnover))
    c = running(limited, ["SecuCode"], ["TradingDay"], "TradingDay div 366", {"_c": ("sum", F.col("Volume"))})
    c = c.withColumn("_step", F.floor(F.col("_c") / F.col("_x")))
    targets = c.select(
        "SecuCode", F.col("TradingDay").alias("target"), F.col("_c").alias("_ct"),
        F.explode(F.array(F.col("_step"), F.col("_step") - 1)).alias("_step"),
    )
    earlier = c.select("SecuCode", "TradingDay", "_c", "_x", "_step")
    return (
        targets.join(earlier, ["SecuCode", "_step"])
        .where((F.col("TradingDay") <= F.col("target")) & (F.col("_ct") - F.col("_c") < F.col("_x")))
        .select("SecuCode", "target", "TradingDay")
    )


def pooled_profiles(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """Volume by price over each target's days, with the target day's own volume beside it.

    A task gets the whole profiles that ``value_areas`` needs, so their prices are summed where its windows run.
    """
    today = F.when(F.col("TradingDay") == F.col("target"), F.col("Volume"))
    return (
        dealt(pairs.join(profile, DAY).select("SecuCode", "target", "TradingDay", "Price", "Volume"), ["SecuCode", "target"])
        .groupBy("SecuCode", "target", "Price")
        .agg(F.sum("Volume").alias("Volume"), F.coalesce(F.sum(today), F.lit(0)).alias("today"))
    )


def value_areas(pooled: DataFrame, ratio: float = 0.70) -> DataFrame:
    """Point of control and value area per target, without a loop.

    Outward from the POC each side's running minimum decides when a price is reached by the greedy
    two-pointer walk; prices ordered by (that minimum desc, left first, nearest first) are taken while the
    volume so far is below the goal. A window holds the price levels of one profile, never trades.
    """
    key = ["SecuCode", "target"]
    whole = Window.partitionBy(*key)
    price, volume = F.col("Price"), F.col("Volume")
    poc = F.max(F.struct(volume, -price)).over(whole)
    rows = pooled.withColumns({
        "_poc": -poc.getField("col2"), "_pv": poc.getField("Volume"), "_tot": F.sum("Volume").over(whole),
        "_today": F.sum("today").over(whole),
    })
    side = F.when(price < F.col("_poc"), 0).when(price > F.col("_poc"), 1).otherwise(-1)
    rows = rows.withColumns({"_side": side, "_dist": F.abs(price - F.col("_poc"))})
    outward = Window.partitionBy(*key, "_side").orderBy("_dist").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_rm", F.min("Volume").over(outward))
    taken = (
        Window.partitionBy(*key)
        .orderBy(
            F.when(F.col("_side") == -1, 0).otherwise(1), F.col("_rm").desc(), F.col("_side"), F.col("_dist"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("Volume").over(taken), F.lit(0))
    rows = rows.withColumn("_in", (F.col("_side") == -1) | (before < F.col("_tot") * ratio))
    p = volume / (F.col("_tot") + EPS)
    near = price.between(F.col("_poc") * 0.99, F.col("_poc") * 1.01)
    return rows.groupBy(*key).agg(
        F.first("_poc").alias("poc"),
        F.min(F.when(F.col("_in"), price)).alias("val"),
        F.max(F.when(F.col("_in"), price)).alias("vah"),
        (-F.sum(p * F.log(p + EPS))).alias("profile_entropy_rolling"),
        (F.coalesce(F.sum(F.when(near, F.col("today"))), F.lit(0)) / (F.first("_today") + EPS)).alias(
            "avsi_sticky_ratio"),
    )


def profile_metrics(profile: DataFrame, pairs: DataFrame, closes: DataFrame, ratio: float = 0.70) -> DataFrame:
    """Value area, width, close position, breakout flag, anchor share and POC drift per target day."""
    areas = value_areas(pooled_profiles(profile, pairs), ratio)
    day_poc = profile.groupBy(*DAY).agg(F.max_by("Price", C.order_key((F.col("Volume"), 18), (10**18 - F.col("Price"), 19))).alias("_p"))
    # The mean of consecutive differences is (last - first) / (count - 1).
    drift = pairs.join(day_poc, DAY).groupBy("SecuCode", "target").agg(
        F.count(F.lit(1)).alias("actual_lookback_days"),
        F.coalesce(
            F.try_divide(
                F.max_by("_p", "TradingDay") - F.min_by("_p", "TradingDay"), F.count(F.lit(1)) - 1),
            F.lit(0.0),
        ).alias("poc_migration_vector"),
    )
    close = closes.select("SecuCode", F.col("TradingDay").alias("target"), "close")
    width = F.col("vah") - F.col("val")
    return areas.join(drift, ["SecuCode", "target"]).join(close, ["SecuCode", "target"]).select(
        "SecuCode", F.col("target").alias("TradingDay"), "poc", "val", "vah",
        (width / (F.col("poc") + EPS)).alias("va_width_pct"),
        ((F.col("close") - F.col("val")) / (width + EPS)).alias("price_position_in_va"),
        (F.col("close") > F.col("vah")).alias("is_breakout_high"),
        "profile_entropy_rolling", "avsi_sticky_ratio", "poc_migration_vector", "actual_lookback_days",
    )
