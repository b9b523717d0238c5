"""Selection pool: keyed table jobs over picks, price metrics and exits.

Pool columns: ts_code, name, indate, in_type (array of reasons), and the price metrics once computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import POS, number_rows
from tidemark.session import stage

# Texts of the pool (fixed values).
RETURNED, MANUAL, ANNUAL = "重返", "manual", "年度涨幅TOP300"
OLD_HIGH, DEEP_FALL = "最高点间隔超过60天", "从最高点回撤超过30%"
STOP_TEXT = "吊灯止损触发(Close:%.2f < Exit:%.2f)"
SEPARATOR = " | "


def reasons(column: str = "in_type") -> Column:
    return F.array_join(column, SEPARATOR)


def add_picks(pool: DataFrame, deleted: DataFrame, picks: DataFrame, strategy: str, today: Column,
              annual: str = ANNUAL) -> tuple[DataFrame, DataFrame]:
    """New pool and deleted tables after one strategy's picks (ts_code, name).

    Known codes gain the reason once; codes in the deleted table return with a suffix, or stay out for the
    annual strategy; all others are inserted.
    """
    first = picks.groupBy("ts_code").agg(F.min("name").alias("name"))
    marked = pool.join(first.select("ts_code", F.lit(True).alias("_hit")), "ts_code", "left")
    gains = F.col("_hit") & ~F.contains(reasons(), F.lit(strategy))
    grown = F.when(F.coalesce(gains, F.lit(False)), F.array_append("in_type", F.lit(strategy))).otherwise(F.col("in_type"))
    kept = marked.withColumn("in_type", grown).select(*pool.columns)

    fresh = first.join(pool.select("ts_code"), "ts_code", "left_anti")
    gone = deleted.select("ts_code", F.lit(True).alias("_gone")).distinct()
    fresh = fresh.join(gone, "ts_code", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    if strategy == annual:
        fresh = fresh.where(~F.col("_gone"))
    reason = F.when(F.col("_gone"), F.lit(strategy + RETURNED)).otherwise(F.lit(strategy))
    added = fresh.select(
        "ts_code", "name", today.alias("indate"), F.array(reason).alias("in_type"))
    new_pool = kept.unionByName(added, allowMissingColumns=True)
    back = fresh.where("_gone").select("ts_code")
    return new_pool, deleted.join(back, "ts_code", "left_anti")


def sync_manual(pool: DataFrame, deleted: DataFrame, listed: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Follow an outside list: its new codes are added as manual, codes it dropped move to the deleted table."""
    added, remaining = add_picks(pool, deleted, listed.join(pool.select("ts_code"), "ts_code", "left_anti"), MANUAL, today)
    dropped = pool.join(listed.select("ts_code"), "ts_code", "left_anti").withColumn("out_type", F.lit(MANUAL))
    new_pool = added.join(dropped.select("ts_code"), "ts_code", "left_anti")
    return new_pool, remaining.unionByName(dropped, allowMissingColumns=True)


def price_metrics(pool: DataFrame, bars: DataFrame, t: str, bucket: str, today: Column, atr_rows: int = 10,
                  k_atr: float = 2.5, lead: int = 2) -> DataFrame:
    """Highs, lows, gains, fall after the high and stop price since entry (bars from ``indate - lead``).

    ``bars``: ts_code, ``t``, high, low, close, atr.
    """
    code = ["ts_code"]
    since = bars.join(pool.select("ts_code", "indate"), code).where(F.col(t) >= F.col("indate") - lead)
    rows = stage(number_rows(since, code, [t], bucket))
    top = F.struct(F.col("high").alias("v"), (-F.col(POS)).alias("np"), F.col(t).alias("t"))
    low = F.struct(F.col("low").alias("v"), F.col(POS).alias("p"), F.col(t).alias("t"))
    base = stage(rows.groupBy(*code).agg(
        F.max(top).alias("_hi"), F.min(low).alias("_lo"), F.min_by("close", t).alias("_ref"),
        F.max_by("close", t).alias("_close"), F.max_by("atr", t).alias("_atr"), F.count(F.lit(1)).alias("_n")))
    after = rows.join(base, code).groupBy(*code).agg(
        F.min(F.when(F.col(POS) > -F.col("_hi.np"), low)).alias("_fall"),
        F.max(F.when(F.col(POS) > F.col("_n") - atr_rows, F.col("high"))).alias("_hh"))
    high, ref = F.col("_hi.v"), F.col("_ref")
    stop = F.coalesce(F.when(F.col("_n") >= atr_rows, F.round(F.col("_hh") - k_atr * F.col("_atr"), 2)), F.lit(0.0))
    found = base.join(after, code).select(
        "ts_code", high.alias("highest"), F.col("_hi.t").alias("highest_date"),
        F.col("_lo.v").alias("lowest"), F.col("_lo.t").alias("lowest_date"),
        (F.lit(100.0) * (high - ref) / ref).alias("max_gains"),
        (F.lit(100.0) * (F.col("_close") - ref) / ref).alias("cur_gains"),
        F.coalesce(F.lit(100.0) * (high - F.col("_fall.v")) / high, F.lit(0.0)).alias("maxdd"),
        F.coalesce(F.col("_fall.p") + F.col("_hi.np"), F.lit(0)).alias("maxdd_duration"),
        (today - F.col("_hi.t")).alias("highest_duration"),
        F.struct(F.col("_close").cast("double").alias("close"), stop.alias("stop")).alias("chandelier_loss"))
    keep = [c for c in pool.columns if c not in found.columns or c == "ts_code"]
    return pool.select(*keep).join(found, "ts_code", "left")


def apply_exits(pool: DataFrame, max_days: int = 60, max_fall: float = 40.0) -> DataFrame:
    """``out_type``: first exit rule that fires - age of the high, fall, stop - or null to stay."""
    close, stop = F.col("chandelier_loss.close"), F.col("chandelier_loss.stop")
    return pool.withColumn(
        "out_type",
        F.when(F.col("highest_duration") > max_days, OLD_HIGH).when(F.col("maxdd") > max_fall, DEEP_FALL)
        .when(close < stop, F.format_string(STOP_TEXT, close, stop)))


def split_exits(pool: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staying rows, and the deleted table with the leaving ones."""
    stays = pool.where("out_type is null").drop("out_type")
    leaves = pool.where("out_type is not null").drop("highest_duration")
    return stays, deleted.unionByName(leaves, allowMissingColumns=True)


def daily_job(pool: DataFrame, deleted: DataFrame, listed: DataFrame, picks: dict[str, DataFrame], bars: DataFrame,
              t: str, bucket: str, today: Column) -> tuple[DataFrame, DataFrame]:
    """One day's run: manual sync, every strategy's picks, price metrics, exits."""
    pool, deleted = sync_manual(pool, deleted, listed, today)
    for strategy, found in picks.items():
        pool, deleted = (stage(x) for x in add_picks(pool, deleted, found, strategy, today))
    return split_exits(apply_exits(price_metrics(pool, bars, t, bucket, today)), deleted)
