"""Event-log jobs: ordering, repair, completeness and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.functions.series import POS, number_rows, running

DAY = ["SecuCode", "TradingDay"]
END_OF_DAY = 153_000_000

# Completeness limits (HHMMSS) and texts (fixed values).
MORNING, AFTERNOON = 92_500, 145_900
TEXT_SHORT, TEXT_LACK, TEXT_BEFORE, TEXT_AND_AFTER, TEXT_AFTER = "数据行数不足4行", "缺失", "前", "前及", "后"


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def timeline(orders: DataFrame, deals: DataFrame, snapshots: DataFrame | None = None,
             bucket: str = "time div 100000") -> DataFrame:
    """One ordered event log: by time, then sequence, then order < deal < snapshot.

    The sequence of an order is BizIndex where positive, else OrderID; of a deal its DealID.
    """
    seq = F.when(F.col("BizIndex") > 0, F.col("BizIndex")).otherwise(F.col("OrderID"))
    parts = [
        orders.withColumns({"kind": F.lit("order"), "prio": F.lit(0), "time": F.col("OrderTime"), "seq": seq}),
        deals.withColumns(
            {"kind": F.lit("deal"), "prio": F.lit(1), "time": F.col("DealTime"), "seq": F.col("DealID")}),
    ]
    if snapshots is not None:
        parts.append(snapshots.withColumns({
            "kind": F.lit("snapshot"), "prio": F.lit(2), "time": F.col("TickTime"), "seq": F.lit(0).cast("bigint")}))
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part, allowMissingColumns=True)
    return number_rows(log, DAY, ["time", "seq", "prio"], bucket).withColumnRenamed(POS, "event_no")


def uses_biz_index(orders: DataFrame) -> DataFrame:
    """Group-level market rule: the day carries its own sequence numbers."""
    return orders.groupBy(*DAY).agg(
        F.bool_or((F.col("BizIndex") > 0) & (F.col("BizIndex") != F.col("OrderID"))).alias("uses_biz")
    )


def repair_sequence(orders: DataFrame, deals: DataFrame) -> DataFrame:
    """An order numbered after a deal that names it takes that deal's smallest DealID."""
    first = (
        deals.withColumn("OrderID", F.explode(F.array("BuyID", "SellID")))
        .where("OrderID > 0")
        .groupBy(*DAY, "OrderID")
        .agg(F.min("DealID").alias("_first"))
    )
    late = (
        F.coalesce(F.col("uses_biz"), F.lit(False)) & (F.col("BizIndex") > F.col("_first"))
        & ~F.col("OrderType").isin(-1, -11)
    )
    return (
        orders.join(uses_biz_index(orders), DAY, "left")
        .join(first, [*DAY, "OrderID"], "left")
        .withColumn("BizIndex", F.when(late, F.col("_first")).otherwise(F.col("BizIndex")))
        .drop("_first", "uses_biz")
    )


def fill_cancels(orders: DataFrame, deals: DataFrame) -> DataFrame:
    """Add cancel deals that only the order log has, where a side has more order than deal cancels."""
    cancels = orders.where(F.col("OrderType").isin(-1, -11))
    seen = deals.where(F.col("Side").isin(-1, -11))
    wanted = cancels.groupBy(*DAY, F.col("OrderType").alias("Side")).agg(F.count(F.lit(1)).alias("_want"))
    have = seen.groupBy(*DAY, "Side").agg(F.count(F.lit(1)).alias("_have"))
    short = (
        wanted.join(have, [*DAY, "Side"], "left")
        .where(F.col("_want") > F.coalesce("_have", F.lit(0)))
        .select(*DAY, F.col("Side"))
    )
    missing = cancels.select(
        *DAY, F.col("BizIndex").alias("DealID"), F.col("OrderTime").alias("DealTime"),
        F.when(F.col("OrderType") == -1, F.col("OrderID")).otherwise(0).alias("BuyID"),
        F.when(F.col("OrderType") == -11, F.col("OrderID")).otherwise(0).alias("SellID"),
        "Price", "Volume", F.col("OrderType").alias("Side"),
    ).join(short, [*DAY, "Side"], "left_semi").join(
        seen.select(*DAY, "Side", "DealID"), [*DAY, "Side", "DealID"], "left_anti"
    )
    return deals.unionByName(missing)


def next_trade_time(deals: DataFrame, keys: list[str], default: int = END_OF_DAY,
                    bucket: str = "DealTime div 100000") -> DataFrame:
    """Time of the next row that is not a cancel; the session end where none follows."""
    valid = F.when(~C.is_cancel(F.col("Side")), F.col("DealTime"))
    out = running(
        deals, keys, ["DealTime", "DealID"], bucket, {"next_time": ("last", valid)},
        reverse=True, inclusive=False,
    )
    return out.withColumn("next_time", F.coalesce("next_time", F.lit(default)))


def running_matched(deals: DataFrame, bucket: str = "DealTime div 100000") -> DataFrame:
    """Running trade count, volume and turnover of a day."""
    trade = C.is_trade(F.col("Side"))
    one = F.when(trade, 1).otherwise(0)
    return running(
        deals, DAY, ["DealTime", "DealID", "Price", "Volume"], bucket,
        {
            "cum_count": ("sum", one),
            "cum_volume": ("sum", one * F.col("Volume")),
            "cum_turnover": ("sum", one * F.col("Volume") * F.col("Price")),
        },
    )


def _clock_text(clock: Column) -> Column:
    hms = F.floor(clock / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(hms / 10_000), F.floor(hms / 100) % 100, hms % 100)


def completeness(logs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Stock-days whose first or last row misses the session limits, or with fewer than four rows."""
    out = None
    for kind, (df, clock) in logs.items():
        part = df.select(F.lit(kind).alias("kind"), *DAY, F.col(clock).cast("bigint").alias("_t"))
        out = part if out is None else out.unionByName(part)
    day = out.groupBy("kind", *DAY).agg(
        F.count(F.lit(1)).alias("n"), F.min("_t").alias("head"), F.max("_t").alias("tail")
    )
    late = F.floor(F.col("head") / 1000) >= MORNING
    early = F.floor(F.col("tail") / 1000) <= AFTERNOON
    head, tail = _clock_text(F.col("head")), _clock_text(F.col("tail"))
    text = (
        F.when(F.col("n") < 4, TEXT_SHORT)
        .when(late & early, F.concat(F.lit(TEXT_LACK), head, F.lit(TEXT_AND_AFTER), tail, F.lit(TEXT_AFTER)))
        .when(late, F.concat(F.lit(TEXT_LACK), head, F.lit(TEXT_BEFORE)))
        .when(early, F.concat(F.lit(TEXT_LACK), tail, F.lit(TEXT_AFTER)))
    )
    return day.withColumn("gap", text).where("gap is not null").select("kind", *DAY, "n", "gap")
