"""Market-shaped views over the given tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fields import order_key
from tidemark.operators.bars import ohlcv, tick_bars

HOUR = 3_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    c = f"`{column}`"
    return F.expr(f"unix_date(cast({c} as date)) * 86400000000L + hour({c}) * 3600000000L + minute({c}) * 60000000L"
                  f" + cast(extract(SECOND FROM {c}) * 1000000 as bigint)")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One print per event: price in cents, ``ts_us`` in epoch microseconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        micros("ts").alias("ts_us"),
        F.col("event_id").alias("seq"),
        cents("value").alias("price"),
        (F.col("user_id") % 10 + 1).alias("volume"),
        "user_id",
    )


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``ticks``; ``ts`` is the right label in epoch seconds."""
    return tick_bars(ticks(spark, sf_dir), ["symbol"], "ts_us", "seq", HOUR)


def bars_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars per supplier; ``t`` counts months."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("t"),
        cents("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        order_key(
            (F.unix_date(F.col("l_shipdate").cast("date")), 6), (F.col("l_orderkey"), 17), (F.col("l_linenumber"), 3),
            (cents("l_extendedprice"), 12),
        ).alias("at"),
    )
    return ohlcv(lines, ["symbol", "t"], F.col("price"), F.col("volume"), F.col("at"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> nation (industry) and region (theme)."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("symbol"),
            F.col("n_name").alias("sector"),
            F.col("n_regionkey").alias("theme"),
        )
    )


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean close and summed volume per sector."""
    return (
        bars_m(spark, sf_dir)
        .join(sectors(spark, sf_dir), "symbol")
        .groupBy("sector", "t")
        .agg(
            (F.sum("close") / F.count("close")).alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions and cancels keyed by supplier and year, with a clock built from the order key."""
    sec = F.lit(33300) + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 21000
    flag = F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("sec", sec)
        .select(
            F.col("l_suppkey").alias("SecuCode"),
            F.year("l_shipdate").alias("TradingDay"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("DealID"),
            (
                F.floor(F.col("sec") / 3600) * 10_000_000
                + F.floor(F.col("sec") % 3600 / 60) * 100_000
                + F.col("sec") % 60 * 1000
                + F.col("l_partkey") % 1000
            ).alias("DealTime"),
            (F.col("l_partkey") % 40).alias("BuyID"),
            (F.col("l_orderkey") % 40).alias("SellID"),
            F.floor(F.col("l_extendedprice") / 1000).cast("bigint").alias("Price"),
            F.col("l_quantity").cast("bigint").alias("Volume"),
            F.when(flag == "A", 0)
            .when(flag == "R", 1)
            .when(F.col("l_linestatus") == "F", -1)
            .otherwise(-11)
            .alias("Side"),
        )
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events keyed by customer group and day block."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("SecuCode"),
        F.floor(key / 3000).cast("bigint").alias("TradingDay"),
        key.alias("OrderID"),
        (key * 2).alias("BizIndex"),
        (93_000_000 + key % 3000 * 1000).alias("OrderTime"),
        F.when(F.col("o_orderstatus") == "O", 0)
        .when(F.col("o_orderstatus") == "F", 10)
        .when(key % 2 == 0, -1)
        .otherwise(-11)
        .alias("OrderType"),
        F.floor(F.col("o_totalprice") / 10000).cast("bigint").alias("Price"),
        (key % 20 + 1).alias("Volume"),
    )


def book_events(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Insert, trade and cancel events of a book per (SecuCode, TradingDay), ordered by ``seq``.

    Every order is inserted on one side; two thirds are later partly executed or cancelled.
    """
    key = F.col("o_orderkey")
    base = (table(spark, sf_dir, "orders") if orders is None else orders).select(
        (F.col("o_custkey") % 10).alias("SecuCode"),
        F.floor(key / 3000).cast("bigint").alias("TradingDay"),
        key.alias("order_id"),
        F.when(F.col("o_custkey") % 3 == 0, "S").otherwise("B").alias("side"),
        F.floor(F.col("o_totalprice") / 25000).cast("bigint").alias("price"),
        (key % 20 + 5).alias("qty"),
        F.col("o_orderstatus").alias("st"),
    )
    insert = base.select(
        "SecuCode", "TradingDay", (F.col("order_id") * 4).alias("seq"), F.lit("insert").alias("kind"),
        "order_id", "side", "price", "qty",
    )
    later = base.where("st in ('F', 'P')").select(
        "SecuCode",
        "TradingDay",
        ((F.col("order_id") + 31 + F.col("order_id") % 211) * 4
         + F.when(F.col("st") == "F", 1).otherwise(2)).alias("seq"),
        F.when(F.col("st") == "F", "trade").otherwise("cancel").alias("kind"),
        "order_id",
        "side",
        F.when(F.col("st") == "F", F.col("price") - F.col("order_id") % 2).otherwise(F.col("price")).alias("price"),
        F.when(F.col("order_id") % 3 == 0, F.col("qty"))
        .otherwise(F.floor(F.col("qty") / 2))
        .cast("bigint")
        .alias("qty"),
    )
    return insert.unionByName(later)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades of a run (supplier); ``pnl`` in ten-thousandths."""
    price = cents("l_extendedprice")
    edge = F.round(F.col("l_discount") * 100).cast("bigint") - F.round(F.col("l_tax") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("direction"),
        (price * edge).alias("pnl"),
        price.alias("entry"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly close per supplier read as an account curve: run_id, t, value."""
    return bars_m(spark, sf_dir).select(F.col("symbol").alias("run_id"), "t", F.col("close").alias("value"))


def returns_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple monthly return of each supplier against its previous bar."""
    from tidemark.functions.series import open_series

    s = open_series(bars_m(spark, sf_dir), ["symbol"], ["t"], "t div 24", back=1)
    s = s.add(r=s.pct("close"))
    return s.close(keep_pos=True).where("r is not null").select("symbol", "t", "r", "close")


VIEW_SQL: dict[str, str] = {
    "ticks": """
SELECT event_type AS symbol, epoch_us(ts) AS ts_us, event_id AS seq,
       round(value * 100)::BIGINT AS price, 1 + user_id % 10 AS volume, user_id
FROM events""",
    "bars_h": """
SELECT symbol, ((ts_us + 3599999999) // 3600000000) * 3600 AS ts,
       arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
       sum(volume)::BIGINT AS volume, sum(price * volume)::BIGINT AS turnover
FROM ticks GROUP BY 1, 2""",
    "bars_m": """
SELECT l_suppkey AS symbol, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS t,
       arg_min(round(l_extendedprice * 100)::BIGINT, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS open,
       max(round(l_extendedprice * 100)::BIGINT) AS high, min(round(l_extendedprice * 100)::BIGINT) AS low,
       arg_max(round(l_extendedprice * 100)::BIGINT, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS close,
       sum(l_quantity::BIGINT)::BIGINT AS volume,
       sum(round(l_extendedprice * 100)::BIGINT * l_quantity::BIGINT)::BIGINT AS turnover
FROM lineitem GROUP BY 1, 2""",
    "sectors": """
SELECT s_suppkey AS symbol, n_name AS sector, n_regionkey AS theme
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "sector_bars": """
SELECT sector, t, sum(close)::DOUBLE / count(close) AS close, sum(volume)::BIGINT AS volume
FROM bars_m JOIN sectors USING (symbol) GROUP BY 1, 2""",
    "deals": """
SELECT l_suppkey AS SecuCode, year(l_shipdate) AS TradingDay, l_orderkey * 10 + l_linenumber AS DealID,
       (sec // 3600) * 10000000 + (sec % 3600 // 60) * 100000 + sec % 60 * 1000 + l_partkey % 1000 AS DealTime,
       l_partkey % 40 AS BuyID, l_orderkey % 40 AS SellID,
       floor(l_extendedprice / 1000)::BIGINT AS Price, l_quantity::BIGINT AS Volume,
       CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 1
            WHEN l_linestatus = 'F' THEN -1 ELSE -11 END AS Side
FROM (SELECT *, 33300 + (l_orderkey * 7919 + l_linenumber * 104729) % 21000 AS sec FROM lineitem)""",
    "orders_log": """
SELECT o_custkey % 50 AS SecuCode, o_orderkey // 3000 AS TradingDay, o_orderkey AS OrderID,
       o_orderkey * 2 AS BizIndex, 93000000 + o_orderkey % 3000 * 1000 AS OrderTime,
       CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 10
            WHEN o_orderkey % 2 = 0 THEN -1 ELSE -11 END AS OrderType,
       floor(o_totalprice / 10000)::BIGINT AS Price, o_orderkey % 20 + 1 AS Volume
FROM orders""",
    "book_events": """
SELECT o_custkey % 10 AS SecuCode, o_orderkey // 3000 AS TradingDay, o_orderkey * 4 AS seq, 'insert' AS kind,
       o_orderkey AS order_id, CASE WHEN o_custkey % 3 = 0 THEN 'S' ELSE 'B' END AS side,
       floor(o_totalprice / 25000)::BIGINT AS price, o_orderkey % 20 + 5 AS qty
FROM orders
UNION ALL
SELECT o_custkey % 10, o_orderkey // 3000,
       (o_orderkey + 31 + o_orderkey % 211) * 4 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END,
       CASE WHEN o_orderstatus = 'F' THEN 'trade' ELSE 'cancel' END, o_orderkey,
       CASE WHEN o_custkey % 3 = 0 THEN 'S' ELSE 'B' END,
       floor(o_totalprice / 25000)::BIGINT - CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 2 ELSE 0 END,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 20 + 5 ELSE (o_orderkey % 20 + 5) // 2 END
FROM orders WHERE o_orderstatus IN ('F', 'P')""",
    "trades": """
SELECT l_suppkey AS run_id, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS day,
       l_orderkey * 10 + l_linenumber AS seq,
       CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS direction,
       round(l_extendedprice * 100)::BIGINT
         * (round(l_discount * 100)::BIGINT - round(l_tax * 100)::BIGINT) AS pnl,
       round(l_extendedprice * 100)::BIGINT AS entry
FROM lineitem""",
    "equity": "SELECT symbol AS run_id, t, close AS value FROM bars_m",
    "returns_m": """
SELECT symbol, t, r, close FROM (
  SELECT symbol, t, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM bars_m)
WHERE r IS NOT NULL""",
}
