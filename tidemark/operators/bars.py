"""Bars from ticks, bar re-aggregation and reconciliation of two bar sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fields import order_key

# Bar widths by name, in seconds (fixed values).
FREQUENCIES = {
    "1min": 60, "5min": 300, "15min": 900, "30min": 1800, "60min": 3600, "1d": 86400,
}


def ohlcv(df: DataFrame, keys: list[str], price: Column, volume: Column, at: Column) -> DataFrame:
    """Open/high/low/close/volume/turnover per key. All partial aggregates, so one shuffle of bars."""
    return df.groupBy(*keys).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"),
        F.sum(price * volume).alias("turnover"),
    )


def bar_label(ts_us: str, step: int) -> Column:
    """Label in epoch seconds: intraday bars are right-closed and right-labelled, day bars left."""
    width = step * 1_000_000
    if step >= 86_400:
        return F.expr(f"({ts_us} div {width}) * {step}")
    return F.expr(f"(({ts_us} + {width - 1}) div {width}) * {step}")


def tick_key(ts_us: str, seq: str) -> Column:
    return order_key((F.col(ts_us), 18), (F.col(seq), 19))


def tick_bars(
    ticks: DataFrame, keys: list[str], ts_us: str, seq: str, step: int,
    price: str = "price", volume: str = "volume",
) -> DataFrame:
    """Bars of ``step`` seconds; bars without volume are dropped."""
    labelled = ticks.withColumn("ts", bar_label(ts_us, step))
    bars = ohlcv(labelled, [*keys, "ts"], F.col(price), F.col(volume), tick_key(ts_us, seq))
    return bars.where(F.col("volume") > 0)


def all_bars(ticks: DataFrame, keys: list[str], ts_us: str, seq: str, names: list[str]) -> DataFrame:
    """Every requested resolution in one result, from one scan, told apart by ``freq``."""
    labels = F.array(
        *[F.struct(F.lit(n).alias("freq"), bar_label(ts_us, FREQUENCIES[n]).alias("ts")) for n in names]
    )
    rows = ticks.withColumn("_b", F.explode(labels)).select("*", "_b.freq", "_b.ts").drop("_b")
    bars = ohlcv(rows, [*keys, "freq", "ts"], F.col("price"), F.col("volume"), tick_key(ts_us, seq))
    return bars.where(F.col("volume") > 0)


def rebar(bars: DataFrame, keys: list[str], ts: str, bucket: Column, out: str) -> DataFrame:
    """Coarser bars from finer ones; ``bucket`` maps a bar time to its new label."""
    return bars.groupBy(*keys, bucket.alias(out)).agg(
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"),
    )


def reconcile(mine: DataFrame, theirs: DataFrame, keys: list[str], scale: int = 100) -> DataFrame:
    """Differences of two bar sets: rows missing on either side and OHLC values that differ.

    ``mine`` holds scaled integers, ``theirs`` prices. One full join replaces two anti joins and a self join.
    """
    names = ["open", "high", "low", "close"]
    a = mine.select(*keys, F.struct(*names).alias("a"))
    b = theirs.select(
        *keys, F.struct(*[F.bround(F.col(n) * scale).cast("bigint").alias(n) for n in names]).alias("b")
    )
    missing = (
        F.when(F.col("b").isNull(), F.array(F.lit("only_mine")))
        .when(F.col("a").isNull(), F.array(F.lit("only_theirs")))
        .otherwise(
            F.filter(
                F.array(*[F.when(F.col(f"a.{n}") != F.col(f"b.{n}"), F.lit(n)) for n in names]),
                lambda x: x.isNotNull(),
            )
        )
    )
    return a.join(b, keys, "full_outer").select(*keys, F.explode(missing).alias("problem"))
