"""Long-form panels: forward fill, interpolation and delta decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import running


def forward_fill(df: DataFrame, key: str, t: str, value: str, bucket: str) -> DataFrame:
    """Every key on every date that has any value: last known value, 0 before the first.

    The grid is generated per key from the date range and reduced to the dates in use.
    """
    dates = df.where(F.col(value).isNotNull()).select(t).distinct()
    span = dates.agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = (
        df.select(key).distinct().withColumn("_k", F.lit(0))
        .join(F.broadcast(span.withColumn("_k", F.lit(0))), "_k")  # one row
        .select(key, F.explode(F.sequence("_a", "_b")).alias(t))
        .join(dates, t, "left_semi")
    )
    rows = grid.join(df.select(key, t, value), [key, t], "left")
    filled = running(rows, [key], [t], bucket, {"_f": ("last", F.col(value))})
    return filled.select(key, t, F.coalesce("_f", F.lit(0)).alias(value))


def interpolate(df: DataFrame, key: str, t: str, value: str, bucket: str) -> DataFrame:
    """Linear in time between known values; the last value is kept after the end, nulls before the first."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    both = running(df, [key], [t], bucket, {"_p": ("last", known)})
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    both = running(both, [key], [t], bucket, {"_n": ("last", known)}, reverse=True)
    p, n = F.col("_p.v"), F.col("_n.v")
    part = (F.col(t) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    mixed = F.when(F.col(value).isNotNull() | n.isNull(), p.cast("double")).otherwise(p + (n - p) * part)
    return both.select(key, t, mixed.alias(value))


def decode_bar_deltas(df: DataFrame, keys: list[str], order: list[str], bucket: str, scale: int) -> DataFrame:
    """Bars sent as differences: open from the previous close, close from the open."""
    step = F.col("open_d") + F.col("close_d")
    out = running(df, keys, order, bucket, {"_c": ("sum", step)})
    return out.withColumns({
        "open": (F.col("_c") - F.col("close_d")) / scale, "close": F.col("_c") / scale}).drop("_c")


def decode_tick_deltas(df: DataFrame, keys: list[str], order: list[str], bucket: str, scale: int) -> DataFrame:
    """Tick prices sent as differences to the previous tick."""
    out = running(df, keys, order, bucket, {"_c": ("sum", F.col("delta"))})
    return out.withColumn("price", F.col("_c") / scale).drop("_c")
