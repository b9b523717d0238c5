"""Structured Streaming forms of the event jobs: bars, sliding metrics, sessions, barriers, incremental tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.fields import order_key
from tidemark.session import ROCKSDB, STATE_STORE_CONF, work_dir
from tidemark.sinks.ledger import Ledger


WATERMARK_POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append",
                  checkpoint: str | None = None) -> None:
    """Process everything that has arrived, batch by batch, and stop.

    State with several variables and timers needs the RocksDB store, and where feeds meet, the slowest one's watermark must rule
    (policy ``min``), or a feed that runs ahead would make the others late. A query takes its settings from the session when it
    starts, so both are set for the start alone and the session keeps what its owner chose.
    """
    spark = stream.sparkSession
    writer = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or work_dir(spark, "stream-checkpoint")).foreachBatch(write)
    )
    needed = {STATE_STORE_CONF: ROCKSDB, WATERMARK_POLICY: "min"}
    own = {k: spark.conf.get(k, None) for k in needed}
    try:
        for k, v in needed.items():
            spark.conf.set(k, v)
        query = writer.start()
    finally:
        for k, v in own.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own partition; a repeated batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        (
            df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        )

    return write


def materialised(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream to the end and read what it wrote; in update mode the last version of every key."""
    spark = stream.sparkSession
    path = work_dir(spark, "stream-table")
    run_available(stream, batch_writer(path), mode)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def bars(ticks: DataFrame, symbol: str, width: str, delay: str = "10 minutes") -> DataFrame:
    """Right-closed, right-labelled bars of a tick stream (``ts``, ``seq``, ``price``, ``volume``).

    Update mode replays the forming bar, append mode gives final bars once.
    """
    # A window is left-closed; moving every tick back one microsecond closes it on the right instead.
    # The watermark belongs to the moved column, else the window would carry none.
    moved = ticks.withColumn("_at", F.col("ts") - F.expr("interval 1 microsecond"))
    order = order_key((F.unix_micros("ts"), 18), (F.col("seq"), 19))
    return (
        moved.withWatermark("_at", delay).groupBy(symbol, F.window("_at", width).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .select(symbol, F.col("w.end").alias("label"), "open", "high", "low", "close", "volume")
    )


def sliding(ticks: DataFrame, symbol: str, width: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    """Volume, ticks and mean volume per sliding window."""
    return (
        ticks.withWatermark("ts", delay).groupBy(symbol, F.window("ts", width, slide).alias("w"))
        .agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
        .select(symbol, F.col("w.start").alias("start"), "volume", "n", (F.col("volume") / F.col("n")).alias("mean_volume"))
    )


def sessions(ticks: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Bursts of activity separated by at least ``gap``; final sessions only."""
    return (
        ticks.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")
    )


def trading_phase(clock: Column) -> Column:
    """Phase of the trading day of an ``HHMMSSmmm`` clock."""
    return (
        F.when(clock < 91_500_000, "closed").when(clock < 93_000_000, "opening_call").when(clock < 113_000_000, "morning")
        .when(clock < 130_000_000, "lunch").when(clock < 145_700_000, "afternoon").when(clock < 150_000_000, "closing_call")
        .otherwise("closed")
    )


def barrier(ticks: DataFrame, symbol: str, width: str, expected: int, delay: str = "10 minutes") -> DataFrame:
    """Windows in which all ``expected`` symbols have a bar: a second aggregation over finished bars."""
    done = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), symbol).agg(F.sum("volume").alias("v"))
    full = done.groupBy(F.window(F.window_time("w"), width).alias("w2")).agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("v").alias("volume"))
    return full.where(F.col("symbols") == expected).select(F.col("w2.start").alias("start"), "symbols", "volume")


def without_replays(stream: DataFrame, keys: list[str], delay: str = "2 seconds") -> DataFrame:
    """Drop repeats of an event that arrive within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def refresh_table(stream: DataFrame, path: str, keys: list[str], t: str, checkpoint: str | None = None, source: str | None = None) -> Ledger:
    """Append only rows newer than the stored last time of their key, one micro-batch after the other.

    Last times come from the table's ledger, so a batch reads no stored row; it is committed under its id (of ``source``, by default the
    checkpoint), and one repeated after a failure adds nothing.
    """
    spark: SparkSession = stream.sparkSession
    checkpoint = checkpoint or work_dir(spark, "stream-checkpoint")
    ledger = Ledger(spark, path, stream.schema, keys, t)

    def write(df: DataFrame, batch_id: int) -> None:
        Ledger(df.sparkSession, path, stream.schema, keys, t).append(df, f"{source or checkpoint}#{batch_id}")

    run_available(stream, write, "append", checkpoint)
    return ledger
