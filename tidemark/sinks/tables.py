"""Writers: partitioned, staged, compacted, keyed and chunked outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sinks.ledger import Ledger

ROW_GROUP_ROWS = 200_000

# Sort columns of each table inside a stock (fixed values).
SORT_KEYS = {
    "order": ["TradingDay", "OrderTime"], "deal": ["TradingDay", "DealID"], "snapshot": ["TradingDay", "TickTime"]}


def write_by_stock(df: DataFrame, path: str) -> None:
    """Split a market table by day, each file sorted by stock.

    A directory per stock-day would leave millions of tiny files; sorted files let a reader skip to its stocks
    by their row-group statistics. The rebalance hint lets adaptive execution cut a heavy stock-day into
    several tasks, and merges light ones.
    """
    (
        df.hint("rebalance", F.col("TradingDay"), F.col("SecuCode"))
        .sortWithinPartitions("TradingDay", "SecuCode")
        .write.mode("overwrite").partitionBy("TradingDay").parquet(path)
    )


def write_staged(df: DataFrame, path: str, clock: str, seq: str) -> None:
    """Time-ordered zstd files per day. Range partitioning may split a heavy stock-day, keeping its order."""
    order = ["TradingDay", "SecuCode", clock, seq]
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("compression", "zstd").partitionBy("TradingDay").parquet(path)
    )


def compact(df: DataFrame, path: str, kind: str) -> None:
    """Monthly compaction: ranges of stock and type-specific order, row groups of bounded size inside large files."""
    order = ["SecuCode", *SORT_KEYS[kind]]
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
        .option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)
    )


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with every key that ``new`` has replaced by its rows; applying it twice changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_partitions(new: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions present in ``new``."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def newer_rows(stored: DataFrame, new: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Rows of ``new`` after the last stored time of their key; unknown keys pass whole."""
    last = stored.groupBy(*keys).agg(F.max(t).alias("_last"))
    return new.join(last, keys, "left").where(F.col("_last").isNull() | (F.col(t) > F.col("_last"))).drop("_last")


def append_newer(new: DataFrame, path: str, keys: list[str], t: str, batch: str | None = None) -> Ledger:
    """Append to the ledger table at ``path`` what is newer than the last time of its key; a second run adds nothing. No stored row is
    read. A batch id, if given, is added once."""
    ledger = Ledger(new.sparkSession, path, new.schema, keys, t)
    ledger.append(new, batch or uuid.uuid4().hex)
    return ledger


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV report; the columns must be exactly those expected. Adaptive execution merges a small one into one file."""
    if df.columns != columns:
        raise ValueError(f"report columns {df.columns} differ from {columns}")
    df.hint("rebalance").write.mode("overwrite").option("header", True).csv(path)


def write_per_date(df: DataFrame, path: str, date: str = "date") -> None:
    df.hint("rebalance", F.col(date)).write.mode("overwrite").option("header", True).partitionBy(date).csv(path)


def write_chunks(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """CSV export in files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows).csv(path)


def short_tables(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Keys with too few rows to be complete."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < at_least)
