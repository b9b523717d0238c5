"""Binary reader queries: the given tables are written as vendor files, then read back.

A file holds one symbol (or one block of symbols), as the formats prescribe.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import views as V
from tidemark.plans.catalog import query
from tidemark.plans.queries_tables import reports
from tidemark.session import work_dir
from tidemark.sources import fixed_width as X
from tidemark.sources import market as M
from tidemark.sources.records import store
from tidemark.streaming import jobs as J


def write_files(df: DataFrame, by: list[str], ext: str, encode: Callable[[pd.DataFrame], bytes], name: str, folder: str | None = None) -> str:
    """One file per group, named by column ``name``; returns the folder."""
    folder = folder or work_dir(df.sparkSession, "vendor")

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        system, path = store(folder)
        system.create_dir(path, recursive=True)
        data = encode(pdf)
        with system.open_output_stream(f"{path}/{pdf[name].iloc[0]}.{ext}") as out:
            out.write(data)
        return pd.DataFrame({"size": [len(data)]})

    df.groupBy(*by).applyInPandas(save, "size long").agg(F.sum("size")).collect()  # one number
    return folder


def records(pdf: pd.DataFrame, dtype: np.dtype, **columns: str) -> bytes:
    out = np.zeros(len(pdf), dtype=dtype)
    for field, column in columns.items():
        out[field] = pdf[column].to_numpy()
    return out.tobytes()


PRICES = {c: c for c in ("open", "high", "low", "close")}


@query("src11_daily_files", """
SELECT 'sh' || (600000 + symbol) AS symbol, (t // 12) * 10000 + (t % 12 + 1) * 100 + 1 AS day, round(open * 0.01::DOUBLE, 4) AS open,
  round(close * 0.01::DOUBLE, 4) AS close, turnover::FLOAT::DOUBLE AS amount, round(volume * 0.01::DOUBLE, 4) AS volume FROM bars_m""")
def _(spark, d):
    bars = V.bars_m(spark, d).withColumns({
        "file": F.concat(F.lit("sh"), F.col("symbol") + 600000), "day": F.expr("(t div 12) * 10000 + (t % 12 + 1) * 100 + 1")})
    path = write_files(bars, ["symbol"], "day", lambda p: records(
        p.sort_values("t"), X.DAILY, date="day", amount="turnover", volume="volume", **PRICES), "file")
    rows = X.read_daily(spark, path)
    return rows.select(
        "symbol", F.date_format("date", "yyyyMMdd").cast("bigint").alias("day"), F.round("open", 4).alias("open"),
        F.round("close", 4).alias("close"), "amount", F.round("volume", 4).alias("volume"))


@M.register_feed("vendor_files")
class FileFeed(M.Feed):
    """Daily bars of a folder of vendor files; an update reads what the files have gained."""

    def daily(self, spark, path):
        return X.read_daily(spark, path)

    def update(self, spark, path, table, checkpoint):
        bars = X.daily_bars(X.stream_records(spark, path, "daily", "*.day"))
        return J.refresh_table(bars, table, ["symbol"], "date", checkpoint, source=path).rows()


@query("src18_feed_update", """
SELECT 'sh' || (600000 + symbol) AS symbol, (t // 12) * 10000 + (t % 12 + 1) * 100 + 1 AS day, round(close * 0.01::DOUBLE, 4) AS close FROM bars_m""")
def _(spark, d):
    """A table is filled from files of the first half of each series, the files grow, and an update adds the rest; another adds nothing."""
    bars = V.bars_m(spark, d).withColumns({
        "file": F.concat(F.lit("sh"), F.col("symbol") + 600000), "day": F.expr("(t div 12) * 10000 + (t % 12 + 1) * 100 + 1")})
    table, checkpoint, folder = (work_dir(spark, n) for n in ("bars", "checkpoint", "vendor"))
    feed = M.feed("vendor_files")
    for part in (bars.where("t < 23950"), bars, bars):
        write_files(part, ["symbol"], "day", lambda p: records(
            p.sort_values("t"), X.DAILY, date="day", amount="turnover", volume="volume", **PRICES), "file", folder)
        rows = feed.update(spark, folder, table, checkpoint)
    return rows.select("symbol", F.date_format("date", "yyyyMMdd").cast("bigint").alias("day"), F.round("close", 4).alias("close"))


@query("src11_days_of_files", """
SELECT 'sh' || (600000 + symbol) AS symbol, (t // 12) * 10000 + (t % 12 + 1) * 100 + 1 AS day, close FROM bars_m WHERE t BETWEEN 23928 AND 23951""")
def _(spark, d):
    """Two years of the records: the bounds reach the files."""
    bars = V.bars_m(spark, d).withColumns({
        "file": F.concat(F.lit("sh"), F.col("symbol") + 600000), "day": F.expr("(t div 12) * 10000 + (t % 12 + 1) * 100 + 1")})
    path = write_files(bars, ["symbol"], "day", lambda p: records(
        p.sort_values("t"), X.DAILY, date="day", amount="turnover", volume="volume", **PRICES), "file")
    rows = X.read_records(spark, path, "daily", "*.day").where("date >= 19940101 and date <= 19951231")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.day$", 1).alias("symbol"), F.col("date").alias("day"), "close")


def minute_rows(spark, d):
    at = F.timestamp_seconds("ts")
    return V.bars_h(spark, d).withColumns({
        "day": (F.year(at) - 2004) * 2048 + F.month(at) * 100 + F.dayofmonth(at), "clock": F.hour(at) * 60 + F.minute(at)})


@query("src12_minute_files", """
SELECT symbol, ts, open / 100 AS open, high / 100 AS high, low / 100 AS low, close / 100 AS close, volume, 'int' AS kind FROM bars_h
UNION ALL SELECT symbol, ts, open, high, low, close, volume, 'float' FROM bars_h""")
def _(spark, d):
    out = None
    for kind, layout in (("int", X.MINUTE_INT), ("float", X.MINUTE_FLOAT)):
        path = write_files(minute_rows(spark, d), ["symbol"], "lc5", lambda p, layout=layout: records(
            p.sort_values("ts"), layout, day="day", clock="clock", amount="turnover", volume="volume", **PRICES), "symbol")
        rows = X.read_minute(spark, path, kind, "*.lc5").select(
            "symbol", F.unix_seconds("time").alias("ts"), "open", "high", "low", "close", "volume", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("src13_futures_files", """
SELECT symbol::VARCHAR AS symbol, (t // 12) * 10000 + (t % 12 + 1) * 100 + 1 AS day, open::DOUBLE AS open, close::DOUBLE AS close, volume,
  volume::DOUBLE AS stock_amount FROM bars_m""")
def _(spark, d):
    bars = V.bars_m(spark, d).withColumn("day", F.expr("(t div 12) * 10000 + (t % 12 + 1) * 100 + 1"))

    def encode(p: pd.DataFrame) -> bytes:
        bits = p["volume"].to_numpy().astype("<f4").view("<u4")
        return records(p.assign(bits=bits), X.FUTURES, date="day", amount="bits", volume="volume", settle="close", **PRICES)

    rows = X.read_futures(spark, write_files(bars, ["symbol"], "day", encode, "symbol"))
    return rows.select("symbol", F.date_format("date", "yyyyMMdd").cast("bigint").alias("day"), "open", "close", "volume", "stock_amount")


def block_files(spark, d):
    rows = V.sectors(spark, d).withColumn("part", F.expr("symbol div 300"))
    rows = rows.withColumn("file", F.concat_ws("-", "sector", F.col("part")))

    def encode(p: pd.DataFrame) -> bytes:
        codes = b"".join(f"{s:06d}".encode().ljust(X.BLOCK_CODE, b"\0") for s in sorted(p["symbol"]))
        head = p["sector"].iloc[0].encode("gbk").ljust(X.BLOCK_NAME, b"\0") + np.array([len(p), 2], "<u2").tobytes()
        return b"\0" * X.BLOCK_HEADER + np.array([1], "<u2").tobytes() + head + codes.ljust(X.BLOCK_BODY, b"\0")

    return X.read_blocks(spark, write_files(rows, ["sector", "part"], "dat", encode, "file"))


@query("src14_block_files", """
SELECT sector AS blockname, 2::INTEGER AS block_type, (row_number() OVER (PARTITION BY sector, symbol // 300 ORDER BY symbol) - 1)::INTEGER AS code_index,
  lpad(symbol::VARCHAR, 6, '0') AS code FROM sectors""")
def _(spark, d):
    return block_files(spark, d)


@query("src14_grouped_blocks", """
SELECT sector AS blockname, 2::INTEGER AS block_type, count(*) AS stock_count,
  string_agg(lpad(symbol::VARCHAR, 6, '0'), ',' ORDER BY i, symbol) AS code_list
FROM (SELECT *, row_number() OVER (PARTITION BY sector, symbol // 300 ORDER BY symbol) AS i FROM sectors) GROUP BY 1""")
def _(spark, d):
    return X.grouped_blocks(block_files(spark, d))


@query("src15_report_files", """
SELECT lpad(symbol::VARCHAR, 6, '0') AS code, (t // 12) * 10000 + (t % 12 + 1) * 100 + 1 AS report_date, assets::DOUBLE AS assets, shares::DOUBLE AS shares FROM reports""")
def _(spark, d):
    rows = reports(spark, d).withColumns({
        "part": F.expr("symbol div 1000"), "day": F.expr("(t div 12) * 10000 + (t % 12 + 1) * 100 + 1")})
    rows = rows.withColumn("file", F.concat_ws("-", "t", "part"))

    def encode(p: pd.DataFrame) -> bytes:
        head = np.zeros(1, X.REPORT_HEADER)
        head["kind"], head["report_date"], head["count"], head["size"] = 1, p["day"].iloc[0], len(p), 8
        index = np.zeros(len(p), X.REPORT_INDEX)
        index["code"] = [f"{s:06d}".encode() for s in p["symbol"]]
        index["flag"] = b"0"
        index["offset"] = X.REPORT_HEADER.itemsize + len(p) * X.REPORT_INDEX.itemsize + 8 * np.arange(len(p))
        return head.tobytes() + index.tobytes() + p[["assets", "shares"]].to_numpy().astype("<f4").tobytes()

    named = X.report_columns(X.read_reports(spark, write_files(rows, ["t", "part"], "dat", encode, "file")), ["assets", "shares"])
    return named.select("code", "report_date", F.col("assets").cast("double"), F.col("shares").cast("double"))
