"""Fixed-width binary bar, block and report files.

Files of records are read by ranges (``sources.records``), a file of any size by many tasks. Block and report files, which have an
index at their head and are bounded by it, come whole (``binaryFile``). Record layouts are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fields as C
from tidemark.sources import records as R

DAILY = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"),
                  ("amount", "<f4"), ("volume", "<u4"), ("unknown", "<u4")])
MINUTE_INT = np.dtype([("day", "<u2"), ("clock", "<u2"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"),
                       ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("unknown", "<u4")])
MINUTE_FLOAT = np.dtype([("day", "<u2"), ("clock", "<u2"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"),
                         ("close", "<f4"), ("amount", "<f4"), ("volume", "<u4"), ("unknown", "<u4")])
FUTURES = np.dtype([("date", "<u4"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"), ("close", "<f4"),
                    ("amount", "<u4"), ("volume", "<u4"), ("settle", "<f4")])
BLOCK_HEADER, BLOCK_NAME, BLOCK_CODE, BLOCK_BODY = 384, 9, 7, 2800
REPORT_HEADER = np.dtype([("kind", "<i2"), ("report_date", "<u4"), ("count", "<u2"), ("a", "<u4"), ("size", "<u4"),
                          ("b", "<u4")])
REPORT_INDEX = np.dtype([("code", "S6"), ("flag", "S1"), ("offset", "<u4")])

_LAYOUTS = {"daily": DAILY, "minute_int": MINUTE_INT, "minute_float": MINUTE_FLOAT, "futures": FUTURES}


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .load(path).select("path", "content")
    )


def read_records(spark: SparkSession, path: str, layout: str, glob: str = "*") -> DataFrame:
    """All fields of a fixed-width layout as one row per record, with the file's ``path``; files are read in ranges of records."""
    dtype = _LAYOUTS[layout]
    first = dtype.names[0]  # files are in the order of their days
    return spark.read.format(R.NAME).options(**R.options_of(spark, path, dtype, glob, first)).load()


def stream_records(spark: SparkSession, path: str, layout: str, glob: str = "*") -> DataFrame:
    """The same as a stream of what files gain."""
    return spark.readStream.format(R.NAME).options(**R.options_of(spark, path, _LAYOUTS[layout], glob, None)).load()


def read_daily(spark: SparkSession, path: str, glob: str = "*.day") -> DataFrame:
    """Daily bars; file names end in exchange and code, which decide the price and volume scale.

    Rows of a file whose name tells no known security keep its name as symbol; kind and scaled values are null.
    """
    return daily_bars(read_records(spark, path, "daily", glob))


def daily_bars(rows: DataFrame) -> DataFrame:
    """Daily records, of files or of a stream, as bars (see ``read_daily``)."""
    code, stem = F.regexp_extract("path", r"([A-Za-z]{2}\d{6})\.\w+$", 1), F.regexp_extract("path", r"([^/]+?)(\.\w+)?$", 1)
    kind = C.security_type(F.substring(code, 1, 2), F.substring(code, 3, 6))
    rows = rows.withColumns({"symbol": F.when(code != "", code).otherwise(stem), "kind": kind})
    price, volume = C.security_scale(F.col("kind"), 0), C.security_scale(F.col("kind"), 1)
    return rows.select(
        "symbol", "kind", F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("date"),
        *[(F.col(c) * price).alias(c) for c in ("open", "high", "low", "close")], "amount",
        (F.col("volume") * volume).alias("volume"))


def read_minute(spark: SparkSession, path: str, prices: str = "float", glob: str = "*") -> DataFrame:
    """Minute bars, prices as floats or as integers in hundredths; day and clock are packed."""
    rows = read_records(spark, path, f"minute_{prices}", glob)
    scale = 1 if prices == "float" else 100
    day, clock = C.packed_date(F.col("day")), C.packed_clock(F.col("clock"))
    return rows.select(
        F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("symbol"), C.event_time(day, clock * 100_000).alias("time"),
        *[(F.col(c) / scale).alias(c) for c in ("open", "high", "low", "close")], "amount", "volume")


def read_futures(spark: SparkSession, path: str, glob: str = "*.day") -> DataFrame:
    """Futures and foreign daily bars; ``stock_amount`` reads the amount's bits as a float."""
    rows = read_records(spark, path, "futures", glob)

    @F.pandas_udf("double")
    def as_float(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy(dtype="uint32").view("float32").astype("float64"))

    return rows.select(
        F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("symbol"),
        F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("date"), "open", "high", "low", "close", "amount",
        "volume", "settle", as_float("amount").alias("stock_amount"))


def read_blocks(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    """Sector members: block name, type, position and code."""
    schema = "blockname string, block_type int, code_index int, code string"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                rows, at = [], BLOCK_HEADER + 2
                for _ in range(int.from_bytes(content[BLOCK_HEADER:at], "little")):
                    name = content[at : at + BLOCK_NAME].decode("gbk", "ignore").rstrip("\x00")
                    at += BLOCK_NAME
                    size, kind = np.frombuffer(content, "<u2", 2, at)
                    at += 4
                    codes = np.frombuffer(content, f"S{BLOCK_CODE}", int(size), at)
                    rows += [(name, int(kind), i, c.decode("utf-8", "ignore")) for i, c in enumerate(codes)]
                    at += BLOCK_BODY
                yield pd.DataFrame(rows, columns=["blockname", "block_type", "code_index", "code"])

    return _files(spark, path, glob).mapInPandas(decode, schema)


def read_custom_blocks(spark: SparkSession, path: str) -> DataFrame:
    """User-made blocks: an index file names the member files; codes carry one leading market digit."""
    record = 120

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                rows = []
                for at in range(0, len(content), record):
                    part = [content[at : at + 50], content[at + 50 : at + record]]
                    rows.append(tuple(p.decode("gbk", "ignore").split("\x00")[0] for p in part))
                yield pd.DataFrame(rows, columns=["blockname", "block_type"])

    names = _files(spark, path, "blocknew.cfg").mapInPandas(decode, "blockname string, block_type string")
    lines = (
        spark.read.option("pathGlobFilter", "*.blk").text(path, wholetext=True)
        .select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.blk$", 1).alias("block_type"),
                F.posexplode(F.split("value", "\r?\n")).alias("code_index", "line"))
        .where("line <> ''")
    )
    codes = lines.select("block_type", "code_index", F.expr("substring(line, 2)").alias("code"))
    return names.join(codes, "block_type").select("blockname", "block_type", "code_index", "code")


def grouped_blocks(flat: DataFrame) -> DataFrame:
    """Block table with member count and comma list in file order."""
    codes = F.transform(F.array_sort(F.collect_list(F.struct("code_index", "code"))), lambda c: c["code"])
    return flat.groupBy("blockname", "block_type").agg(
        F.count(F.lit(1)).alias("stock_count"), F.array_join(codes, ",").alias("code_list"))


def read_reports(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    """Wide finance reports: code, report date and the values as an array."""
    schema = "code string, report_date bigint, values array<float>"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                head = np.frombuffer(content, REPORT_HEADER, 1)[0]
                index = np.frombuffer(content, REPORT_INDEX, int(head["count"]), REPORT_HEADER.itemsize)
                width = int(head["size"]) // 4
                yield pd.DataFrame({
                    "code": [c.decode("utf-8") for c in index["code"]], "report_date": int(head["report_date"]),
                    "values": [np.frombuffer(content, "<f4", width, int(o)) for o in index["offset"]]})

    return _files(spark, path, glob).mapInPandas(decode, schema)


def report_columns(reports: DataFrame, names: list[str]) -> DataFrame:
    """Named columns for the first values of a report."""
    picked = [F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return reports.select("code", "report_date", *picked)
