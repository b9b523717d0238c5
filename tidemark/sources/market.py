"""Readers of tick, bar, universe, statement and vendor tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas

FREE_SHARES = 10_000_000

# Fields of the vendor's order analysis (fixed values).
ORDER_ANALYSIS = [
    "HUGE_LIMIT", "HUGE_MARKET", "LARGE_LIMIT", "LARGE_MARKET", "MID_LIMIT", "MID_MARKET", "SMALL_LIMIT",
    "SMALL_MARKET",
]


def read_l2(spark: SparkSession, kind: str, path: str, stocks: DataFrame | list[int] | None = None,
            day: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """One level-2 table under its fixed schema.

    A day or a short stock list becomes a scan filter; a stock table is a semi join. Only ``columns`` are read.
    """
    df = spark.read.schema(schemas.KINDS[kind]).parquet(path)
    if day is not None:
        df = df.where(F.col("TradingDay") == day)
    if isinstance(stocks, list):
        df = df.where(F.col("SecuCode").isin(stocks))
    elif stocks is not None:
        df = df.join(stocks.select("SecuCode"), "SecuCode", "left_semi")
    return df.select(*columns) if columns else df


def read_daily_csv(spark: SparkSession, path: str, schema: StructType | str = schemas.DAILY_BAR,
                   start: Column | None = None, strict: bool = True, symbol: str = r"([^/]+)\.csv$",
                   header: bool = True) -> DataFrame:
    """Per-symbol bar files; the symbol comes from the file path. ``start`` is exclusive when ``strict``."""
    df = (
        spark.read.schema(schema).option("header", header).option("recursiveFileLookup", True).csv(path)
        .withColumn("symbol", F.regexp_extract(F.input_file_name(), symbol, 1))
    )
    if start is None:
        return df
    first = df.columns[0]
    return df.where(F.col(first) > start if strict else F.col(first) >= start)


def read_statement(spark: SparkSession, path: str, schema: str, tickers: list[str] | None = None,
                   key: str = "Ticker") -> DataFrame:
    """``;``-separated statements, optionally for some tickers."""
    df = spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)
    return df.where(F.col(key).isin(tickers)) if tickers else df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``filename,hash,size`` lines."""
    return spark.read.schema("filename string, hash string, filesize bigint").csv(path)


def universe(listed: DataFrame, excluded: DataFrame, key: str = "ticker") -> DataFrame:
    return listed.join(excluded.select(key), key, "left_anti")


def with_float_shares(df: DataFrame, meta: DataFrame, key: str = "SecuCode") -> DataFrame:
    """Float shares from the metadata table, the default where unknown."""
    shares = meta.select(key, F.col("ActiveCapital").alias("_s"))
    return df.join(shares, key, "left").withColumn("free_shares", F.coalesce("_s", F.lit(FREE_SHARES))).drop("_s")


def trading_dates(calendar: DataFrame, json: str, month: Column) -> DataFrame:
    """Dates of one ``yyyymm`` month from a year -> dates JSON map."""
    years = calendar.select(F.explode(F.from_json(json, "map<string,array<string>>")).alias("year", "dates"))
    days = years.select(F.explode("dates").alias("day"))
    return days.where(F.startswith(F.col("day"), month))


def map_columns(df: DataFrame, json: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns out of a JSON info map."""
    info = F.from_json(json, "map<string,string>")
    return df.withColumns({name: F.try_element_at(info, F.lit(name)).try_cast(kind) for name, kind in fields.items()})


def fields_to_bars(landed: DataFrame) -> DataFrame:
    """Vendor reply (field, date, JSON map symbol -> value) to long bars."""
    names = ["open", "high", "low", "close", "volume"]
    cells = landed.select("field", "date", F.explode(F.from_json("values", "map<string,double>")).alias("symbol", "v"))
    return cells.groupBy("date", "symbol").pivot("field", names).agg(F.first("v"))


def order_analysis_rows(landed: DataFrame) -> DataFrame:
    """Vendor order analysis (symbol, JSON of eight Date/Value lists) to one row per date; errors are dropped."""
    item = "array<struct<Date:string,Value:double>>"
    schema = "ErrorId string, " + ", ".join(f"{c} {item}" for c in ORDER_ANALYSIS)
    data = landed.select("symbol", F.from_json("reply", schema).alias("d")).where("coalesce(d.ErrorId, '0') = '0'")
    rows = data.select("symbol", F.explode(F.arrays_zip(*[F.col(f"d.{c}").alias(c) for c in ORDER_ANALYSIS])).alias("z"))
    return rows.select(
        "symbol", F.col(f"z.{ORDER_ANALYSIS[0]}.Date").alias("date"),
        *[F.col(f"z.{c}.Value").alias(c.lower()) for c in ORDER_ANALYSIS])


Loader = Callable[..., DataFrame]
_FEEDS: dict[str, type] = {}


class Feed:
    """A vendor: subclasses give DataFrames for bars, sector lists and members, and bring a table up to date."""

    def daily(self, spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError

    def members(self, spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError

    def update(self, spark: SparkSession, path: str, table: str, checkpoint: str) -> DataFrame:
        """Add to the table what the vendor has that it lacks, and return its rows."""
        raise NotImplementedError


def register_feed(name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        _FEEDS[name] = cls
        return cls

    return add


def feed(name: str) -> Feed:
    if name not in _FEEDS:
        raise KeyError(f"no feed {name!r}; known: {sorted(_FEEDS)}")
    return _FEEDS[name]()
