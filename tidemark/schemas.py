"""Fixed schemas of the market tables (names and widths are fixed values)."""

from __future__ import annotations

from pyspark.sql.types import (
    ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType,
)

_TYPES = {
    "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "float": FloatType(), "tinyint": ByteType(),
    "date": DateType(),
}


def _table(columns: str) -> StructType:
    """``name type, ...`` to a schema (usable before a session exists)."""
    pairs = [c.split() for c in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


ORDER = _table(
    "BizIndex int, Channel int, DBOrderID bigint, LastPrice int, OrderID bigint, OrderTime int, OrderType int, "
    "Price int, SecuCode int, TradingDay int, Volume bigint"
)
ORDER_RAW = StructType([f for f in ORDER.fields if f.name != "LastPrice"])
DEAL = _table(
    "BizIndex int, BuyID bigint, Channel int, DealID bigint, DealTime int, Price int, SecuCode int, SellID bigint, "
    "Side int, TradingDay int, Volume bigint"
)
LEVELS = range(1, 11)
SNAPSHOT = _table(
    ", ".join(f"{s}Order{i} int, {s}Price{i} int, {s}Volume{i} bigint" for s in ("Ask", "Bid") for i in LEVELS)
    + ", DealNum bigint, Price int, SecuCode int, TickTime int, TickTimeDiff int, TotalAskVolume bigint, "
    "TotalBidVolume bigint, TotalDealNum bigint, TotalTurnover double, TotalVolume bigint, TradingDay int, "
    "Turnover double, Volume bigint, WeightAskPrice float, WeightBidPrice float"
)
INDEX = _table(
    "ClosePrice int, HighPrice int, LowPrice int, OpenPrice int, PrevClosePrice int, SecuCode int, SeqNo bigint, "
    "CumTurnover double, TickTime int, CumVolume bigint, Turnover double, Volume bigint"
)
CANCEL = _table(
    "DealID bigint, DealTime int, Side tinyint, Volume bigint, TradingDay int, CancelPrice int, OBLevel int, QueuePos int"
)
DAILY_BAR = _table("date date, open double, high double, low double, close double, volume double")
KINDS = {"order": ORDER, "order_raw": ORDER_RAW, "deal": DEAL, "snapshot": SNAPSHOT, "index": INDEX}
