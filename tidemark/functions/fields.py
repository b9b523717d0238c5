"""Column builders: clocks, codes, tiers, labels and scaled numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exchange by two-digit code head (fixed values).
EXCHANGE_HEADS = {"SH": ["60", "68"], "SZ": ["00", "30"], "BJ": ["83", "87", "43"]}

# Security type by exchange and two-digit code head (fixed values).
SECURITY_HEADS = {
    "sz": {
        "SZ_A_STOCK": ["00", "30"], "SZ_B_STOCK": ["20"], "SZ_INDEX": ["39"], "SZ_FUND": ["15", "16"],
        "SZ_BOND": ["10", "11", "12", "13", "14"],
    },
    "sh": {
        "SH_A_STOCK": ["60", "68"], "SH_B_STOCK": ["90"], "SH_INDEX": ["00", "88", "99"],
        "SH_FUND": ["50", "51"], "SH_BOND": ["01", "10", "11", "12", "13", "14"],
    },
    "bj": {"BJ_A_STOCK": ["43", "92", "87", "83"]},
}

# (price, volume) coefficient by security type (fixed values).
SECURITY_SCALE = {
    "SH_A_STOCK": (0.01, 0.01), "SH_B_STOCK": (0.001, 0.01), "SH_INDEX": (0.01, 1.0),
    "SH_FUND": (0.001, 1.0), "SH_BOND": (0.001, 1.0), "SZ_A_STOCK": (0.01, 0.01),
    "SZ_B_STOCK": (0.01, 0.01), "SZ_INDEX": (0.01, 1.0), "SZ_FUND": (0.001, 0.01),
    "SZ_BOND": (0.001, 0.01), "BJ_A_STOCK": (0.01, 0.01),
}

# Codes of market 1 (fixed values).
MARKET_ONE_DIGITS = ["5", "6", "9"]
MARKET_ONE_HEADS = ["009", "126", "110", "201", "202", "203", "204"]

# Corporate action names by category (fixed values).
ACTION_NAMES = {
    1: "除权除息", 2: "送配股上市", 3: "非流通股上市", 4: "未知股本变动", 5: "股本变化", 6: "增发新股",
    7: "股份回购", 8: "增发新股上市", 9: "转配股上市", 10: "可转债上市", 11: "扩缩股", 12: "非流通股缩股",
    13: "送认购权证", 14: "送认沽权证",
}

# System quality bands: upper bound (exclusive) and name (fixed values).
QUALITY_BANDS = [
    (1.6, "Poor"), (1.9, "Below average"), (2.4, "Average"), (2.9, "Good"), (5.0, "Excellent"),
    (6.9, "Superb"),
]
QUALITY_TOP = "Holy Grail"

# Longest span in days (exclusive) and reporting period, longest first (fixed values).
SPAN_LABELS = [
    (5 * 365.25, "Yearly"), (365.25, "Monthly"), (50, "Weekly"), (5, "Daily"), (0.5, "Hourly"),
    (0.05, "Per 15 Min"),
]
SPAN_SHORTEST = "Per minute"

DEFAULT_TIERS = (1000.0, 8000.0, 50000.0)
TIERS = ["Small", "Medium", "Large", "Mega"]


def order_key(*parts: tuple[Column, int]) -> Column:
    """One number that sorts like the given columns; each comes with its most decimal digits.

    Only the first may be negative. A later part that is, or has more digits, would spill into the one before
    it, so it ends the query; a null part makes the key null.

    ``min_by``/``max_by`` on a struct fall back to sorted aggregation, on a number they stay hash aggregates.
    Up to 18 digits the key is a long, up to 38 a decimal.
    """
    digits = sum(n for _, n in parts)
    if digits > 38:
        raise ValueError(f"{digits} digits do not fit an order key")
    kind = "bigint" if digits <= 18 else "decimal(38,0)"
    key = parts[0][0].cast(kind)
    for column, n in parts[1:]:
        part = column.cast(kind)
        fits = (part >= 0) & (part < F.lit(str(10**n)).cast("decimal(38,0)"))
        part = F.when(fits | part.isNull(), part).otherwise(F.raise_error(F.lit(f"order key part beyond {n} digits")).cast(kind))
        key = (key * F.lit(str(10**n)).cast(kind)).cast(kind) + part
        key = key.cast(kind)
    return key


def event_time(day: Column, clock: Column) -> Column:
    """``yyyymmdd`` and ``HHMMSSmmm`` integers to a timestamp, by arithmetic (no text parsing)."""
    date = F.make_date(
        F.floor(day / 10_000).cast("int"), (F.floor(day / 100) % 100).cast("int"), (day % 100).cast("int")
    )
    seconds = (
        F.floor(clock / 10_000_000) * 3600 + F.floor(clock / 100_000) % 100 * 60 + F.floor(clock / 1000) % 100
    )
    return F.timestamp_millis(F.unix_date(date).cast("bigint") * 86_400_000 + seconds * 1000 + clock % 1000)


def minute_of(clock: Column) -> Column:
    return F.floor(clock / 100_000).cast("bigint")


def scaled(value: Column, factor: int) -> Column:
    """Money to a scaled integer, half to even."""
    return F.bround(value * factor).cast("bigint")


def weighted_price() -> Column:
    return (F.col("high") + 2 * F.col("open") + 2 * F.col("close") + F.col("low")) / 6


def exchange_of(code: Column) -> Column:
    head = F.substring(code, 1, 2)
    out = F.when(F.lit(False), F.lit(""))
    for name, heads in EXCHANGE_HEADS.items():
        out = out.when(head.isin(heads), name)
    return out.otherwise("UNKNOWN")


def security_type(exchange: Column, code: Column) -> Column:
    head = F.substring(code, 1, 2)
    out = F.when(F.lit(False), F.lit(""))
    for ex, kinds in SECURITY_HEADS.items():
        for name, heads in kinds.items():
            out = out.when((F.lower(exchange) == ex) & head.isin(heads), name)
    return out


def security_scale(kind: Column, which: int) -> Column:
    """Price (0) or volume (1) coefficient of a security type."""
    pairs = [x for k, v in SECURITY_SCALE.items() for x in (F.lit(k), F.lit(v[which]))]
    return F.try_element_at(F.create_map(*pairs), kind)


def market_id(code: Column) -> Column:
    one = F.substring(code, 1, 1).isin(MARKET_ONE_DIGITS) | F.substring(code, 1, 3).isin(MARKET_ONE_HEADS)
    return F.when(one, 1).otherwise(0)


def padded_code(code: Column) -> Column:
    return F.lpad(code.cast("string"), 6, "0")


def symbol_of(code: Column) -> Column:
    padded = padded_code(code)
    return F.concat_ws(".", padded, exchange_of(padded))


def order_side(order_type: Column) -> Column:
    """B or S of an order code; cancels keep the side they cancel."""
    return F.when(order_type.isin(0, 1, 2, 3, -1), "B").when(order_type.isin(10, 11, 12, 13, -11), "S")


def order_price_source(order_type: Column) -> Column:
    return (
        F.when(order_type.isin(0, 2, 10, 12), "limit")
        .when(order_type.isin(1, 11), "last")
        .when(order_type.isin(3, 13), "own_best")
        .when(order_type.isin(-1, -11), "cancel")
    )


def size_tier(volume: Column, small: Column, medium: Column, large: Column) -> Column:
    return (
        F.when(volume < small, "Small").when(volume < medium, "Medium").when(volume < large, "Large")
        .otherwise("Mega")
    )


def is_trade(side: Column) -> Column:
    return side.isin(0, 1)


def is_cancel(side: Column) -> Column:
    return side.isin(-1, -11)


def in_auction(clock: Column) -> Column:
    """Opening call [09:25, 09:30) or closing call [14:57, 15:00)."""
    opening = (clock >= 92_500_000) & (clock < 93_000_000)
    return opening | ((clock >= 145_700_000) & (clock < 150_000_000))


def price_decimals(weighted_bid: Column) -> Column:
    return F.when(weighted_bid % 10 == 0, 0).otherwise(1)


def price_tolerance(weighted_bid: Column) -> Column:
    return F.when(weighted_bid % 10 == 0, 6).otherwise(2)


def futures_direction(code: Column, market: Column) -> Column:
    value = F.floor(code / 10000)
    usual = F.when(value == 0, 1).when(value == 1, -1).otherwise(0)
    plain = F.when(code == 0, 1).when(code == 256, -1).otherwise(0)
    return F.when(market.isin(31, 48), plain).otherwise(usual)


def futures_nature(code: Column, volume: Column, change: Column, market: Column) -> Column:
    """Open/close label of a futures tick. Labels are fixed values."""
    value = F.floor(code / 10000)
    up = change > 0
    down = change < 0

    def side(opening: str, turnover: str, closing: str) -> Column:
        return (
            F.when(up & (volume > change), opening).when(up & (volume == change), "双开")
            .when(change == 0, turnover).when(down & (volume == -change), "双平").when(down, closing)
        )

    other = (
        F.when(up & (volume > change), "开仓").when(up & (volume == change), "双开")
        .when(down & (volume > -change), "平仓").when(down & (volume == -change), "双平")
        .when(change == 0, "换手")
    )
    usual = (
        F.when(value == 0, side("多开", "多换", "空平")).when(value == 1, side("空开", "空换", "多平"))
        .otherwise(other)
    )
    plain = F.when(code == 0, "B").when(code == 256, "S").otherwise("")
    return F.when(market.isin(31, 48), plain).otherwise(usual)


def futures_second(code: Column) -> Column:
    second = code % 10000
    return F.when(second > 59, 0).otherwise(second)


def action_name(category: Column) -> Column:
    pairs = [x for k, v in ACTION_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), category.cast("string"))


def action_fields(category: Column, a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """The four raw values of a corporate action, placed by category."""
    cash, shrink, warrant = category == 1, category.isin(11, 12), category.isin(13, 14)
    shares = ~(cash | shrink | warrant)
    return {
        "fenhong": F.when(cash, a), "peigujia": F.when(cash, b), "songzhuangu": F.when(cash, c),
        "peigu": F.when(cash, d), "suogu": F.when(shrink, c), "xingquanjia": F.when(warrant, a),
        "fenshu": F.when(warrant, c), "panqianliutong": F.when(shares, a),
        "qianzongguben": F.when(shares, b), "panhouliutong": F.when(shares, c),
        "houzongguben": F.when(shares, d),
    }


def packed_date(n: Column) -> Column:
    """16-bit packed day to ``yyyymmdd``."""
    year = F.floor(n / 2048) + 2004
    rest = n % 2048
    return (year * 10000 + F.floor(rest / 100) * 100 + rest % 100).cast("bigint")


def packed_clock(n: Column) -> Column:
    """Minutes of the day to ``HHMM``."""
    return (F.floor(n / 60) * 100 + n % 60).cast("bigint")


def server_time(stamp: Column) -> Column:
    """Server clock integer to ``H:MM:SS.mmm``; the tail is a decimal fraction of an hour or a minute."""
    head = F.floor(stamp / 1_000_000).cast("string")
    minute = F.floor(stamp / 10_000) % 100
    tail = stamp % 10_000
    part = stamp % 1_000_000
    plain = F.format_string("%s:%02d:%06.3f", head, minute, tail * 60 / 10000.0)
    fraction = F.format_string(
        "%s:%02d:%06.3f", head, F.floor(part * 60 / 1_000_000), (part * 60 % 1_000_000) * 60 / 1_000_000.0
    )
    return F.when(minute < 60, plain).otherwise(fraction)


def levels(prefix: str, n: int = 10) -> Column:
    """``{prefix}Price1..n`` and friends to one array of (price, volume, orders)."""
    return F.array(
        *[
            F.struct(
                F.col(f"{prefix}Price{i}").alias("price"),
                F.col(f"{prefix}Volume{i}").alias("volume"),
                F.col(f"{prefix}Order{i}").alias("orders"),
            )
            for i in range(1, n + 1)
        ]
    )


def quality_band(score: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for bound, name in QUALITY_BANDS:
        out = out.when(score < bound, name)
    return out.otherwise(QUALITY_TOP)


def span_label(days: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for bound, name in SPAN_LABELS:
        out = out.when(days > bound, name)
    return out.otherwise(SPAN_SHORTEST)


def up_volume() -> Column:
    return F.when(F.col("open") < F.col("close"), F.col("volume")).otherwise(0)


def down_volume() -> Column:
    return F.when(F.col("open") > F.col("close"), F.col("volume")).otherwise(0)


def repaired_adjusted_close(adjusted: Column, close: Column) -> Column:
    return F.when(F.abs(adjusted) <= 1e-8, close).otherwise(adjusted)


def tickers_inside(bars: DataFrame, keys: list[str], ts: str, start, end) -> DataFrame:
    """Keys whose data overlap ``[start, end]``."""
    return (
        bars.groupBy(*keys)
        .agg(F.min(ts).alias("head"), F.max(ts).alias("tail"))
        .where((F.col("head") <= end) & (F.col("tail") >= start))
    )
