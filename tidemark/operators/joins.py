"""As-of joins, calendar rolls and keyed selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import running


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, bucket: str,
          direction: str = "backward", allow_equal: bool = True, tie: str | None = None) -> DataFrame:
    """Nearest right row before (``backward``) or after (``forward``) each left row, as struct ``value``.

    Both sides are merged by time and the right rows carried along by a running value per bucket, so the cost
    is linear and no key meets all of its history. ``bucket`` is an expression of ``t``; ``tie`` orders rows
    with equal times (a left column too, null there is fine).
    """
    forward = direction == "forward"
    row = F.struct(*[F.col(c) for c in right.columns if c not in keys])
    # Equal times: a right row must be scanned before the left row exactly when equality counts.
    right_first = allow_equal != forward
    tag = F.lit(0 if right_first else 1)
    r = right.select(*keys, F.col(t), tag.alias("_side"), row.alias("_right"), F.col(tie or t).alias("_tie"))
    l = left.select(*left.columns, F.lit(1 if right_first else 0).alias("_side"), F.col(t).alias("_tie") if not tie else F.lit(None).alias("_tie"))
    merged = l.withColumn("_left", F.lit(True)).unionByName(r, allowMissingColumns=True)
    out = running(
        merged, keys, [t, "_side", "_tie"], bucket, {value: ("last", F.col("_right"))}, reverse=forward)
    return out.where("_left").select(*left.columns, value)


def roll_calendar(days: DataFrame, calendar: DataFrame, day: str, forward: bool) -> DataFrame:
    """Each distinct day moved to the next (or previous) trading day; days as integers."""
    d = days.select(F.col(day).alias("t")).distinct().withColumn("_k", F.lit(0))
    c = calendar.select(F.col(day).alias("t")).distinct().withColumn("_k", F.lit(0))
    found = as_of(d, c, ["_k"], "t", "_c", "t div 366", "forward" if forward else "backward")
    return found.select(F.col("t").alias(day), F.col("_c.t").alias("trading_day"))


def keep_first(df: DataFrame, key: str, *order) -> DataFrame:
    """Union with dedup by key, keeping the first row in a stated order (a partial aggregate)."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, "_r.*")


def sector_members(bridge: DataFrame, at_least: int = 6) -> DataFrame:
    """Bridge rows of sectors with enough members."""
    big = bridge.groupBy("sector").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return bridge.join(big.select("sector"), "sector", "left_semi")


def pair_alignment(bars: DataFrame, key: str, t: str, value: str, pairs: DataFrame) -> DataFrame:
    """Aligned values of given pairs (a, b) on common times, nulls dropped."""
    v = bars.select(F.col(key), F.col(t), F.col(value)).where(F.col(value).isNotNull())
    a = v.select(F.col(key).alias("a"), t, F.col(value).alias("value_a"))
    b = v.select(F.col(key).alias("b"), t, F.col(value).alias("value_b"))
    return pairs.join(a, "a").join(b, ["b", t])


def walk_forward_slices(start: int, end: int, window: int, step: int) -> list[tuple[int, int]]:
    """Windows of ``window`` months every ``step`` months, clipped to ``end``; months as integers."""
    out, at = [], start
    while at < end:
        out.append((at, min(at + window, end)))
        at += step
        if at + 1 >= end:
            break
    return out


def in_slices(bars: DataFrame, key: str, t: str, window: int, step: int, min_rows: int, times: DataFrame | None = None) -> DataFrame:
    """Rows assigned to every walk-forward window that covers them; thin (key, window) pairs are skipped.

    Windows start every ``step`` from the first time on, so each row computes its own windows: no range join. ``times``
    has the times that the windows span, where ``bars`` holds only some of them.
    """
    bounds = (bars if times is None else times).agg(F.min(t).alias("_a"), F.max(t).alias("_b")).withColumn("_k", F.lit(0))
    rows = bars.withColumn("_k", F.lit(0)).join(F.broadcast(bounds), "_k").drop("_k")  # one row
    off, span = F.col(t) - F.col("_a"), F.col("_b") - F.col("_a")
    # Windows run while the next start lies more than one unit before the end.
    last = F.greatest(F.lit(0), F.ceil((span - 1) / step).cast("int") - 1)
    first_no = F.greatest(F.lit(0), F.ceil((off - window) / step).cast("int"))
    last_no = F.least(F.floor(off / step).cast("int"), last)
    rows = rows.withColumns({"_f": first_no, "_l": last_no}).where("_f <= _l")
    rows = rows.withColumn("slice_no", F.explode(F.sequence("_f", "_l")))
    if min_rows < 2:  # a pair that is there has a row
        return rows.drop("_a", "_b", "_f", "_l")
    thick = rows.groupBy(key, "slice_no").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return rows.drop("_a", "_b", "_f", "_l").join(thick.drop("_n"), [key, "slice_no"], "left_semi")
