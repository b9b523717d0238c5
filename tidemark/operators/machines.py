"""Order-dependent screens: growth segments, price boxes and ratchet stops."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.relay import relay
from tidemark.functions.series import BLOCK, POS, number_rows, open_series, running
from tidemark.session import stage


def growth_segments(bars: DataFrame, keys: list[str], t: str, bucket: str, threshold: float = 0.6,
                    window: int = 250, block: int = BLOCK) -> DataFrame:
    """Greedy rises: highest close within ``window`` rows; a rise of ``threshold`` is kept and skipped past.

    The look-ahead is a forward frame. Every rise knows the first rise after its peak, whether it is kept or not; which are
    kept follows from the first rise of a key by doubling those pointers, so a key's chain of n rises takes log n joins.
    """
    s = open_series(bars, keys, [t], bucket, back=0, forward=window - 1, block=max(block, window))
    best = F.max(F.struct(F.col("close").alias("c"), (-F.col(POS)).alias("np"), F.col(t).alias("t"))).over(s.rows(0, window - 1))
    s = s.add(_best=best)
    growth = (F.col("_best.c") - F.col("close")) / F.col("close")
    rises = stage(s.close(keep_pos=True).select(
        *keys, F.col(POS), F.col(t).cast("bigint").alias("start_t"), F.col("_best.t").cast("bigint").alias("peak_t"),
        (-F.col("_best.np")).alias("_peak"), growth.alias("growth")).where(F.col("growth") >= threshold))
    none = F.lit(None).cast("bigint")
    both = rises.select(*keys, F.col(POS).cast("bigint").alias("_at"), F.lit(1).alias("_rise"), F.col(POS).cast("bigint").alias("_hit"), none.alias("_from")).unionByName(
        rises.select(*keys, (F.col("_peak") + 1).cast("bigint").alias("_at"), F.lit(0).alias("_rise"), none.alias("_hit"), F.col(POS).cast("bigint").alias("_from")))
    ahead = running(both, keys, ["_at", "_rise"], f"_at div {block}", {"_to": ("last", F.col("_hit"))}, reverse=True)
    key = F.struct(*keys).alias("_key")  # null keys are equal inside a struct
    jumps = stage(ahead.where("_rise = 0 and _to is not null").select(key, "_from", "_to"))
    kept = stage(rises.groupBy(key).agg(F.min(POS).cast("bigint").alias("_from")))
    while not jumps.isEmpty():
        kept = stage(kept.unionByName(kept.join(jumps, ["_key", "_from"]).select("_key", F.col("_to").alias("_from"))).distinct())
        jumps = stage(jumps.join(jumps.select("_key", F.col("_from").alias("_to"), F.col("_to").alias("_beyond")), ["_key", "_to"]).select(
            "_key", "_from", F.col("_beyond").alias("_to")))
    out = rises.withColumn("_key", key).join(kept.withColumnRenamed("_from", POS), ["_key", POS])
    return out.select(*keys, "start_t", "peak_t", "growth", (F.col("peak_t") - F.col("start_t")).alias("duration"))


@dataclass
class Box:
    """State of the consolidation box."""

    days: int = 0
    high: float = 0.0
    low: float = 0.0
    hits: int = 0
    start: int = 0
    end: int = 0


def advance_box(box: Box, t: int, high: float, low: float, close: float, mid: float, band: float, init: int,
                period: int) -> tuple[Box, Box | None]:
    """Next state after one bar, and the finished box if the bar broke out upward."""
    top, bottom = mid * (1 + band), mid * (1 - band)
    outside = high > top or low < bottom
    fresh = Box(1, high, low, 0, t, t)
    wide = (max(box.high, high), min(box.low, low))
    if box.days == 0:
        return (box if outside else fresh), None
    if box.days < init:
        if box.hits > 1:
            return fresh, None
        if outside:
            wide = (top if high > top else wide[0], bottom if low < bottom else wide[1])
        return Box(box.days + 1, *wide, box.hits + 1 if outside else 0, box.start, t), None
    centre = (box.high + box.low) / 2
    if close > box.high and high > centre * 1.1:
        return fresh, (box if box.days > period else None)
    if close < box.low and low < centre * 0.9:
        return fresh, None
    return Box(box.days + 1, *wide, 0, box.start, t), None


BOX_SCHEMA = "start_t bigint, end_t bigint, break_t bigint, box_high double, box_low double, days bigint"


def boxes(bars: DataFrame, keys: list[str], t: str, bucket: str, mid_rows: int = 60, band: float = 0.1,
          init: int = 20, period: int = 60, block: int = BLOCK) -> DataFrame:
    """Boxes longer than ``period`` bars that were broken upward."""
    s = open_series(bars, keys, [t], bucket, back=mid_rows, block=max(block, mid_rows))
    rows = s.add(mid=s.sma("close", mid_rows)).close(keep_pos=True).where("mid is not null")
    rows = rows.select(*keys, POS, F.col(t).alias("bt"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")], "mid")

    def step(pdf: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str]:
        box, found = Box(**json.loads(state)) if state else Box(), []
        for r in pdf.itertuples(index=False):
            box, done = advance_box(box, int(r.bt), r.high, r.low, r.close, r.mid, band, init, period)
            if done:
                found.append((done.start, done.end, int(r.bt), done.high, done.low, done.days))
        cols = ["start_t", "end_t", "break_t", "box_high", "box_low", "days"]
        return pd.DataFrame(found, columns=cols), json.dumps(asdict(box))

    return relay(rows, keys, step, BOX_SCHEMA, block)


def ratchet_stops(signals: DataFrame, keys: list[str], t: str, bucket: str, k_atr: float = 3.0,
                  block: int = BLOCK, points: str | None = None) -> DataFrame:
    """Trailing stop while in position: ``max(stop, close - k*atr)``; entries are ignored until the exit.

    ``signals``: entry flag, close and atr per bar. Returns in-position rows with stop and exit flag. With ``points`` the
    entry is an array of the numbers of all parameter sets that enter: their machines share one pass over the bars, and
    that column tells them apart.
    """
    entry = F.col("entry") if points else F.when(F.col("entry"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    numbered = signals if POS in signals.columns else number_rows(signals, keys, [t], bucket)
    rows = numbered.select(
        *keys, POS, F.col(t).cast("bigint").alias("bt"), entry.alias("entry"), F.col("close").cast("double").alias("close"),
        F.col("atr").cast("double").alias("atr"))

    def step(pdf: pd.DataFrame, state: str | None) -> tuple[list[tuple], str | None]:
        stops, out = ({int(i): stop for i, stop in json.loads(state).items()} if state else {}), []
        for bt, enter, close, atr in zip(*[pdf[c].tolist() for c in ("bt", "entry", "close", "atr")]):
            now = close - k_atr * atr
            new = [int(i) for i in enter if int(i) not in stops] if now == now and len(enter) else ()
            for i, stop in list(stops.items()):
                if close < stop:
                    out.append((i, bt, stop, True))
                    del stops[i]
                else:
                    stops[i] = max(stop, now)
                    out.append((i, bt, stops[i], False))
            for i in new:
                stops[i] = now
                out.append((i, bt, now, False))
        return out, json.dumps(dict(sorted(stops.items()))) if stops else None

    found = relay(rows, keys, step, "_point int, bt bigint, stop double, exit boolean", block).withColumnRenamed("bt", t)
    return found.withColumnRenamed("_point", points) if points else found.drop("_point")
