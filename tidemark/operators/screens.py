"""Stock and sector screens: relative strength, breakouts, grids, exits, weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import BKT, POS, Series, _joinable, average_rank, exact_percentiles, running
from tidemark.operators import indicators as I
from tidemark.session import stage

INVESTED = 0.95


def latest(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Last row of each key: one partial hash aggregate, not a sort of the key. ``t`` is unique per key."""
    rest = [c for c in df.columns if c not in (*keys, t)]
    out = df.groupBy(*keys).agg(F.max(t).alias(t), *[F.max_by(c, t).alias(c) for c in rest])
    return out.select(*df.columns)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows in a total order; Spark keeps ``n`` per partition before merging."""
    return df.orderBy(*order).limit(n)


def relative_strength_change(s: Series, key: str, t: str, period: int, back: int) -> DataFrame:
    """Percentile rank (x100) of the period return now and ``back`` rows ago, and its change."""
    s = s.add(
        ret_now=s.full((F.col("close") / s.lag("close", period - 1) - 1) * 100, period + back),
        ret_prev=s.full((s.lag("close", back) / s.lag("close", period + back - 1) - 1) * 100, period + back),
    )
    rows = stage(latest(s.close().select(key, t, "ret_now", "ret_prev"), [key], t).where("ret_now is not null"))
    rows = stage(average_rank(rows, [], "ret_now", "rps_now"))
    rows = average_rank(rows, [], "ret_prev", "rps_prev")
    now, prev = F.col("rps_now") * 100, F.col("rps_prev") * 100
    return rows.select(key, prev.alias("rps_prev"), now.alias("rps_now"), (now - prev).alias("rps_change"))


def momentum_quality(s: Series, period: int, weights: dict[int, float]) -> Series:
    """Weighted momentum times the R squared of log price: ``momentum``, ``r2``, ``score``."""
    s = s.add(_ln=F.log(F.col("close")))
    parts = [(F.col("close") / s.lag("close", n - 1) - 1) * w for n, w in weights.items()]
    momentum = sum(parts[1:], parts[0])
    x = F.col(POS).cast("double")
    s = s.add(
        momentum=s.full(momentum, period), r2=s.full(F.regr_r2(F.col("_ln"), x).over(s.last(period)), period))
    return s.add(score=F.col("momentum") * F.col("r2"))


def sector_relative(s: Series, n: int = 20, slope: int = 5) -> Series:
    """Stock/sector ratio, ``n``-row excess return and score (x1.2 if the ratio's average rises, else x0.8).

    Rows carry ``close`` and ``sector_close``.
    """
    s = s.add(rs=F.col("close") / F.col("sector_close"))
    s = s.add(_ma=s.sma("rs", slope))
    rising = F.col("_ma") > s.lag("_ma", slope - 1)
    excess = s.pct("close", n) - s.pct("sector_close", n)
    return s.add(excess=excess, score=excess * 100 * F.when(rising, 1.2).otherwise(0.8))


@dataclass(frozen=True)
class Ignition:
    """Thresholds of the ignition breakout."""

    spans: tuple[int, ...] = (5, 10, 20)
    conv_rows: int = 4
    conv_limit: float = 2.5
    day_gain: float = 0.02
    total_gain: float = 0.10
    volume_gain: float = 1.5
    min_rows: int = 120


def ignition(s: Series, p: Ignition = Ignition()) -> Series:
    """Converged averages, three rising rows, a strong day, ignited volume and a rising long average.

    Rows carry ``ohlc``, ``open``, ``close`` and ``volume``; the last three rows are judged on each row.
    """
    long = p.spans[-1]
    s = I.convergence(s, "ohlc", list(p.spans))
    s = s.add(_ac=s.full(F.avg("conv").over(s.last(p.conv_rows)), long + p.conv_rows - 1), pct=s.pct("ohlc"))
    s = s.add(
        avg_conv=s.lag("_ac", 2),
        _min=F.min("pct").over(s.last(3)), _max=F.max("pct").over(s.last(3)),
        _gain=F.col("close") / s.lag("open", 2) - 1,
        _v3=F.avg("volume").over(s.last(3)), _v7=F.avg("volume").over(s.rows(-9, -3)),
        _rise=F.col(f"ma_{long}") > s.lag(f"ma_{long}"),
    )
    signal = (
        (F.col(POS) >= p.min_rows) & (F.col("avg_conv") < p.conv_limit) & (F.col("_min") > 0)
        & (F.col("_max") > p.day_gain) & (F.col("_gain") > p.total_gain)
        & (F.col("_v3") > F.col("_v7") * p.volume_gain) & F.col("_rise")
        & (F.col("close") > F.col(f"ma_{long}"))
    )
    return s.add(ignited=F.coalesce(signal, F.lit(False)))


def ignition_report(s: Series, atr_rows: int = 10, k_atr: float = 2.5) -> Series:
    """Stop, risk percent, amplitude and pivot; rows carry ``atr``."""
    s = s.add(_hh=s.high("high", atr_rows))
    s = s.add(
        stop=s.high("ohlc", atr_rows) - F.col("atr") * k_atr,
        amplitude=(F.col("high") - F.col("low")) / F.col("low"), pivot_high=s.lag("_hh"))
    return s.add(risk_pct=(F.col("close") - F.col("stop")) / F.col("close") * 100)


def early_pattern(s: Series, spans: tuple[int, int, int] = (20, 60, 120), conv_limit: float = 0.03,
                  day_gain: float = 0.05, total_gain: float = 0.10, volume_gain: float = 1.5) -> Series:
    """Averages close together four to eight rows ago, then three ignited rows and a rising short average."""
    s = I.convergence(s, "close", list(spans))
    short = spans[0]
    s = s.add(pct=s.pct("close"), _cv=F.col("conv") / 100)
    s = s.add(
        conv_before=s.full(F.avg("_cv").over(s.rows(-7, -3)), spans[-1] + 7),
        _min=F.min("pct").over(s.last(3)), _max=F.max("pct").over(s.last(3)), gain=s.pct("close", 3),
        volume_multiple=s.full(F.avg("volume").over(s.last(3)) / F.avg("volume").over(s.last(10)), 10),
        rising=F.col(f"ma_{short}") > s.lag(f"ma_{short}"),
    )
    hit = (
        (F.col("conv_before") < conv_limit) & (F.col("_min") > 0) & (F.col("_max") > day_gain)
        & (F.col("gain") > total_gain) & (F.col("volume_multiple") > volume_gain) & F.col("rising")
        & (F.col("close") > F.col(f"ma_{short}"))
    )
    return s.add(triggered=F.coalesce(hit, F.lit(False)))


@dataclass(frozen=True)
class Params:
    """One point of the breakout grid."""

    cv_w: int
    ct: float
    vg: float
    k_atr: float
    short: int
    mid: int
    long: int


def grid_back(grid: list[Params]) -> int:
    return max(p.long + p.cv_w for p in grid) + 12


def grid_hits(s: Series, grid: list[Params], t: str, day_gain: float = 0.02, total_gain: float = 0.05) -> DataFrame:
    """Entry flags of all grid points beside each other, ``_hit0`` and on: one row per bar, with its position.

    Averages and convergences are evaluated once per distinct setting.
    """
    spans = sorted({n for p in grid for n in (p.short, p.mid, p.long)})
    s = s.add(**{f"ma_{n}": s.sma("ohlc", n) for n in spans})
    sets = sorted({(p.short, p.mid, p.long) for p in grid})
    name = lambda m: "conv_" + "_".join(map(str, m))
    s = s.add(**{name(m): I.row_cv([f"ma_{n}" for n in m], 1e-8) for m in sets})
    windows = sorted({(p.short, p.mid, p.long, p.cv_w) for p in grid})
    s = s.add(
        pct=s.pct("ohlc"), vol3=F.avg("volume").over(s.last(3)),
        vol_long=s.full(F.avg("volume").over(s.rows(-9, -3)), 7, 3),
        **{f"rise_{n}": F.col(f"ma_{n}") > s.lag(f"ma_{n}") for n in {p.long for p in grid}},
        **{f"{name(w[:3])}_{w[3]}": s.full(
            F.avg(name(w[:3])).over(s.rows(-(w[3] + 1), -2)), w[2] + w[3] + 1) for w in windows},
    )
    s = s.add(_min=F.min("pct").over(s.last(3)), _max=F.max("pct").over(s.last(3)), _sum=F.sum("pct").over(s.last(3)))
    common = (F.col("_min") > 1e-6) & (F.col("_max") > day_gain) & (F.col("_sum") > total_gain)
    hits = {}
    for i, p in enumerate(grid):
        conv = F.col(f"{name((p.short, p.mid, p.long))}_{p.cv_w}")
        hit = (
            common & (F.col("vol3") > F.col("vol_long") * p.vg) & F.col(f"rise_{p.long}")
            & (F.col("close") > F.col(f"ma_{p.long}")) & (conv < p.ct)
        )
        hits[f"_hit{i}"] = F.coalesce(hit, F.lit(False))
    return s.df.where("_core").select(*s.keys, POS, t, "high", "close", "atr", *[c.alias(n) for n, c in hits.items()])


def grid_signals(s: Series, grid: list[Params], t: str, bucket: str, day_gain: float = 0.02,
                 total_gain: float = 0.05) -> DataFrame:
    """Entry flag and entries so far (``seg``) of every grid point on every row, long form with ``param_id``.

    The entries are counted for all points in one pass, and the grid is spread with ``explode`` last: no join and no
    pass per point.
    """
    keep = [*s.keys, t, "high", "close", "atr"]
    rows = stage(grid_hits(s, grid, t, day_gain, total_gain).drop(POS))
    sums = {f"_seg{i}": ("sum", F.col(f"_hit{i}").cast("bigint")) for i in range(len(grid))}
    rows = running(rows, list(s.keys), [t], bucket, sums)
    points = F.array(*[
        F.struct(
            F.lit(i).alias("param_id"), F.lit(float(p.k_atr)).alias("k_atr"), F.col(f"_hit{i}").alias("entry"),
            F.col(f"_seg{i}").alias("seg"))
        for i, p in enumerate(grid)
    ])
    return rows.select(*keep, F.explode(points).alias("_g")).select(*keep, "_g.*")


def _exits(rows: DataFrame, keys: list[str], t: str, bucket: str, sets: list[tuple[Column, Column]]) -> DataFrame:
    """``_entry``, ``_seg``, ``_peak``, ``_stop`` and ``_exit`` of every set (entry flag, k), numbered, beside the bars.

    Entries and maxima are counted inside each bucket; what a bucket starts from, the entries before it and the maximum
    since the last of them, comes from one row per bucket. A breach is an exit if none came earlier in its segment.
    """
    n = range(len(sets))
    df, own = _joinable(rows.withColumns({f"_entry{i}": F.coalesce(e, F.lit(False)) for i, (e, _) in enumerate(sets)}), keys, bucket)
    inside = Window.partitionBy(*own, BKT).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_n{i}": F.sum(F.col(f"_entry{i}").cast("bigint")).over(inside) for i in n})
    local = stage(local.withColumns({f"_m{i}": F.max(F.struct(f"_n{i}", "high")).over(inside)["high"] for i in n}))
    before = Window.partitionBy(*own).orderBy(BKT).rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy(*own, BKT).agg(
        *[F.max(f"_n{i}").alias(f"_n{i}") for i in n], *[F.max_by(f"_m{i}", t).alias(f"_m{i}") for i in n])
    ends = ends.withColumns({f"_from{i}": F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)) for i in n})
    ends = ends.withColumns({f"_top{i}": F.max(F.struct(F.col(f"_from{i}") + F.col(f"_n{i}"), f"_m{i}")).over(before)[f"_m{i}"] for i in n})
    carry = ends.select(*own, BKT, *[f"_from{i}" for i in n], *[f"_top{i}" for i in n])
    out = local.join(carry.hint("merge"), [*own, BKT])
    out = out.withColumns({
        **{f"_seg{i}": F.col(f"_from{i}") + F.col(f"_n{i}") for i in n},
        **{f"_peak{i}": F.when(F.col(f"_n{i}") == 0, F.greatest(f"_m{i}", f"_top{i}")).otherwise(F.col(f"_m{i}")) for i in n}})
    out = out.withColumns({f"_stop{i}": F.col(f"_peak{i}") - k * F.col("atr") for i, (_, k) in enumerate(sets)})
    out = out.withColumns({f"_breach{i}": F.coalesce((F.col(f"_seg{i}") > 0) & (F.col("close") < F.col(f"_stop{i}")), F.lit(False)) for i in n})
    out = stage(out.drop(*own, BKT, *[f"_{c}{i}" for c in ("n", "m", "from", "top") for i in n]))
    seen = {f"_seen{i}": ("max", F.when(F.col(f"_breach{i}"), F.col(f"_seg{i}"))) for i in n}
    out = running(out, keys, [t], bucket, seen, inclusive=False)
    first = {f"_exit{i}": F.col(f"_breach{i}") & (F.coalesce(f"_seen{i}", F.lit(0)) < F.col(f"_seg{i}")) for i in n}
    return out.withColumns(first).drop(*[f"_{c}{i}" for c in ("breach", "seen") for i in n])


def chandelier_exits(rows: DataFrame, keys: list[str], t: str, bucket: str) -> DataFrame:
    """First close below ``running max(high) - k_atr*atr`` after each entry; an entry restarts the maximum."""
    out = _exits(rows.drop("seg"), keys, t, bucket, [(F.col("entry"), F.col("k_atr"))])
    return out.withColumnsRenamed({f"_{c}0": c for c in ("seg", "peak", "stop", "exit")}).drop("_entry0")


def grid_exits(hits: DataFrame, grid: list[Params], keys: list[str], t: str, bucket: str, events: bool = False) -> DataFrame:
    """Chandelier exits of every grid point on the bars of ``grid_hits``, long form with ``param_id``.

    All points share their passes over the bars and are spread last; ``events`` keeps only rows that enter or exit.
    """
    sets = [(F.col(f"_hit{i}"), F.lit(float(p.k_atr))) for i, p in enumerate(grid)]
    rows = _exits(stage(hits.drop(POS)), keys, t, bucket, sets)
    points = F.array(*[
        F.struct(F.lit(i).alias("param_id"), *[F.col(f"_{c}{i}").alias(c) for c in ("entry", "seg", "peak", "exit")])
        for i in range(len(grid))
    ])
    if events:  # staged, so that the condition is read as plain columns and not as all that made them
        rows = stage(rows.select(*keys, t, "high", "close", *[f"_{c}{i}" for c in ("entry", "seg", "peak", "exit") for i in range(len(grid))]))
        rows = rows.where(F.greatest(*[F.col(f"_{c}{i}") for c in ("entry", "exit") for i in range(len(grid))]))
    out = rows.select(*keys, t, "high", "close", F.explode(points).alias("_g")).select(*keys, t, "high", "close", "_g.*")
    return out.where("entry or exit") if events else out


def ranked(df: DataFrame, by: str, n: int, *order: Column, out: str = "rnk") -> DataFrame:
    """First ``n`` rows of each group; Catalyst keeps only each partition's own first ``n`` before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(out) <= n)


def composite_screen(legs: DataFrame, n: int | None = 300, min_mdd: float = -0.35, min_days: int = 50,
                     min_gain: float = 1.0) -> DataFrame:
    """Filter legs, then 0.6 rank(gain)^2 + 0.25 rank(calmar) + 0.15 rank(sharpe); best ``n`` (None: all)."""
    rows = legs.where(
        (F.col("mdd") > min_mdd) & (F.col("duration") >= min_days) & (F.col("max_gain") > min_gain))
    for c in ("max_gain", "calmar", "sharpe"):
        rows = average_rank(stage(rows), [], c, f"_{c}")
    score = F.col("_max_gain") ** 2 * 0.60 + F.col("_calmar") * 0.25 + F.col("_sharpe") * 0.15
    rows = rows.withColumn("final_score", score).drop("_max_gain", "_calmar", "_sharpe")
    order = [F.desc("final_score"), F.desc("max_gain"), F.asc("symbol")]
    return rows if n is None else top(rows, n, *order)


def consecutive_members(lists: DataFrame, days: int = 7) -> DataFrame:
    """(date_no, code) members of each of the last ``days`` daily lists; ``date_no`` ranks the dates.

    One code has at most one row per date, so its window is bounded by the calendar.
    """
    w = Window.partitionBy("code").orderBy("date_no").rangeBetween(-(days - 1), 0)
    return lists.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == days).drop("_n")


def frequency_risers(lists: DataFrame, recent: int = 21, long: int = 41, gap: int = 8) -> DataFrame:
    """Appearances in the last ``recent`` and ``long`` lists and the ``recent`` before; riser flag and gap."""
    last = lists.select(F.max("date_no").alias("_last")).withColumn("_k", F.lit(0))
    age = F.col("_last") - F.col("date_no")
    counted = (
        lists.withColumn("_k", F.lit(0)).join(F.broadcast(last), "_k")  # one row
        .groupBy("code")
        .agg(
            F.count(F.when(age < recent, 1)).alias("cur"), F.count(F.when(age < long, 1)).alias("long_count"),
            F.count(F.when((age >= recent) & (age < 2 * recent), 1)).alias("prev"))
    )
    both = (F.col("cur") > 0) & (F.col("prev") > 0)
    return counted.withColumn("riser", both & (F.col("cur") - F.col("prev") > gap))


def reversion_targets(s: Series, date: str, lookback: int, offset: int, n: int, q_std: float, q_vol: float,
                      mode: str = "union", vol_rows: int = 126, target: float = INVESTED) -> DataFrame:
    """Mean reversion: filter by volatility cut-offs, long the worst ``n`` and short the best ``n`` per date."""
    s = s.add(_lr=I.log_return(s))
    ready = F.col(POS) >= lookback + offset
    s = s.add(
        _sd=F.when(ready, F.stddev_pop("_lr").over(s.rows(-(offset + lookback - 3), -offset))),
        _vol=F.when(ready, F.stddev_pop("close").over(s.rows(-(offset + vol_rows - 1), -offset))),
        ret=F.when(ready, F.col("close") / s.lag("close", offset + lookback - 1) - 1),
    )
    rows = stage(s.close().where("ret is not null").select(*s.keys, date, "ret", "_sd", "_vol"))
    cuts = exact_percentiles(rows, [date], "_sd", {"_cs": 1 - q_std}).join(
        exact_percentiles(rows, [date], "_vol", {"_cv": 1 - q_vol}), date)
    calm, steady = F.col("_sd") <= F.col("_cs"), F.col("_vol") <= F.col("_cv")
    kept = stage(rows.join(cuts, date).where((calm | steady) if mode == "union" else (calm & steady)).select(*s.keys, date, "ret"))
    short = ranked(kept, date, n, F.desc("ret"), *s.keys).withColumn("_sign", F.lit(-1))
    long = ranked(kept, date, n, F.asc("ret"), *s.keys).withColumn("_sign", F.lit(1))
    chosen = short.unionByName(long.join(short.select(*s.keys, date), [*s.keys, date], "left_anti"))
    size = kept.groupBy(date).agg(F.least(F.lit(n), F.count(F.lit(1))).alias("_size"))
    return chosen.join(size, date).withColumn("weight", F.col("_sign") * target / F.col("_size")).select(*s.keys, date, "ret", "weight")


def reversion_quantile(rows: DataFrame, date: str, q: float) -> DataFrame:
    """Quantile mode: longs at or below the ``q`` quantile of ``ret``, shorts at or above ``1-q``."""
    rows = stage(rows)
    cuts = exact_percentiles(rows, [date], "ret", {"_low": q, "_high": 1 - q})
    side = F.when(F.col("ret") >= F.col("_high"), "short").when(F.col("ret") <= F.col("_low"), "long")
    return rows.join(cuts, date).withColumn("side", side).where("side is not null").drop("_low", "_high")


def inverse_volatility(s: Series, date: str, n: int = 21, target: float = INVESTED) -> DataFrame:
    """Weights proportional to one over the volatility of ``n`` log returns."""
    s = s.add(_lr=I.log_return(s))
    s = s.add(_sd=s.full(F.stddev_samp("_lr").over(s.last(n)), n + 1))
    rows = stage(s.close().where("_sd > 0").select(*s.keys, date, (1 / F.col("_sd")).alias("_i")))
    sums = rows.groupBy(date).agg(F.sum("_i").alias("_all"))
    return rows.join(sums, date).withColumn("weight", F.col("_i") / F.col("_all") * target).select(*s.keys, date, "weight")


def pair_switch(s: Series, date: str, first: str, second: str, n: int = 60, every: int = 21,
                target: float = INVESTED) -> DataFrame:
    """Rows carry both closes: the larger ``n``-row log return gets the weight, every ``every`` rows."""
    a, b = (F.log(F.col(c) / s.lag(c, n)) for c in (first, second))
    s = s.add(_a=s.full(a, n + 1), _b=s.full(b, n + 1), _clock=(F.col(POS) - 1) % every == 0)
    picked = F.when(F.col("_a") > F.col("_b"), F.lit(first)).otherwise(F.lit(second))
    rows = s.add(pick=picked, weight=F.lit(target)).close()
    return rows.where(F.col("_clock") & F.col("_a").isNotNull()).select(*s.keys, date, "pick", "weight")


def rebalance_clock(rows: DataFrame, key: list[str], t: str, every: int, shift: int = 0, warmup: int = 0) -> DataFrame:
    """Keep rows whose running number is due: ``(pos - shift) % every = 0`` after ``warmup`` rows."""
    due = ((F.col(POS) - shift) % every == 0) & (F.col(POS) > warmup)
    return rows.where(due)


def equal_weights(df: DataFrame, date: str, target: float = 1.0) -> DataFrame:
    counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, date).withColumn("weight", F.lit(target) / F.col("_n")).drop("_n")


def hold_weights(df: DataFrame, raw: str, by: str) -> DataFrame:
    """Positives divided by their sum and negatives by minus their sum, per group."""
    w = F.col(raw)
    sums = df.groupBy(by).agg(
        F.sum(F.when(w > 0, w)).alias("_p"), F.sum(F.when(w < 0, w)).alias("_m"))
    weight = F.when(w > 0, w / F.col("_p")).when(w < 0, -w / F.col("_m")).otherwise(0.0)
    return df.join(sums, by).withColumn("weight", weight).drop("_p", "_m")


def leveraged_weights(df: DataFrame, leverage: str, by: str, target: float = INVESTED) -> DataFrame:
    """``-target * |l| / sum|l|`` per group."""
    sums = df.groupBy(by).agg(F.sum(F.abs(F.col(leverage))).alias("_s"))
    return df.join(sums, by).withColumn("weight", -target * F.abs(F.col(leverage)) / F.col("_s")).drop("_s")


def half_kelly(s: Series, value: str, n: int = 20, low: float = 0.2, high: float = 2.0) -> Series:
    """Target from the last ``n`` account values: clamp(mean/var/2); null while too short or flat."""
    s = s.add(_r=s.pct(value))
    w = s.rows(-(n - 2), 0)
    mu, sd = F.avg("_r").over(w), F.stddev_pop("_r").over(w)
    s = s.add(_mu=mu, _sd=sd)
    f = F.when((F.col(POS) > n) & (F.col("_sd") > 0), F.col("_mu") / (F.col("_sd") ** 2))
    return s.add(kelly=F.when(f.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), f / 2))))


def rolling_alpha(s: Series, n: int, stock: str = "r", market: str = "m", free: str = "f") -> Series:
    """Rolling beta, compounded ``n``-row returns and alpha; rows carry stock, market and risk-free returns."""
    w = s.last(n)
    y, x = F.col(stock), F.col(market)
    sums = {"_x": F.sum(x).over(w), "_y": F.sum(y).over(w), "_xy": F.sum(x * y).over(w), "_xx": F.sum(x * x).over(w)}
    comp = {f"{c}_n": s.full(F.exp(F.sum(F.log1p(F.col(c))).over(w)) - 1, n) for c in (stock, market, free)}
    s = s.add(**sums, **comp)
    beta = (F.col("_xy") - F.col("_x") * F.col("_y") / n) / (F.col("_xx") - F.col("_x") ** 2 / n)
    s = s.add(beta=s.full(beta, n))
    alpha = F.col(f"{stock}_n") - F.col(f"{free}_n") - F.col("beta") * (F.col(f"{market}_n") - F.col(f"{free}_n"))
    return s.add(alpha=alpha)


def day_gainers(s: Series, t: str, gain: float) -> DataFrame:
    """Last-row gain above a threshold, best first."""
    rows = latest(s.add(gain=s.pct("close")).close().select(*s.keys, t, "gain"), list(s.keys), t)
    return rows.where(F.col("gain") > gain).orderBy(F.desc("gain"), *s.keys)


def pair_trades(signals: DataFrame, keys: list[str], t: str, bucket: str) -> DataFrame:
    """Trades of an entry/exit table: first entry since the last exit, and that holding's exit.

    Exits counted before a row number the holdings; each trade is then one aggregated group. A holding
    without an exit is an open trade. Rows that neither enter nor exit change nothing and are left out first.
    """
    numbered = running(
        stage(signals.where(F.col("entry") | F.col("exit")).select(*keys, t, "close", "entry", "exit")), keys, [t], bucket, {"_h": ("sum", F.col("exit").cast("bigint"))}, inclusive=False
    ).withColumn("_h", F.coalesce("_h", F.lit(0)))
    at_entry, at_exit = F.when(F.col("entry"), F.col(t)), F.when(F.col("exit"), F.col(t))
    trades = numbered.groupBy(*keys, "_h").agg(
        F.min(at_entry).alias("entry_t"), F.min_by("close", at_entry).alias("entry_price"),
        F.max(at_exit).alias("exit_t"), F.max_by("close", at_exit).alias("exit_price"),
    ).where("entry_t is not null")
    pnl = F.col("exit_price") - F.col("entry_price")
    return trades.drop("_h").withColumns({"pnl": pnl, "ret": pnl / F.col("entry_price")})
