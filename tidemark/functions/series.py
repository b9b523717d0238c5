"""Time-series building blocks that never put one whole key into one task.

A plain ``Window.partitionBy(symbol)`` sends every row of a symbol to the same task, so one heavily traded
symbol decides the run time. Here each key is cut along its order column first:

* ``number_rows``  position of every row inside its key: per-bucket counts give offsets, only the rows of
  one bucket are ever sorted together;
* ``open_series``  bounded frames: blocks of ``block`` positions, each with the few neighbour rows its
  frames reach back (or forward) to, so every frame is complete and each row is emitted once;
* ``running``      unbounded frames: a scan inside each bucket plus a carry computed on one row per bucket;
* ``decay``        first-order recursions (EMA, Wilder) in blocks, with the share of each block's start added exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 100_000
POS, BLK, CORE, BKT = "_pos", "_blk", "_core", "_bkt"


def _sort(order: list[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _expr(bucket: str | Column) -> Column:
    return F.expr(bucket) if isinstance(bucket, str) else bucket


#: Stands for "no bucket": below every bucket, as nulls sort first.
_NO_BUCKET = -(1 << 62)


def _joinable(df: DataFrame, keys: list[str], bucket: str | Column) -> tuple[DataFrame, list[str]]:
    """Add the bucket and columns that say the same as the keys but are never null, so that plain equality joins
    every row to its own group and null keys, order values or buckets lose none."""
    names, columns, kinds = [], {}, dict(df.dtypes)
    for i, key in enumerate(keys):
        number = kinds[key] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[key].startswith("decimal")
        columns[f"_k{i}"] = F.coalesce(F.col(key), F.lit(0).cast(kinds[key])) if number else F.coalesce(F.col(key).cast("string"), F.lit(""))
        names.append(f"_k{i}")
    missing = [F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)]
    columns["_knull"] = sum(missing[1:], missing[0]) if missing else F.lit(0)
    columns[BKT] = F.coalesce(_expr(bucket).cast("bigint"), F.lit(_NO_BUCKET))
    return df.withColumns(columns), [*names, "_knull"]


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt out by ``keys`` to all of the session's shuffle partitions.

    Without their number adaptive execution would join partitions up to its advisory size of compressed rows, which take
    twenty times that in hash tables.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def number_rows(df: DataFrame, keys: list[str], order: list[str], bucket: str | Column) -> DataFrame:
    """Add ``_pos``, 1 for the first row of each key. ``bucket`` must not decrease along ``order``."""
    df, own = _joinable(df, keys, bucket)
    by_key = Window.partitionBy(*own).orderBy(BKT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*own, BKT)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*own, BKT, F.coalesce(F.sum("_n").over(by_key), F.lit(0)).alias("_off"))
    )
    local = F.row_number().over(Window.partitionBy(*own, BKT).orderBy(*_sort(order)))
    return (
        df.withColumn("_rn", local)
        .join(offsets.hint("merge"), [*own, BKT])  # the rows are spread and sorted so already
        .withColumn(POS, F.col("_rn") + F.col("_off"))
        .drop("_rn", "_off", BKT, *own)
    )


def with_halo(df: DataFrame, back: int, forward: int = 0, block: int = BLOCK) -> DataFrame:
    """Assign blocks of positions; copy the edge rows that a neighbour block's frames need."""
    block = max(block, back, forward, 1)
    here = F.floor((F.col(POS) - 1) / block)
    offset = (F.col(POS) - 1) % block
    copies = [here]
    if back:
        copies.append(F.when(offset >= block - back, here + 1))
    if forward:
        copies.append(F.when((offset < forward) & (here > 0), here - 1))
    if len(copies) == 1:
        return df.withColumn(BLK, here).withColumn(CORE, F.lit(True))
    owners = F.filter(F.array(*copies), lambda b: b.isNotNull())
    return df.withColumn(BLK, F.explode(owners)).withColumn(CORE, F.col(BLK) == here)


@dataclass(frozen=True)
class Series:
    """Rows laid out for bounded frames; ``frame`` columns are evaluated inside a block."""

    df: DataFrame
    keys: tuple[str, ...]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLK).orderBy(POS)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.w.rowsBetween(start, end)

    def last(self, n: int) -> WindowSpec:
        return self.rows(-(n - 1), 0)

    def add(self, **columns: Column) -> "Series":
        return Series(self.df.withColumns(columns), self.keys)

    def lag(self, column: str | Column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.w)

    def full(self, value: Column, n: int, shift: int = 0) -> Column:
        """``value`` once ``n`` rows (``shift`` rows ago) exist, else null."""
        return F.when(F.col(POS) >= n + shift, value)

    def sma(self, column: str | Column, n: int) -> Column:
        return self.full(F.avg(column).over(self.last(n)), n)

    def std(self, column: str | Column, n: int) -> Column:
        return self.full(F.stddev_samp(column).over(self.last(n)), n)

    def high(self, column: str | Column, n: int) -> Column:
        return self.full(F.max(column).over(self.last(n)), n)

    def low(self, column: str | Column, n: int) -> Column:
        return self.full(F.min(column).over(self.last(n)), n)

    def total(self, column: str | Column, n: int) -> Column:
        return self.full(F.sum(column).over(self.last(n)), n)

    def pct(self, column: str, n: int = 1) -> Column:
        return F.try_divide(F.col(column), self.lag(column, n)) - 1

    def close(self, keep_pos: bool = False) -> DataFrame:
        extra = [BLK, CORE] if keep_pos else [BLK, CORE, POS]
        return self.df.where(CORE).drop(*extra)


def open_series(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: str | Column,
    back: int,
    forward: int = 0,
    block: int = BLOCK,
) -> Series:
    numbered = df if POS in df.columns else number_rows(df, keys, order, bucket)
    return Series(with_halo(numbered, back, forward, block), tuple(keys))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: str | Column,
    specs: dict[str, tuple[str, Column]],
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Unbounded running ``sum``, ``min``, ``max``, ``last`` or ``first`` (both skip nulls) per key.

    ``reverse`` scans from the end, and ``last`` is then the nearest value ahead; ``inclusive=False`` leaves
    the current row out.
    """
    names = list(specs)
    df, own = _joinable(df, keys, bucket)
    df = df.withColumns({f"_x_{n}": c for n, (_, c) in specs.items()})
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])  # one number keeps hash aggregation

    def total(name: str, kind: str) -> Column:
        x = F.col(f"_x_{name}")
        if kind in ("sum", "min", "max"):
            return getattr(F, kind)(x)
        latest = (kind == "last") != reverse
        seen = F.when(x.isNotNull(), at)
        return F.max_by(x, seen) if latest else F.min_by(x, seen)

    def over(name: str, kind: str, column: Column, window: WindowSpec) -> Column:
        if kind in ("sum", "min", "max"):
            return getattr(F, kind)(column).over(window)
        return getattr(F, kind)(column, ignorenulls=True).over(window)

    before = (
        Window.partitionBy(*own)
        .orderBy(F.col(BKT).desc() if reverse else F.col(BKT).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = df.groupBy(*own, BKT).agg(*[total(n, specs[n][0]).alias(f"_t_{n}") for n in names])
    carry = totals.select(
        *own, BKT, *[over(n, specs[n][0], F.col(f"_t_{n}"), before).alias(f"_c_{n}") for n in names]
    )
    inside = (
        Window.partitionBy(*own, BKT)
        .orderBy(*_sort(order, reverse))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    df = df.withColumns({f"_l_{n}": over(n, specs[n][0], F.col(f"_x_{n}"), inside) for n in names})

    def combine(name: str) -> Column:
        kind, local, prior = specs[name][0], F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            return F.coalesce(local + prior, local, prior)
        if kind == "max":
            return F.greatest(local, prior)
        if kind == "min":
            return F.least(local, prior)
        return F.coalesce(local, prior) if kind == "last" else F.coalesce(prior, local)

    helper = [BKT, *own, *[f"_{p}_{n}" for n in names for p in "xlc"]]
    return (
        df.join(carry.hint("merge"), [*own, BKT]).withColumns({n: combine(n) for n in names}).drop(*helper)
    )


@dataclass(frozen=True)
class Decay:
    """``y = alpha*x + (1-alpha)*y_prev`` seeded with the mean of the first ``n`` values.

    ``start`` is the first position that has a value; ``alpha`` defaults to ``2/(n+1)`` (EMA), Wilder
    smoothing is ``1/n``.
    """

    out: str
    value: str
    n: int
    alpha: float | None = None
    start: int = 1

    @property
    def a(self) -> float:
        return 2.0 / (self.n + 1) if self.alpha is None else self.alpha


def decay(df: DataFrame, keys: list[str], specs: list[Decay], block: int = BLOCK) -> DataFrame:
    """First-order recursions along ``_pos``, all of them in one pass over the rows.

    Each block is scanned from a start of zero; what its true start adds is that start times a power of
    ``1-alpha``, so the blocks' ends, one small row each, give all starts exactly and no task holds a key.
    Null values leave the result as it is, in every block alike; the seed is the mean of the values present, or
    the first value after it where none is.
    """
    import numpy as np
    import pandas as pd

    block = max([block, *[s.n + s.start - 1 for s in specs]])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    held = [(f"_local{i}", f"_share{i}") for i in range(len(specs))]
    parts = [f"_local{i} double, _share{i} double" for i in range(len(specs))]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in types.items()], f"{BLK} bigint", *parts])
    columns = [*df.columns, BLK]

    def smooth(x: np.ndarray, a: float) -> np.ndarray:
        return pd.Series(x).ewm(alpha=a, adjust=False, ignore_na=True).mean().to_numpy()

    def local(pdf: pd.DataFrame, spec: Decay) -> tuple[np.ndarray, np.ndarray]:
        """Values from a start of zero, and the share of the start in each; the first block has its own start."""
        x = pdf[spec.value].to_numpy(dtype="float64", na_value=np.nan)
        if pdf[POS].iloc[0] > 1:
            there = np.cumsum(~np.isnan(x))
            return smooth(np.concatenate([[0.0], x]), spec.a)[1:], (1.0 - spec.a) ** there
        y, at = np.full(len(x), np.nan), spec.start + spec.n - 2
        if len(x) > at:
            seed = x[spec.start - 1 : at + 1]
            seed = seed[~np.isnan(seed)]
            y[at:] = smooth(np.concatenate([[seed.mean() if len(seed) else np.nan], x[at + 1 :]]), spec.a)
        return y, np.zeros(len(x))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, kind="stable")
        found = {}
        for (name, share), spec in zip(held, specs, strict=True):
            found[name], found[share] = local(pdf, spec)
        return pdf.assign(**found)[[*columns, *found]]

    def ends(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, kind="stable")
        out = dict(zip([*keys, BLK], key, strict=True))
        for i, spec in enumerate(specs):
            y, share = local(pdf, spec)
            present = pdf[spec.value].dropna()
            out |= {f"_local{i}": y[-1], f"_share{i}": share[-1], f"_first{i}": float(present.iloc[0]) if len(present) else np.nan}
        return pd.DataFrame([out])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The start of each block from the ends of those before it."""
        pdf = pdf.sort_values(BLK)
        out = {**{k: [v] * len(pdf) for k, v in zip(keys, key, strict=True)}, BLK: pdf[BLK].tolist()}
        for i in range(len(specs)):
            now, starts = np.nan, []
            for y, share, first in pdf[[f"_local{i}", f"_share{i}", f"_first{i}"]].itertuples(index=False):
                begin = first if np.isnan(now) else now
                starts.append(begin)
                out.setdefault(f"_known{i}", []).append(not np.isnan(now))
                now = y if share == 0 else y + share * begin
            out[f"_start{i}"] = starts
        return pd.DataFrame(out)

    blocked = with_halo(df, 0, block=block).drop(CORE).select(*columns[:-1], F.col(BLK).cast("bigint").alias(BLK))
    keyed = "".join(f"`{k}` {types[k]}, " for k in keys) + f"{BLK} bigint"
    small = blocked.groupBy(*keys, BLK).applyInPandas(
        ends, ", ".join([keyed, *[f"_local{i} double, _share{i} double, _first{i} double" for i in range(len(specs))]]))
    starts = small.groupBy(*keys).applyInPandas(
        chain, ", ".join([keyed, *[f"_known{i} boolean, _start{i} double" for i in range(len(specs))]])).where(f"{BLK} > 0")
    renamed = {k: f"_key{i}" for i, k in enumerate([*keys, BLK])}
    starts = starts.withColumnsRenamed(renamed)
    rows = blocked.groupBy(*keys, BLK).applyInPandas(scan, schema)
    rows = rows.join(starts, reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]), "left")

    def whole(i: int) -> Column:
        y, share, start = F.col(f"_local{i}"), F.col(f"_share{i}"), F.col(f"_start{i}")
        there = (F.col(BLK) == 0) | F.col(f"_known{i}") | (share < 1)
        value = F.when(share == 0, y).otherwise(y + share * start)
        return F.when(there & ~F.isnan(value), value)

    helper = [BLK, *renamed.values(), *[f"_{n}{i}" for i in range(len(specs)) for n in ("local", "share", "known", "start")]]
    return rows.withColumns({s.out: whole(i) for i, s in enumerate(specs)}).drop(*helper)


def value_bucket(value: Column) -> Column:
    """A bucket that never decreases with ``value``: 256 steps per doubling, both signs.

    Data independent, so two scans of the same rows always agree, and fine enough that a bucket holds a
    small share of any distribution once equal values are counted instead of repeated.
    """
    step = F.floor(F.log2(F.abs(value)) * 256) + 300_000
    return F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0)).cast("bigint")


def _distribution(df: DataFrame, keys: list[str], value: str,
                  weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of distinct values, and cumulative counts of value buckets, per key."""
    v = F.col(value).cast("double")
    dist = (
        df.where(v.isNotNull())
        .groupBy(*keys, value_bucket(v).alias(BKT), v.alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    )
    by_key = Window.partitionBy(*keys)
    cum = by_key.orderBy(BKT).rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        dist.groupBy(*keys, BKT)
        .agg(F.sum("_n").alias("_bn"))
        .select(
            *keys,
            BKT,
            (F.sum("_bn").over(cum) - F.col("_bn")).alias("_before"),
            F.sum("_bn").over(cum).alias("_upto"),
            F.sum("_bn").over(by_key).alias("_total"),
        )
    )
    return dist, buckets


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], method: str = "linear",
    weight: str | None = None,
) -> DataFrame:
    """Exact percentiles per key: find the bucket that holds each rank, then look only inside it.

    ``method`` is ``linear`` (interpolated), ``higher`` or ``lower``; ``weight`` is a column of repetitions.
    One row per key.
    """
    by = keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))
    dist, buckets = _distribution(df, by, value, weight)
    wanted = []
    for i, p in enumerate(probs.values()):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(at + 1e-9), F.ceil(at - 1e-9)
        for side, rank in ((0, low), (1, high)):
            wanted.append(F.struct(F.lit(2 * i + side).alias("i"), (rank + 1).alias("r")))
    targets = (
        buckets.withColumn("_t", F.explode(F.array(*wanted)))
        .where((F.col("_t.r") > F.col("_before")) & (F.col("_t.r") <= F.col("_upto")))
        .groupBy(*by, BKT)
        .agg(
            F.collect_list("_t").alias("_ts"),
            F.first("_before").alias("_before"),
            F.first("_total").alias("_total"),
        )
    )
    inside = Window.partitionBy(*by, BKT).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        dist.join(targets, [*by, BKT])
        .withColumn("_cum", F.sum("_n").over(inside) + F.col("_before"))
        .withColumn("_t", F.explode("_ts"))
        .where((F.col("_t.r") <= F.col("_cum")) & (F.col("_t.r") > F.col("_cum") - F.col("_n")))
    )
    count = 2 * len(probs)
    ranks = hits.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(F.col("_t.i") == i, F.col("_v"))).alias(f"_r{i}") for i in range(count)],
    )
    out = []
    for i, (name, p) in enumerate(probs.items()):
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        at = F.lit(float(p)) * (F.col("_total") - 1)
        part = F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at + 1e-9)))
        out.append({"linear": part, "higher": high, "lower": low}[method].alias(name))
    return ranks.select(*keys, *out)


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, ascending: bool = True) -> DataFrame:
    """Percentile rank with ties averaged, ``(rank + (ties-1)/2) / n``, over all rows of a key."""
    by = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    dist, buckets = _distribution(base, by, value)
    inside = Window.partitionBy(*by, BKT).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_n").over(inside) + F.col("_before")
    rank = upto - F.col("_n") + (F.col("_n") + 1) / 2
    if not ascending:
        rank = F.col("_total") + 1 - rank
    table = dist.join(buckets, [*by, BKT]).select(
        *by, F.col("_v"), (rank / F.col("_total")).alias(out)
    )
    return (
        base.withColumn("_v", F.col(value).cast("double"))
        .join(table, [*by, "_v"], "left")
        .drop("_v", "_all")
    )
