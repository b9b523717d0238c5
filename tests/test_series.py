"""The block forms must equal a plain pass over each key, whatever the block size."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.relay import relay
from tidemark.functions.series import (
    POS, Decay, average_rank, decay, exact_percentiles, number_rows, open_series, running,
)

KEYS, BUCKET = ["k"], "t div 10"


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, times have gaps, some values are missing."""
    rng = random.Random(7)
    data = []
    for k, n in (("hot", 180), ("mid", 35), ("one", 1)):
        t = 0
        for _ in range(n):
            t += rng.choice([1, 1, 2, 15])
            data.append((k, t, rng.randint(1, 50), rng.choice([None, rng.randint(-5, 5)])))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t long, x long, y long").cache()


def plain(rows):
    return rows.toPandas().sort_values(["k", "t"]).reset_index(drop=True)


def test_positions(rows):
    got = number_rows(rows, KEYS, ["t"], BUCKET).toPandas().sort_values(["k", "t"])
    want = plain(rows).groupby("k").cumcount() + 1
    assert got[POS].tolist() == want.tolist()


@pytest.mark.parametrize("block", [1, 3, 7, 64, 100_000])
def test_bounded_frames(rows, block):
    s = open_series(rows, KEYS, ["t"], BUCKET, back=5, forward=2, block=block)
    out = s.add(sma=s.sma("x", 5), ahead=F.max("x").over(s.rows(0, 2)), prev=s.lag("x")).close().toPandas()
    out = out.sort_values(["k", "t"]).reset_index(drop=True)
    p = plain(rows)
    assert len(out) == len(p)
    g = p.groupby("k")["x"]
    pd.testing.assert_series_equal(out["sma"], g.transform(lambda v: v.rolling(5).mean()), check_names=False)
    pd.testing.assert_series_equal(out["prev"], g.shift(1), check_names=False)
    ahead = g.transform(lambda v: v[::-1].rolling(3, min_periods=1).max()[::-1])
    assert out["ahead"].tolist() == ahead.tolist()


@pytest.mark.parametrize("bucket", ["t div 3", "t div 1000000"])
def test_running_values(rows, bucket):
    out = running(rows, KEYS, ["t"], bucket, {
        "s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")), "seen": ("last", F.col("y")),
        "start": ("first", F.col("y"))}).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    p = plain(rows)
    g = p.groupby("k")
    assert out["s"].tolist() == g["x"].cumsum().tolist()
    assert out["lo"].tolist() == g["x"].cummin().tolist()
    assert out["hi"].tolist() == g["x"].cummax().tolist()
    pd.testing.assert_series_equal(out["seen"].astype(float), g["y"].ffill().astype(float), check_names=False)
    first = g["y"].transform(lambda v: v.where(v.notna().cumsum() == 1).ffill())
    pd.testing.assert_series_equal(out["start"].astype(float), first.astype(float), check_names=False)


def test_running_ahead_excludes_the_row(rows):
    out = running(rows, KEYS, ["t"], "t div 4", {"nxt": ("last", F.col("y"))}, reverse=True, inclusive=False)
    out = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = plain(rows).groupby("k")["y"].transform(lambda v: v.bfill().shift(-1))
    pd.testing.assert_series_equal(out["nxt"].astype(float), want.astype(float), check_names=False)


@pytest.mark.parametrize("block", [1, 100_000])
def test_recursion_matches_a_single_scan(spark, block):
    n, rng = 1500, np.random.default_rng(3)
    x = rng.normal(100, 10, n)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, t long, x double")
    specs = [Decay("ema", "x", 5), Decay("wilder", "x", 4, alpha=0.25, start=2)]
    out = decay(number_rows(df, KEYS, ["t"], BUCKET), KEYS, specs, block=block).toPandas().sort_values("t")

    def scan(n0, a, start):
        y = [np.nan] * n
        y[start + n0 - 2] = x[start - 1 : start + n0 - 1].mean()
        for i in range(start + n0 - 1, n):
            y[i] = a * x[i] + (1 - a) * y[i - 1]
        return y

    np.testing.assert_allclose(out["ema"], scan(5, 1 / 3, 1), rtol=1e-13)
    np.testing.assert_allclose(out["wilder"], scan(4, 0.25, 2), rtol=1e-13)


@pytest.mark.parametrize("method", ["linear", "higher", "lower"])
def test_exact_percentiles(rows, method):
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    out = exact_percentiles(rows, KEYS, "y", probs, method).toPandas().set_index("k")
    for k, v in plain(rows).dropna().groupby("k")["y"]:
        for name, p in probs.items():
            assert out.loc[k, name] == pytest.approx(v.quantile(p, interpolation=method)), (k, name)


def test_average_rank_fixture(spark):
    df = spark.createDataFrame([(10,), (20,), (20,), (40,)], "v int")
    got = sorted(r.rnk for r in average_rank(df, [], "v", "rnk").collect())
    assert got == [0.25, 0.625, 0.625, 1.0]


@pytest.mark.parametrize("block", [4, 17, 1000])
def test_relay_equals_one_scan(rows, block):
    """A machine with memory: emits when the carried sum passes a limit, then starts again."""

    def step(pdf, state):
        total, out = int(state or 0), []
        for t, x in zip(pdf["t"], pdf["x"]):
            total += x
            if total > 120:
                out.append((t, total))
                total = 0
        return pd.DataFrame(out, columns=["at", "total"]), str(total)

    numbered = number_rows(rows.drop("y"), KEYS, ["t"], BUCKET)
    got = {(r.k, r["at"], r.total) for r in relay(numbered, KEYS, step, "at bigint, total bigint", block).collect()}
    want = set()
    for k, g in plain(rows).groupby("k"):
        want |= {(k, *r) for r in step(g, None)[0].itertuples(index=False)}
    assert got == want


def test_null_keys_and_order_values_lose_no_row(spark):
    rows = [(None, 1, 10), (None, None, 20), ("a", None, 30), ("a", 3, 40), ("", 2, 50)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    numbered = number_rows(df, ["k"], ["t"], "t div 2").collect()
    assert sorted(("-" if r["k"] is None else r["k"], r["v"], r["_pos"]) for r in numbered) == [("", 50, 1), ("-", 10, 2), ("-", 20, 1), ("a", 30, 1), ("a", 40, 2)]
    total = running(df, ["k"], ["t"], "t div 2", {"s": ("sum", F.col("v"))}).collect()
    assert sorted(("-" if r["k"] is None else r["k"], r["s"]) for r in total) == [("", 50), ("-", 20), ("-", 30), ("a", 30), ("a", 70)]


@pytest.mark.parametrize("block", [1, 4])
def test_decay_of_one_row_is_the_value(spark, block):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(1, 12)], "k string, _pos long, x double")
    got = decay(df, ["k"], [Decay("y", "x", 1)], block=block).collect()
    assert len(got) == 11 and all(r["y"] == r["x"] for r in got)


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_decay_with_nulls_is_the_same_in_any_block(spark, block):
    rng = random.Random(5)
    series = {
        "a": [None if rng.random() < 0.4 else rng.uniform(-50, 50) for _ in range(120)],
        "late": [None] * 30 + [7.0, None, 9.0, *[None] * 9, 1e15, 2.0],
        "none": [None] * 20, None: [1.0, 2.0, None, 4.0, 5.0], "short": [1.0],
    }
    df = spark.createDataFrame([(k, i + 1, x) for k, xs in series.items() for i, x in enumerate(xs)], "k string, _pos long, x double")
    specs = [Decay("e", "x", 3), Decay("w", "x", 4, alpha=0.25, start=2), Decay("same", "x", 1)]
    got = {(r["k"], r[POS]): r for r in decay(df, KEYS, specs, block=block).collect()}
    assert len(got) == df.count()
    for k, xs in series.items():
        for spec in specs:
            y, at = None, spec.start + spec.n - 2
            for i, x in enumerate(xs):
                if i == at:
                    seed = [v for v in xs[spec.start - 1 : at + 1] if v is not None]
                    y = sum(seed) / len(seed) if seed else None
                elif i > at and x is not None:
                    y = x if y is None else spec.a * x + (1 - spec.a) * y
                mine = got[k, i + 1][spec.out]
                assert (mine is None) == (y is None) and (y is None or mine == pytest.approx(y, rel=1e-9, abs=1e-9))
