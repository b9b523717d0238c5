"""Hard negatives against brute force over all pairs, on random, clustered and odd vectors; windows never lose a row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        kept.append((i, tuple(math.floor(256 * x) for x in v), label))
    out = []
    for i, v, label in {r for r in kept if r[0] % every == 0}:
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, k) for j, w, k in kept if j != i)
        for s, j, _ in [o for o in others if o[2] == label][:5]:
            fit = [o for o in others if o[2] != label and 80 * -s <= 100 * -o[0] <= 100 * -s]
            out += [(i, j, k + 1, o[1], -s, -o[0]) for k, o in enumerate(fit[:5])]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, KIND).repartition(3), **options).collect())


def test_the_given_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert sorted(tuple(r) for r in negatives.hard_negatives(df).collect()) == brute(rows)


@pytest.mark.parametrize("near", [0.02, 0.5])
def test_clusters_over_many_tiles(spark, near):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x * rng.uniform(0.5, 3) + rng.gauss(0, near) for x in rng.choice(centres)], rng.randint(0, 3)) for i in range(900)]
    rows += [(10_000 + i, centres[0], i % 2) for i in range(200)]  # one vector, many rows: ties by vec_id
    assert mined(spark, rows, every=50, tile=64, block=4) == brute(rows, 50)


def test_windows_skip_rows_and_lose_none():
    rng = np.random.default_rng(2)
    refs = negatives._unit(rng.normal(size=(3, 5)))
    anchors = np.floor(40 * rng.normal(size=(30, 5)))
    rows = np.floor(40 * np.concatenate([rng.normal(size=(400, 5)), refs[[0]] * 3 + 0.05 * rng.normal(size=(200, 5)), np.zeros((1, 5))]))
    theta = negatives.angles(rows, refs)[:, 0]
    rows, theta = rows[np.argsort(theta)], np.sort(theta)
    norms, own = np.sqrt((rows * rows).sum(1)), np.sqrt((anchors * anchors).sum(1))
    score, skipped = anchors @ rows.T, 0
    for least in (-500.0, 0.0, 100.0, 2000.0, 9000.0):
        for most in (None, 200.0, 4000.0):
            a, b = negatives.window(negatives.angles(anchors, refs)[:, 0], own, np.full(30, least), None if most is None else np.full(30, most), theta, (norms[1:].min(), norms.max()))
            for i in range(30):
                fit = (score[i] >= least) & (score[i] <= (np.inf if most is None else most)) & (norms > 0)
                places = np.flatnonzero(fit)
                assert not len(places) or (a[i] <= places[0] and places[-1] < b[i])
                skipped += len(rows) - (b[i] - a[i])
    assert skipped > 20_000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.1], 2), (2, [0.8, 0.1], 2), (3, [0.85], 2), (4, [], 1), (5, [0.0, 0.0], 1),
        (6, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, None, 1), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (100, [-1.0, -0.5], 1),
        (200, [], 2), (300, [0.0, 0.0], 3), (12, [100_000.0, 3.0], 3), (400, [90_000.0, 1.0], 3), (13, [99_000.0, 1.0], 4), (14, [1e-300, -1e-300], 4),
        (-100, [0.5, 0.5], -1), (-7, [0.5, 0.4], -3), (15, [0.4] * 20_000, 3)]
    odd = spark.createDataFrame(rows, KIND)
    for name in ("cell", "part", "ids", "g", "akey", "p", "rank", "wide", "angle"):
        odd = odd.withColumn(name, F.lit("z"))
    assert sorted(tuple(r) for r in negatives.hard_negatives(odd).collect()) == brute(rows)
    assert negatives.hard_negatives(spark.createDataFrame([], KIND)).collect() == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    big = [(0, [1e300, 0.0], 1), (1, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (2, [0.9, 0.0], 2)]
    assert mined(spark, big) == brute(big[1:])  # its scores fit no integer


def test_scores_beyond_floats_are_exact():
    a = np.array([[2**30, 1, 3]], np.int32)
    b = np.array([[2**30, 5, -7], [2**30 - 1, 1, 1]], np.int32)
    assert negatives.scores(a, b, 2.0**60).tolist() == [[2**60 + 5 - 21, 2**60 - 2**30 + 4]]
