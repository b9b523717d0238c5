"""Shards against their laws and against plain differencing; exact positions of rows of keys of any size."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.shared import positions, settle

SF = "/root/testdata/sf0.001"


def plain(sizes, shards):
    """Differencing with lists of items, always the two partitions of largest spread (older first)."""
    parts = [(k, [(x, [i])] + [(0, [])] * (shards - 1)) for k, (i, x) in enumerate(enumerate(sizes))]
    made = len(parts) + 1
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b) = parts[:2]
        both = sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b), strict=True)), key=lambda t: -t[0])
        parts = [*parts[2:], (made, both)]
        made += 1
    return sorted(x for x, _ in parts[0][1]) if parts else [0] * shards


def test_differencing_matches_the_plain_form():
    rng = random.Random(5)
    for n in (0, 1, 3, 17, 80):
        for shards in (2, 3, 16):
            sizes = [rng.choice([1, 7, rng.randint(1, 5000)]) for _ in range(n)]
            out, total = sharding.difference(sizes, shards)
            assert sorted(total) == plain(sizes, shards)
            assert total == [sum(x for x, s in zip(sizes, out, strict=True) if s == j) for j in range(shards)]


def test_differencing_from_sums_that_exist():
    out, total = sharding.difference([10] * 30, 3, [100, 0, 50])
    assert total == [100 + 10 * out.count(0), 10 * out.count(1), 50 + 10 * out.count(2)]
    assert max(total) - min(total) <= 10
    _, total = sharding.difference([1] * 100, 4, [1000, 0, 0, 0])
    assert total[0] == 1000 and max(total[1:]) - min(total[1:]) <= 1


def check(rows, texts, shards):
    by, shard_of, sums = defaultdict(list), {}, Counter()
    for r in rows:
        by[r["shard"]].append(r["slot"])
        text = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    return sums


@pytest.mark.parametrize("block", [sharding.BLOCK, 20])
def test_shards_of_documents(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.assign(docs, block=block).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    groups = Counter()
    for t in texts.values():
        groups[t or ""] += len((t or "").encode()) + 1
    sums = check(rows, texts, 16)
    mean = sum(sums.values()) / 16
    assert max(sums.values()) <= max(max(groups.values()), 1.02 * mean)


def test_blocks_level_what_large_groups_leave(spark):
    rng = random.Random(3)
    groups = [(i, rng.randint(1, 300)) for i in range(20_000)] + [(10**6, 900_000), (10**6 + 1, 150_000), (10**6 + 2, 150_001)]
    out = sharding.balance(spark.createDataFrame(groups, "key long, size long"), 8, block=3000).collect()
    assert sorted((r["key"], r["size"]) for r in out) == sorted(groups)
    sums = Counter()
    for r in out:
        sums[r["shard"]] += r["size"]
    rest = sorted(sums.values())[:-1]
    assert max(sums.values()) == 900_000 and max(rest) - min(rest) <= 20


def test_odd_rows_and_an_empty_table(spark):
    long = "long " * 100_000
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (4, "é"), (5, long), (6, long), (None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "shard", "slot", "at", "size", "_local", "_part", "c0"):
        odd = odd.withColumn(name, F.lit("z"))
    got = sharding.assign(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert len({r["shard"] for r in got if r["text_crc32"] == 0}) == 1  # null and empty are one group
    assert len({r["shard"] for r in got if r["size"] == 2 and r["text_crc32"] == zlib.crc32(b"x")}) == 1
    for j in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(sum(r["shard"] == j for r in got)))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(empty).collect() == []


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 5, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.drop("shard").collect(), key=lambda r: r["doc_id"]) == sorted(docs.collect(), key=lambda r: r["doc_id"])
    want = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 5).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want


def test_positions_of_a_hot_key(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 1, 1, 2, 5]), rng.choice([None, rng.randint(0, 40)]), i) for i in range(3000)]
    df = settle(spark.createDataFrame(rows, "k int, t int, at long").repartition(7), "t")
    got = {r["at"]: r["no"] for r in positions(df, ["k"], ["t", "at"], "no").collect()}
    null_first = lambda v: (v is not None, v or 0)
    seen = Counter()
    for k, _, at in sorted(rows, key=lambda r: (null_first(r[0]), null_first(r[1]), r[2])):
        seen[k] += 1
        assert got[at] == seen[k]
