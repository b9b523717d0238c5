"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group is all rows of one text; it is never cut. A partial partition holds one sum per shard. Differencing starts from one
partial partition per group and repeatedly combines the two of largest spread, oppositely ordered: the fullest shard of one
meets the emptiest of the other, so that their spreads cancel. The order of combinations is undone from the last to the
first, which gives every group its shard.

At scale: rows are reduced to (text hash, bytes) before any shuffle, so copies cost nothing. Groups of at least 1/HEADS of all
bytes, HEADS at most by their size, are differenced in one task. What they leave uneven is cut into equal shares, one for each
block of the remaining groups; every block is differenced by itself from its share on, and levels it. A shard's sum is the sum
over blocks, so the blocks' last spreads, a few bytes each, are all that remains. A group larger than a shard's fair part
keeps its shard to itself, and the others share the rest evenly.

Defined results: a null text counts as an empty one (size 1, checksum 0, one group). A null key sorts first; repeated rows each
have a slot. Two texts of one hash would only stay together. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, positions, settle

SHARDS = 16
#: Groups of at least this share of all bytes come first; no more than so many can exist.
HEADS = 4096
#: Groups of a block, one task's work.
BLOCK = 1 << 16


def difference(sizes: list[int], shards: int, start: list[int] | None = None) -> tuple[list[int], list[int]]:
    """The shard of each size, and the sums of the shards. start: sums that the shards have already, kept where they are."""
    base = start or [0] * shards
    order = sorted(range(shards), key=lambda j: -base[j])
    floor = min(base)
    seed = tuple(base[j] - floor for j in order)
    # a partial partition: its sums over its least one, fullest shard first; the number breaks ties, oldest first
    heap = [(-x, i, (x,) + (0,) * (shards - 1)) for i, x in enumerate(sizes)]
    first = len(sizes)
    heap.append((-seed[0], first, seed))
    heapq.heapify(heap)
    lanes = range(shards)
    steps: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heap[0]
        sums = [x + y for x, y in zip(left, reversed(right), strict=True)]
        turn = sorted(lanes, key=sums.__getitem__, reverse=True)
        least = sums[turn[-1]]
        steps.append((a, b, turn))
        heapq.heapreplace(heap, (least - sums[turn[0]], first + len(steps), tuple(sums[j] - least for j in turn)))
    names: dict[int, list[int]] = {first + len(steps): list(lanes)}
    for k in range(len(steps) - 1, -1, -1):
        a, b, turn = steps[k]
        own = names.pop(first + k + 1)
        left, right = [0] * shards, [0] * shards
        for lane, j in zip(own, turn, strict=True):
            left[j] = lane
            right[shards - 1 - j] = lane
        names[a], names[b] = left, right
    # the seed's shards keep their names; all others follow
    rename = [0] * shards
    for j, lane in enumerate(names[first]):
        rename[lane] = order[j]
    out, total = [], list(base)
    for i, x in enumerate(sizes):
        shard = rename[names[i][0]]
        out.append(shard)
        total[shard] += x
    return out, total


def _placed(shards: int, start: list[int], blocks: int):
    """A block's groups (key, size) to their shards; the block levels its share of start."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        table = table.sort_by([("size", "descending"), ("key", "ascending")])
        share = [x * (k + 1) // blocks - x * k // blocks for x in start]
        out, _ = difference(table.column("size").to_pylist(), shards, share)
        return pa.table({"key": table.column("key"), "size": table.column("size"), "shard": pa.array(out, pa.int32())})

    return run


def balance(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """key, size, shard of every group (key bigint, size bigint); sums of size are as even as the groups allow."""
    kind = "key bigint, size bigint, shard int"
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * HEADS >= total
    heads = settle(groups.where(large).groupBy(F.lit(0).alias("block")).applyInArrow(_placed(shards, [0] * shards, 1), kind), "heads")
    sums = {r["shard"]: r["bytes"] for r in heads.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # one row per shard
    rest = groups.where(~large)
    blocks = max(1, -(-rest.count() // block))
    start = [sums.get(j, 0) for j in range(shards)]
    dealt = rest.select("key", "size", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    placed = dealt.repartition(min(blocks, 10_000), "block").groupBy("block").applyInArrow(_placed(shards, start, blocks), kind)
    return heads.unionByName(placed)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"), F.monotonically_increasing_id().alias("at"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shard_of_groups(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """key, shard of every distinct text of docs; key is text_key(text)."""
    groups = settle(docs.groupBy(text_key(F.col("text")).alias("key")).agg(
        F.sum((F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("bigint")).alias("size")), "groups")
    return settle(balance(groups, shards, block).select("key", "shard"), "shards")


def assign(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; slots of a shard follow doc_id, then the text's hash."""
    rows = settle(_rows(docs), "rows")
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    where = settle(balance(groups, shards, block).select("key", "shard"), "shards")
    placed = settle(rows.join(where, "key"), "placed")
    out = positions(placed, ["shard"], ["doc_id", "key", "at"], "slot")
    for used in (rows, groups, where, placed):
        forget(used)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, block: int = BLOCK, files: int = 1) -> None:
    """The rows of docs with all their columns, in one folder per shard (shard=0, shard=1, ...) of so many files each or more."""
    where = shard_of_groups(docs, shards, block)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("key", text_key(F.col(names[docs.columns.index("text")])))
    out = rows.join(where, "key").select(*names, "shard").toDF(*docs.columns, "_shard" if "shard" in docs.columns else "shard")
    at = out.columns[-1]
    out.repartition(shards * files, at, F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))).write.partitionBy(at).parquet(path)


def spread(assigned: DataFrame) -> DataFrame:
    """shard, rows, bytes of an assignment, to see how even it is."""
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
