"""SimHash near-duplicates: fingerprints of all rows, then an exact comparison of tiles of distinct fingerprints.

Tiles hold fingerprints of one population count. Two fingerprints within the radius have population counts that differ
by no more, so other pairs of tiles are never made. A pair of tiles is one task-sized piece of work: numpy exclusive-or
and bit counts, and only a spanning forest of the links found leaves it, never all pairs.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other. Equal texts share a
fingerprint, so a group of copies of any size is one fingerprint. Repeated rows come back once per row. A null key
belongs to its component; it names the component only if no other key does. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, keyed_text, settle, slices, unite, utf8

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile; one comparison holds two tiles and a block of 512 rows of their matrix.
TILE = 16384
_BLOCK = 512
#: Partitions for pairs of tiles.
MOST_TASKS = 4000
_PAIR = ["k", "p", "k2", "p2"]


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    hashes = [digest(line[a:b], SEED) for a, b in zip([0, *ends[:len(words) - n].tolist()], (ends[n - 1:] - 1).tolist(), strict=True)]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes)).tobytes()
    return int.from_bytes(bits, "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        raw = [memoryview(data)[at[i]:at[i + 1]].tobytes() for a, b in slices(at) for i in range(a, b)]
        prints = np.array([fingerprint(t) for t in raw], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp of every row."""
    rows = keyed_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, text_hash bigint, fp bigint")


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """The tiles of one pair (or one tile alone) to a spanning forest of the links within and between them."""
    sides = table.column("side").to_pylist()
    tiles = [np.frombuffer(t, np.uint64) for t in table.column("prints").to_pylist()]
    if len(tiles) == 1:
        left = right = tiles[0]
        shift = 0
    else:
        left, right = (tiles[sides.index(k)] for k in (0, 1))
        shift = len(left)
    nodes = left if shift == 0 else np.concatenate([left, right])
    parent = np.arange(len(nodes))
    for k in range(0, len(left), _BLOCK):
        near = np.bitwise_count(left[k:k + _BLOCK, None] ^ right[None, :]) <= RADIUS
        a, b = np.nonzero(near)
        if len(a):
            unite(parent, a + k, b + shift)
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    signed = nodes.view(np.int64)
    return pa.table({"a": signed[child], "b": signed[parent[child]]})


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """A spanning forest (a, b) of all links between distinct fingerprints (column fp)."""
    spark = prints.sparkSession
    counted = prints.select("fp", F.bit_count("fp").alias("ones"))
    sizes = {r["ones"]: r["count"] for r in counted.groupBy("ones").count().collect()}  # 65 rows at most
    parts = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, -(-n // tile))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    placed = counted.withColumn("part", F.pmod(F.xxhash64("fp"), parts[F.col("ones")]).cast("int"))
    packed = settle(placed.groupBy("ones", "part").applyInArrow(_pack, "ones int, part int, prints binary"), "tiles")
    tiles = {k: -(-n // tile) for k, n in sizes.items()}
    near = [(k, tiles[k], k + d, tiles[k + d]) for k in tiles for d in range(RADIUS + 1) if k + d in tiles]  # 325 at most
    lines = spark.createDataFrame(near, "k int, n int, k2 int, n2 int")
    # the pairs of tiles grow with the square of the tiles, so tasks make them, not the driver
    rows = lines.withColumn("p", F.explode(F.expr("sequence(0, n - 1)"))).repartition("k", "p", "k2")
    pairs = rows.withColumn("p2", F.explode(F.expr("sequence(if(k = k2, p, 0), n2 - 1)"))).select(*_PAIR)
    sides = pairs.select(*_PAIR, F.lit(0).alias("side"), F.col("k").alias("ones"), F.col("p").alias("part")).unionByName(
        pairs.where("k <> k2 or p <> p2").select(*_PAIR, F.lit(1).alias("side"), F.col("k2").alias("ones"), F.col("p2").alias("part")))
    # the bytes of a pair say nothing of its work, so the pairs, not their size, decide over how many partitions they go
    n = sum(n * (n + 1) // 2 if k == k2 else n * n2 for k, n, k2, n2 in near)
    work = sides.join(packed, ["ones", "part"]).select(*_PAIR, "side", "prints").repartition(max(1, min(n, MOST_TASKS)), *_PAIR)
    return work.groupBy(*_PAIR).applyInArrow(_compare, "a bigint, b bigint")


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    prints = np.sort(table.column("fp").to_numpy())
    return pa.table({"ones": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "prints": pa.array([prints.tobytes()], pa.binary())})


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = settle(fingerprints(docs), "prints")
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = settle(components(links(distinct.select("fp"), tile)), "roots")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
