"""Helpers of the text operators: Arrow text to numpy bytes, hashed tokens, shared folders, loops over edges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, so that further or clashing columns of the input never matter."""
    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; without that setting only a local session may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe when executors go."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table that settle() made."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sample_texts(texts: DataFrame, rows: int, where: Column | None = None) -> DataFrame:
    """About `rows` distinct texts (column text) of those that meet the condition, chosen by hash: neither the order of rows nor the
    number of copies of a text matters. The share comes from an approximate distinct count over all rows, so no limit is needed."""
    own = texts.where("text is not null").select("text", F.xxhash64("text").alias("_h"))
    own = own if where is None else own.where(where)
    n = own.agg(F.approx_count_distinct("_h")).first()[0]
    most = 1 << 48
    share = min(most, int(most * rows / max(n, 1)) + 1)
    return own.where(F.pmod(F.col("_h"), F.lit(most)) < F.lit(share)).dropDuplicates(["_h"]).select("text")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer row stands alone."""
    rows, first = len(at) - 1, 0
    while first < rows:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def fold_table(word: Callable[[int], bool]) -> np.ndarray:
    """Byte to lower-case byte inside words, 0 outside."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if word(b):
            table[b] = b + 32 if 65 <= b <= 90 else b
    return table


#: Letters and digits of ASCII, and every byte of a longer character.
ALNUM = fold_table(lambda b: b >= 128 or chr(b).isalnum())
#: All but ASCII white space.
SOLID = fold_table(lambda b: b not in (32, 9, 10, 11, 12, 13))

_random = np.random.RandomState(20240607)
_BYTE = (_random.randint(0, 1 << 32, 256).astype(np.uint64) << np.uint64(32)) | _random.randint(0, 1 << 32, 256).astype(np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread hashes over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes between start and end, the same wherever those bytes stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values; a run ends where its row ends."""
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = bounds[:-1] < bounds[1:]
        first[bounds[:-1][filled]] = inside[bounds[:-1][filled]]
        last[bounds[1:][filled] - 1] = inside[bounds[1:][filled] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The tokens of some rows: start, end (bytes in the slice), row, hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray = ALNUM):
        self.base = int(at[0])
        self.raw = data[at[0]:at[-1]]
        self.bytes = table[self.raw]
        self.bounds = at - at[0]
        self.start, self.end = runs(self.bytes != 0, self.bounds)
        self.row = np.searchsorted(self.bounds, self.start, "right") - 1
        self.hash = span_hash(prefix_hash(self.bytes), self.start, self.end)
        self.first = np.searchsorted(self.row, np.arange(len(at)))  # first token of each row, and the end

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n tokens within a row, and the index of its first token."""
        size = len(self) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = self.hash[:size].copy()
        for k in range(1, n):
            out = out * np.uint64(_BASE) + self.hash[k:k + size]
        keep = np.flatnonzero(self.row[:size] == self.row[n - 1:])
        return mixed(out[keep]), keep


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each key in a sorted array, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    where = np.searchsorted(sorted_keys, keys)
    where[where == len(sorted_keys)] = 0
    return where, sorted_keys[where] == keys


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; every root is the least member."""
    while len(a):
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the least node that can be reached.

    Each round links every neighbour of a node to the least one (large star), then every smaller neighbour to the
    least (small star). The table of edges never outgrows the first one, and is settled in the shared folder each round.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following = settle(small.where("a <> b").distinct(), "edges")
        forget(now)
        now = following
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def with_column(docs: DataFrame, name: str, kind: str, fn: Callable[[pa.Array], pa.Array], text: str = "text") -> DataFrame:
    """All columns of docs and one that a function of the text column adds; narrow, nothing is shuffled."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, fn(batch.column(at))], [*plain, "new"])

    schema = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, docs.schema.fields, strict=True))
    return docs.toDF(*plain).mapInArrow(run, f"{schema}, new {kind}").toDF(*docs.columns, name)


def free_name(docs: DataFrame, stem: str) -> str:
    return next(n for i in range(len(docs.columns) + 1) if (n := f"_{stem}{i}") not in docs.columns)


def _counted(key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the rows of each key in a sorted partition, from 1; lead says that the partition began within the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        seen = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for name in key:
                column = batch.column(batch.schema.get_field_index(name))
                same = pc.equal(column[1:], column[:-1])
                both = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
                new[1:] |= ~np.asarray(pc.or_(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False), bool)
            ends = [tuple(batch.column(batch.schema.get_field_index(k))[i].as_py() for k in key) for i in (0, n - 1)]
            first = ends[0] if first is None else first
            new[0] = last != ends[0]
            run_of = np.cumsum(new)
            begins = np.flatnonzero(new)
            at = np.arange(n)
            local = np.where(run_of == 0, seen + at + 1, at - np.append(begins, 0)[np.maximum(run_of, 1) - 1] + 1)
            lead = (run_of - new[0] == 0) & (ends[0] == first)
            seen, last = int(local[-1]), ends[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local), pa.array(lead)], [*batch.schema.names, "_local", "_lead"])

    return run


def positions(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """df and a column that numbers the rows of each key from 1 by order (nulls first).

    Rows are range-partitioned by key and order, so a key of any size is spread over many tasks. Within a partition they are
    numbered as they stream by; only the key that a partition begins with can have rows in earlier ones, so one row per
    partition carries the offsets. df must be settled, and order must tell rows apart (a stored row number at the end).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c).asc_nulls_first() for c in [*key, *order]]
    dealt = df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = dealt.mapInArrow(_counted(key), f"{fields}, _local bigint, _lead boolean").withColumn("_part", F.spark_partition_id())
    local = settle(local, "numbered")
    tops = local.groupBy("_part", *key).agg(F.max("_local").alias("_n"), F.max("_lead").alias("_lead"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.withColumn("_before", F.sum("_n").over(before)).where("_lead and _before > 0").select("_part", "_before")
    out = local.join(F.broadcast(carry), "_part", "left")  # one row per partition at most
    return out.select(*df.columns, (F.col("_local") + F.when(F.col("_lead"), F.coalesce("_before", F.lit(0))).otherwise(0)).alias(name))
