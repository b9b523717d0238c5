"""Near copies by SimHash tiles with an exact check: texts are linked if their sets of five-word shingles have a Jaccard
similarity of LIKENESS or more.

Fingerprints of 512 bits only propose pairs, within a radius well beyond what that similarity gives (wider for sets of few
shingles, whose majorities are coarse); the whole sets of proposed pairs are compared. Equal sets are one node, so copies make
no pairs. Sets so similar have sizes within a factor of 1 / LIKENESS, so nodes lie in bands of that factor, and only tiles of one
or two neighbouring bands meet.

Pairs never leave a task. First each node keeps the least and the nearest node it is proposed with, two pairs a node at most, and
what is alike there is united. Then the tiles of the nodes that have any proposal meet again: the nodes with a proposal in
another class are named, only their sets are sent to that pair of tiles, each proposal between different classes is compared,
and a spanning forest of what is alike comes back. So rows, shuffle and disk grow with nodes and the tiles they have proposals
in; only comparisons, in numpy, grow with the square of a group of texts that are nearly but not quite alike.

Defined results: words lie between white space, lower case. Null and blank texts have no words and are one group; texts of
fewer than five words are one shingle. A null key belongs to its component; it names the component only if no other key does.
Repeated rows come back once per row. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SOLID, Words, components, forget, keyed_text, mixed, settle, slices, unite, utf8

WORDS, LIKENESS = 5, 0.8
#: Fingerprint words of 64 bits; FIRST of them are compared before the others.
LANES, FIRST = 8, 2
#: Bits by which a proposed pair may differ, in the first words and in all; sets of up to FEW shingles have the wider ones.
FEW, RADIUS, WIDE_RADIUS = 8, (40, 112), (48, 144)
#: Nodes of a tile, and shingles that a tile's sets may hold together unless it has only LEAST_TILE nodes.
TILE, TILE_SHINGLES, LEAST_TILE = 8192, 1 << 22, 32
_BLOCK = 512
#: Partitions for pairs of tiles; their bytes say nothing of the work in them.
MOST_TASKS = 4000
_SALT = np.array([0] + [(k * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % (1 << 64) for k in range(1, LANES)], np.uint64)
_PAIR = ["k", "p", "k2", "p2"]
_PRINTS = [f"f{k}" for k in range(LANES)]
_NODE = {"node": np.int64, "class": np.int64, "prints": np.uint64, "size": np.int64}


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted within each row, and the offsets of the rows."""
    words = Words(data, at, SOLID)
    size = np.diff(words.first)
    hashes, rows = [], []
    for n in range(1, WORDS + 1):
        own, first = words.grams(n)
        row = words.row[first]
        fit = size[row] >= n if n == WORDS else size[row] == n
        hashes.append(own[fit])
        rows.append(row[fit])
    hash_, row = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((hash_, row))
    hash_, row = hash_[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])
    return hash_[new], np.searchsorted(row[new], np.arange(len(at)))


def prints(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(rows, LANES): a bit of a row is set if it is set in over half of its shingles."""
    size = np.diff(cut)
    total = np.zeros((len(size), 64 * LANES), np.int32)
    row = np.repeat(np.arange(len(size)), size)
    for k in range(0, len(hashes), 1 << 14):
        part, own = hashes[k:k + (1 << 14)], row[k:k + (1 << 14)]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        all_ = np.stack([part, *(mixed(part ^ salt) for salt in _SALT[1:])], axis=1)
        bits = np.unpackbits(all_.view(np.uint8).reshape(len(part), -1), axis=1)
        total[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(total * 2 > size[:, None], axis=1).view(np.uint64)


def _node_of(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return np.array([xxhash.xxh64_intdigest(raw[8 * a:8 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        nodes, sizes, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, LANES), np.uint64)]
        for a, b in slices(at):
            hashes, cut = shingle_sets(data, at[a:b + 1])
            nodes.append(_node_of(hashes, cut))
            sizes.append(np.diff(cut))
            marks.append(prints(hashes, cut))
        lanes = [pa.array(x) for x in np.ascontiguousarray(np.concatenate(marks).T).view(np.int64)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), *lanes],
            ["doc_id", "text_hash", "node", "size", *_PRINTS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        out: list[bytes] = []
        for a, b in slices(at):
            hashes, cut = shingle_sets(data, at[a:b + 1])
            out += [hashes[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough; in whole numbers, so that ties count."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(both * 100 >= round(LIKENESS * 100) * (len(x) + len(y) - both))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))
        good = [alike(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _lanes(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in _PRINTS], axis=1).view(np.uint64)


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    return pa.table({"band": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "prints": pa.array([_lanes(table).tobytes()], pa.binary()),
                     **{c: pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in _NODE if c != "prints"}})


def _near(left: dict[str, np.ndarray], right: dict[str, np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of all pairs within the radius whose classes differ and sizes fit, and their distances, block by block of left rows."""
    for k in range(0, len(left["node"]), _BLOCK):
        end = k + _BLOCK
        mine, theirs = left["prints"][k:end], right["prints"]
        far = np.bitwise_count(mine[:, None, 0] ^ theirs[:, 0])
        for lane in range(1, FIRST):
            far += np.bitwise_count(mine[:, None, lane] ^ theirs[:, lane])
        sizes = left["size"][k:end, None], right["size"]
        small, large = np.minimum(*sizes), np.maximum(*sizes)
        near = far <= np.where(small <= FEW, WIDE_RADIUS[0], RADIUS[0])
        near &= small * 100 >= round(LIKENESS * 100) * large
        near &= left["class"][k:end, None] != right["class"]
        if same:
            near &= left["node"][k:end, None] > right["node"]
        a, b = np.nonzero(near)
        if len(a):
            whole = far[a, b].astype(np.int32)
            for lane in range(FIRST, LANES):
                whole += np.bitwise_count(mine[a, lane] ^ theirs[b, lane])
            keep = whole <= np.where(small[a, b] <= FEW, WIDE_RADIUS[1], RADIUS[1])
            yield a[keep] + k, b[keep], whole[keep]


def _tiles(table: pa.Table) -> tuple[list[dict[str, np.ndarray]], bool]:
    sides = table.column("side").to_pylist()
    tiles = [{c: np.frombuffer(table.column(c)[sides.index(k)].as_buffer(), t) for c, t in _NODE.items()} for k in sorted(sides)]
    for t in tiles:
        t["prints"] = t["prints"].reshape(-1, LANES)
    return [tiles[0], tiles[-1]], len(tiles) == 1


def _propose(key: tuple, table: pa.Table) -> pa.Table:
    """For each node of a pair of tiles the least and the nearest node it is proposed with."""
    (left, right), same = _tiles(table)
    out = [np.zeros((3, 0), np.int64)]
    for a, b, far in _near(left, right, same):
        for one, other in ((left["node"][a], right["node"][b]), (right["node"][b], left["node"][a])):
            for order in (np.lexsort((other, one)), np.lexsort((other, far, one))):
                first = order[np.flatnonzero(np.append(True, one[order][1:] != one[order][:-1]))] if len(order) else order
                out.append(np.stack([one[first], other[first], far[first].astype(np.int64)]))
    rows = np.concatenate(out, axis=1)
    return pa.table({"node": rows[0], "other": rows[1], "far": rows[2]})


def _involved(key: tuple, table: pa.Table) -> pa.Table:
    """The nodes of a pair of tiles that have a proposal in another class."""
    (left, right), same = _tiles(table)
    seen = [np.zeros(0, np.int64)]
    for a, b, _ in _near(left, right, same):
        seen += [np.unique(left["node"][a]), np.unique(right["node"][b])]
    nodes = np.unique(np.concatenate(seen))
    return pa.table({**{c: pa.array([k.as_py()] * len(nodes), pa.int32()) for c, k in zip(_PAIR, key, strict=True)}, "node": nodes})


def _verify(key: tuple, table: pa.Table) -> pa.Table:
    """Nodes of a pair of tiles with their sets: the proposals between different classes that are alike, as a forest."""
    table = table.sort_by("node")
    side = {c: table.column(c).to_numpy() for c in ("node", "class", "size", "home")}
    side["prints"] = _lanes(table)
    raw = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
    words, codes = np.unique(np.concatenate(raw), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum([len(v) for v in raw])])
    _, kind = np.unique(side["class"], return_inverse=True)
    parent = np.arange(int(kind.max()) + 1)
    k, p, k2, p2 = (x.as_py() for x in key)
    homes = [np.flatnonzero(side["home"] == h) for h in ((k * 1_000_000 + p), (k2 * 1_000_000 + p2))]
    left, right = ({c: v[h] for c, v in side.items()} for h in homes)
    mark, edges = np.zeros(len(words), bool), []
    for a, b, _ in _near(left, right, homes[0] is homes[1] or (k, p) == (k2, p2)):
        for i in np.unique(a).tolist():
            x = int(homes[0][i])
            others = homes[1][b[a == i]]
            others = others[parent[kind[others]] != parent[kind[x]]]
            if not len(others):
                continue
            mark[codes[cut[x]:cut[x + 1]]] = True
            size = cut[others + 1] - cut[others]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            places = np.repeat(cut[others] - starts, size) + np.arange(int(size.sum()))
            both = np.add.reduceat(mark[codes[places]], starts, dtype=np.int64)
            mark[codes[cut[x]:cut[x + 1]]] = False
            good = others[both * 100 >= round(LIKENESS * 100) * (size + (cut[x + 1] - cut[x]) - both)]
            for y in good.tolist():
                if parent[kind[x]] != parent[kind[y]]:
                    unite(parent, kind[[x]], kind[[y]])
                    edges.append((int(side["node"][x]), int(side["node"][y])))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _meetings(nodes: DataFrame, tile: int) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    """Pairs of tiles (k, p, k2, p2, side and the tile's columns) of nodes (node, class, size and prints), dealt over as many
    partitions as there are pairs, up to a bound; the nodes with their band and part; the settled tiles."""
    spark = nodes.sparkSession
    banded = nodes.where("size > 0").withColumn("band", F.floor(F.log("size") / np.log(1 / LIKENESS)).cast("int"))
    most = {r["band"]: (r["n"], min(tile, max(LEAST_TILE, TILE_SHINGLES // r["size"]))) for r in banded.groupBy("band").agg(
        F.count("*").alias("n"), F.max("size").alias("size")).collect()}  # some 90 rows at most
    if not most:
        return None, banded, None
    tiles = {k: -(-n // size) for k, (n, size) in most.items()}
    parts = F.create_map(*[F.lit(x) for item in tiles.items() for x in item])
    placed = banded.withColumn("part", F.pmod(F.xxhash64("node"), parts[F.col("band")]).cast("int"))
    fields = ", ".join(f"{c} binary" for c in ("prints", "node", "class", "size"))
    packed = settle(placed.groupBy("band", "part").applyInArrow(_pack, f"band int, part int, {fields}"), "tiles")
    meet = [(k, tiles[k], k + d, tiles[k + d]) for k in tiles for d in (0, 1) if k + d in tiles]
    rows = spark.createDataFrame(meet, "k int, n int, k2 int, n2 int").withColumn("p", F.explode(F.expr("sequence(0, n - 1)"))).repartition("k", "p", "k2")
    pairs = rows.withColumn("p2", F.explode(F.expr("sequence(if(k = k2, p, 0), n2 - 1)"))).select(*_PAIR)
    sides = pairs.select(*_PAIR, F.lit(0).alias("side"), F.col("k").alias("band"), F.col("p").alias("part")).unionByName(
        pairs.where("k <> k2 or p <> p2").select(*_PAIR, F.lit(1).alias("side"), F.col("k2").alias("band"), F.col("p2").alias("part")))
    n = sum(tiles[k] * (tiles[k] + 1) // 2 if k == k2 else tiles[k] * tiles[k2] for k, _, k2, _ in meet)
    work = sides.join(packed, ["band", "part"]).select(*_PAIR, "side", *_NODE)
    return work.repartition(min(n, MOST_TASKS), *_PAIR), placed, packed


def links(texts: DataFrame, distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all alike nodes. texts: doc_id, text, text_hash; distinct: node, size, the prints
    and one text of each node (text_hash, pick: its doc_id)."""
    none = distinct.sparkSession.createDataFrame([], "a bigint, b bigint")
    alone = distinct.select("node", F.col("node").alias("class"), "size", *_PRINTS)
    work, _, packed = _meetings(alone, tile)
    if work is None:
        return none
    found = work.groupBy(*_PAIR).applyInArrow(_propose, "node bigint, other bigint, far bigint")
    first = settle(found.groupBy("node").agg(F.min("other").alias("least"), F.min_by("other", "far").alias("nearest")), "proposed")
    forget(packed)
    wanted = first.select("node").join(distinct.select("node", "text_hash", "pick"), "node").withColumnRenamed("text_hash", "_hash")
    own = texts.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("pick"))).select("node", "text")
    sets = settle(own.mapInArrow(_sets, "node bigint, shingles binary").dropDuplicates(["node"]), "sets")
    pairs = first.select("node", F.explode(F.array("least", "nearest")).alias("other")).select(
        F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    edges = settle(both.mapInArrow(_checked, "a bigint, b bigint"), "edges")
    classes = settle(components(edges), "classes")
    again = settle(distinct.join(first.select("node"), "node").join(classes, "node", "left").select(
        "node", F.coalesce("root", "node").alias("class"), "size", *_PRINTS), "again")
    work, placed, packed = _meetings(again, tile)
    if work is not None:
        named = settle(work.groupBy(*_PAIR).applyInArrow(_involved, ", ".join(f"{c} int" for c in _PAIR) + ", node bigint"), "involved")
        home = (F.col("band").cast("bigint") * 1_000_000 + F.col("part")).alias("home")
        sent = named.join(placed.select("node", "class", "size", *_PRINTS, home), "node").join(sets, "node")
        forest = settle(sent.groupBy(*_PAIR).applyInArrow(_verify, "a bigint, b bigint"), "forest")
        for t in (packed, named):
            forget(t)
        edges = edges.unionByName(forest)
    for t in (first, sets, classes, again):
        forget(t)
    return edges


def near_copies(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, text_hash, root, component_id of every row; root is the least node of the component."""
    texts = keyed_text(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = settle(texts.mapInArrow(_rows, "doc_id bigint, text_hash bigint, node bigint, size bigint, " + ", ".join(f"{c} bigint" for c in _PRINTS)), "prints")
    same = ["size", *_PRINTS]
    each = rows.groupBy("node", "text_hash").agg(F.min("doc_id").alias("pick"), *[F.max(c).alias(c) for c in same])
    distinct = settle(each.groupBy("node").agg(
        F.min("pick").alias("least"), F.min_by("pick", "text_hash").alias("pick"), F.min("text_hash").alias("text_hash"), *[F.max(c).alias(c) for c in same]), "distinct")
    found = settle(components(links(texts, distinct, tile)), "roots")
    rooted = settle(distinct.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = settle(rows.select("doc_id", "text_hash", "node").join(rooted.join(named, "root").select("node", "root", "component_id"), "node").drop("node"), "named")
    for t in (rows, distinct, found, rooted):
        forget(t)
    return out


def keep_one(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """One row of each component, with its own columns: that of the least key (null keys last); of several rows with that key, one
    of the least text hash."""
    classes = near_copies(docs, tile).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    each = classes.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = each.groupBy("root", "doc_id").agg(F.min("text_hash").alias("_kept_hash"), F.min_by("n", "text_hash").alias("_n"))
    kept = settle(kept.select(F.col("doc_id").alias("_kept_id"), "_kept_hash", "_n"), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]  # clear of any name the input has
    key, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names).withColumn("_hash", F.xxhash64(text.cast("string")))
    rows = rows.join(kept, key.cast("bigint").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")))
    # only rows that repeat need a second shuffle
    out = rows.where("_n = 1").unionByName(rows.where("_n > 1").dropDuplicates(["_kept_id", "_kept_hash"]))
    return out.select(*names).toDF(*docs.columns)
