"""Hard negatives by angular triangle filtering, scored in integers.

Every vector keeps its angles to a few reference directions. By the triangle inequality on the sphere, the angle between two
vectors lies between the difference and the sum of their angles to a reference; the cosine interval times both norms bounds
their score, widened by SLACK against rounding. A tile holds vectors of one nearest reference, sorted by the angle to it. For an
anchor and the least score it can still use, only a window of the tile can matter, found by binary search, and only windows are
scored. Scores are exact: float64 products where all sums stay below 2**53, 64-bit integers beyond.

Anchors first meet the tiles of their own reference, which gives a least score for each list, then all tiles. Positives come
first, their scores then bound the negatives. Anchors travel to the groups of tiles in blocks, tiles are shuffled once a
pass and never copied per anchor; a task keeps the best few of each list, so what leaves it does not grow with the rows it read.
References are fitted on a bounded sample (SAMPLE rows of least hash); they only decide how much is skipped, never what is found.

Defined results: a row without label, vector or vec_id, or with a null or non-finite component, takes no part; neither does one whose
scaled norm reaches 2**31, as scores must fit 64 bits. Missing components of a shorter vector count as zero. Rows with the anchor's own
vec_id are never its positives or negatives; other repeated rows are rows of their own, a repeated anchor row is one anchor. An
empty table, or one without anchors, gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, settle

SCALE, EVERY, LABELS, TOP = 256, 100, 10, 5
#: A negative scores at least LEAST hundredths of the positive.
LEAST = 80
REFERENCES, SAMPLE = 16, 1024
#: Rows of a tile and of a block of anchors; a task scores STRIP anchors of a block against one tile at a time.
TILE, BLOCK, STRIP = 8192, 512, 64
#: Groups of tiles at most: anchors are copied to each.
GROUPS = 400
#: Radians by which angles may be wrong.
SLACK = 1e-6
_NONE = np.iinfo(np.int64).min
_ROW = "vec_id bigint, label bigint, vector binary, wide boolean, cell int, angle double"
_PACKED = "cell int, part int, n int, width int, ids binary, labels binary, vectors binary, angles binary, low double, high double, norm double"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column as doubles (null: NaN), start and length of each row; a null row has length -1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()
    size = np.diff(at)
    return values, at[:-1], np.where(np.asarray(column.is_null()), -1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(1))
    return vectors / np.where(norm > 0, norm, 1)[:, None]


def _fit(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors with so many components: zeros follow, or a tail goes."""
    if vectors.shape[1] >= width:
        return vectors[:, :width]
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def angles(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each vector to each reference; a zero vector is at right angles to all."""
    width = max(vectors.shape[1], references.shape[1])
    return np.arccos(np.clip(_unit(_fit(vectors, width)) @ _fit(references, width).T, -1, 1))


def references(embeddings: DataFrame) -> np.ndarray:
    """Unit directions far from each other, from the rows of least hash."""
    rows = embeddings.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()  # SAMPLE rows at most
    own = [r["v"] for r in rows if r["v"] and all(x is not None and np.isfinite(x) for x in r["v"])]
    width = max((len(v) for v in own), default=1)
    vectors = _unit(np.array([v + [0.0] * (width - len(v)) for v in own] or [[1.0]]) / (max((abs(x) for v in own for x in v), default=0.0) or 1.0))
    picks, nearest = [0], vectors @ vectors[0]
    while len(picks) < min(REFERENCES, len(vectors)):
        picks.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[picks[-1]])
    return vectors[picks]


def _prepared(refs: np.ndarray, relabel: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            values, start, size = _lists(batch.column(2))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            for width in np.unique(size[size >= 0]).tolist():
                own = np.flatnonzero(size == width)
                own = own[bad[start[own] + width] == bad[start[own]]]
                for k in range(0, len(own), 4096):
                    part = own[k:k + 4096]
                    with np.errstate(over="ignore"):
                        vectors = np.floor(SCALE * values[start[part][:, None] + np.arange(width)])
                        fits = (vectors * vectors).sum(1) < 2.0 ** 62
                    part, vectors = part[fits], vectors[fits]
                    if not len(part):
                        continue
                    far = angles(vectors, refs)
                    cell = far.argmin(1)
                    wide = np.abs(vectors).max(1, initial=0) >= 1 << 15
                    raw = [v.astype(np.int32 if w else np.int16).tobytes() for v, w in zip(vectors, wide.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[part]), pa.array(relabel(ids[part], label[part])), pa.array(raw, pa.binary()), pa.array(wide),
                        pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(part)), cell])], ["vec_id", "label", "vector", "wide", "cell", "angle"])

    return run


def _shifted(ids: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.where(ids % 7 == 0, np.fmod(label + 1, LABELS), label)


def _dense(raw: list[bytes], wide: list[bool]) -> np.ndarray:
    own = [np.frombuffer(v, np.int32 if w else np.int16) for v, w in zip(raw, wide, strict=True)]
    out = np.zeros((len(own), max(map(len, own), default=0)), np.int32 if any(wide) else np.int16)
    for i, v in enumerate(own):
        out[i, :len(v)] = v
    return out


def _pack(extra: list[str], refs: np.ndarray):
    """Rows of one tile or block, sorted by angle; extra columns follow as lists. Vectors of anchors and rows keep their integer size."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("angle", "ascending"), ("vec_id", "ascending"), ("label", "ascending"), ("vector", "ascending")])
        vectors = _dense(table.column("vector").to_pylist(), table.column("wide").to_pylist())
        angle = table.column("angle").to_numpy()
        norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        one = {"cell": key[0].as_py(), "part": key[1].as_py(), "n": len(angle), "width": 4 if vectors.dtype == np.int32 else 2,
               "ids": table.column("vec_id").to_numpy().tobytes(), "labels": table.column("label").to_numpy().tobytes(), "vectors": vectors.tobytes(),
               "angles": angle.tobytes(), "low": float(angle[0]), "high": float(angle[-1]), "norm": float(norm.max())}
        columns = {f.name: pa.array([one[f.name]], f.type) for f in _schema(_PACKED)}
        for name in extra:
            columns[name] = pa.array([table.column(name).to_pylist()], pa.list_(pa.int64() if name == "akey" else pa.list_(pa.int64())))
        if extra:  # anchors: the nearest and farthest of them to each reference, and the least cosine times row norm that one needs
            far = angles(vectors.astype(np.float64), refs)
            least = np.array([min(x) if x else _NONE for x in table.column("floors").to_pylist()], np.float64)
            need = np.where(norm > 0, least / np.where(norm > 0, norm, 1), np.where(least > 0, np.inf, -np.inf))
            columns |= {"near": pa.array([far.min(0).tolist()], pa.list_(pa.float64())), "far": pa.array([far.max(0).tolist()], pa.list_(pa.float64())),
                        "need": pa.array([float(need.min())])}
        return pa.table(columns)

    return run


def _schema(kind: str) -> list[pa.Field]:
    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return [pa.field(name, types[t]) for name, t in (f.split() for f in kind.split(", "))]


def _parts(rows: DataFrame, most: int) -> tuple[Column, dict[int, int]]:
    """A part of its cell for each row, so that none holds many more than most rows."""
    counts = {r["cell"]: -(-r["count"] // most) for r in rows.groupBy("cell").count().collect()}  # one row per reference
    parts = F.create_map(*[F.lit(x) for item in counts.items() for x in item]) if counts else F.create_map(F.lit(0), F.lit(1))
    return F.pmod(F.xxhash64("vec_id", "label", "vector"), parts[F.col("cell")]).cast("int"), counts


class _Side:
    """A packed tile or block."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str):
        get = lambda name: batch.column(batch.schema.get_field_index(prefix + name))[i]
        self.n, kind = get("n").as_py(), np.int32 if get("width").as_py() == 4 else np.int16
        self.ids, self.labels = (np.frombuffer(get(c).as_buffer(), np.int64) for c in ("ids", "labels"))
        raw = np.frombuffer(get("vectors").as_buffer(), kind)
        self.vectors = raw.reshape(self.n, len(raw) // max(self.n, 1))
        self.angles = np.frombuffer(get("angles").as_buffer(), np.float64)
        self.cell = get("cell").as_py()
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))


def scores(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """Exact integer inner products; norms: the largest product of two norms, which bounds every partial sum."""
    width = max(a.shape[1], b.shape[1])
    a, b = _fit(a, width), _fit(b, width)
    if norms < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def window(alpha: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray | None, theta: np.ndarray, row_norms: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """First and last place among rows, sorted by their angles theta, of those that can score from least to most with each anchor."""
    low, high = row_norms
    top = norm * high
    ratio = least / np.where(top > 0, top, 1)
    reach = np.where(least > 0, np.arccos(np.clip(ratio, -1, 1)), np.pi) + SLACK  # a short row's score is never far below zero
    start, end = alpha - reach, alpha + reach
    if most is not None and low > 0:
        # a row whose sum of angles is small scores more than most for sure
        sure = np.clip(most / np.where(norm > 0, norm * low, 1), 0, 1)
        start = np.where((most >= 0) & (norm > 0), np.maximum(start, np.arccos(sure) - alpha - SLACK), start)
    first, last = np.searchsorted(theta, start, "left"), np.searchsorted(theta, end, "right")
    none = (ratio > 1 + SLACK) | ((top == 0) & (least > 0))
    return np.where(none, 0, first), np.where(none, 0, np.maximum(first, last))


def best(score: np.ndarray, ids: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The first rows by score, ties by smaller id."""
    if len(score) > 64:
        keep = score >= np.partition(score, len(score) - top)[len(score) - top]
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:top]
    return score[order], ids[order]


class _Lists:
    """The best rows so far of every list of a block of anchors. caps: the score a list must not pass, None for positives."""

    def __init__(self, batch: pa.RecordBatch, i: int, refs: np.ndarray, negative: bool):
        self.anchors = _Side(batch, i, "a_")
        get = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()
        self.keys = get("a_akey")
        self.floors, caps = get("a_floors"), get("a_caps")
        self.caps = caps if negative else [[None]] * len(self.keys)
        self.negative = negative
        self.found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own] for own in self.floors]
        self.least = np.array([min(x, default=np.inf) for x in self.floors], np.float64)
        self.most = np.array([max(x, default=-np.inf) for x in caps], np.float64) if negative else None
        self.angles = angles(self.anchors.vectors.astype(np.float64), refs)

    def meet(self, tile: _Side) -> None:
        own = self.anchors
        alpha = self.angles[:, tile.cell]
        first, last = window(alpha, own.norms, self.least, self.most, tile.angles, (tile.norms.min(), tile.norms.max()))
        active = np.flatnonzero(last > first)
        active = active[np.argsort(first[active], kind="stable")]
        for k in range(0, len(active), STRIP):
            rows = active[k:k + STRIP]
            a, b = int(first[rows].min()), int(last[rows].max())
            table = scores(own.vectors[rows], tile.vectors[a:b], float(own.norms[rows].max() * tile.norms[a:b].max()))
            near = table >= self.least[rows][:, None]
            same = own.labels[rows][:, None] == tile.labels[None, a:b]
            near &= ~same if self.negative else same
            near &= own.ids[rows][:, None] != tile.ids[None, a:b]
            for j in np.flatnonzero(near.any(1)).tolist():
                places = np.flatnonzero(near[j])
                self.add(int(rows[j]), table[j, places], tile.ids[a + places])

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        for k, cap in enumerate(self.caps[i]):
            fit = score >= self.floors[i][k]
            if cap is not None:
                fit &= score <= cap
            if not fit.any():
                continue
            had = self.found[i][k]
            now = best(np.concatenate([had[0], score[fit]]), np.concatenate([had[1], ids[fit]]))
            self.found[i][k] = now
            if len(now[0]) == TOP:
                self.floors[i][k] = int(now[0][-1])
        self.least[i] = min(self.floors[i])

    def rows(self) -> pa.RecordBatch:
        out = [(key, k, s, i) for key, own in zip(self.keys, self.found, strict=True) for k, (score, ids) in enumerate(own)
               for s, i in zip(score.tolist(), ids.tolist(), strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["akey", "list", "score", "id"])


def _search(refs: np.ndarray, negative: bool):
    """Pairs of a block and a tile, those of a block together, to the best rows of every list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block = (batch.column(batch.schema.get_field_index("a_cell"))[i].as_py(), batch.column(batch.schema.get_field_index("a_part"))[i].as_py())
                if block != now:
                    if lists is not None:
                        yield lists.rows()
                    lists, now = _Lists(batch, i, refs, negative), block
                lists.meet(_Side(batch, i, "t_"))
        if lists is not None:
            yield lists.rows()

    return run


class Index:
    """Tiles of all rows, and the anchors."""

    def __init__(self, embeddings: DataFrame, every: int = EVERY, relabel: Callable[[np.ndarray, np.ndarray], np.ndarray] = _shifted, tile: int = TILE, block: int = BLOCK):
        raw = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        raw = raw.where("vec_id is not null and label is not null and embedding is not null")
        self.refs = references(raw)
        self.block = block
        rows = settle(raw.mapInArrow(_prepared(self.refs, relabel), _ROW), "vectors")
        part, counts = _parts(rows, tile)
        tiles, number = F.create_map(*[F.lit(x) for c, x in zip(counts, np.cumsum([0, *counts.values()]).tolist(), strict=False) for x in (c, x)]) if counts else None, sum(counts.values())
        packed = rows.withColumn("part", part).groupBy("cell", "part").applyInArrow(_pack([], self.refs), _PACKED)
        self.groups = max(1, min(number, GROUPS))
        group = (tiles[F.col("cell")] + F.col("part")) % self.groups if counts else F.lit(0)
        self.tiles = settle(packed.withColumn("g", group.cast("int")), "tiles")
        self.anchors = settle(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vector"]).withColumn(
            "akey", F.monotonically_increasing_id()), "anchors")
        forget(rows)

    def search(self, anchors: DataFrame, negative: bool, home: bool) -> DataFrame:
        """akey, list, score, id: the best rows of each list of anchors (floors, caps: arrays with an entry per list), merged."""
        part, _ = _parts(anchors, self.block)
        extra = ["akey", "floors", "caps"]
        kind = f"{_PACKED}, akey array<bigint>, floors array<array<bigint>>, caps array<array<bigint>>, near array<double>, far array<double>, need double"
        blocks = anchors.withColumn("part", part).groupBy("cell", "part").applyInArrow(_pack(extra, self.refs), kind)
        blocks = settle(blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns]), "blocks")
        tiles = self.tiles.select(*[F.col(c).alias(f"t_{c}") for c in self.tiles.columns])
        if home:
            pairs = blocks.join(tiles.hint("merge"), F.col("a_cell") == F.col("t_cell"))
        else:
            sent = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
            gap = F.greatest(F.lit(0.0), F.col("t_low") - F.element_at("a_far", F.col("t_cell") + 1), F.element_at("a_near", F.col("t_cell") + 1) - F.col("t_high"))
            reach = F.cos(F.greatest(F.lit(0.0), gap - SLACK)) * F.col("t_norm")
            reach = F.when(reach < 0, F.lit(0.0)).otherwise(reach) * (1 + SLACK) + SLACK
            pairs = sent.join(tiles.hint("merge"), (F.col("g") == F.col("t_g")) & (F.col("a_need") <= reach))
        columns = [c for c in pairs.columns if c[:2] in ("a_", "t_") and c not in ("t_g", "a_near", "a_far", "a_need")]
        found = pairs.select(*columns).mapInArrow(_search(self.refs, negative), "akey bigint, list int, score bigint, id bigint")
        order = Window.partitionBy("akey", "list").orderBy(F.desc("score"), F.asc("id"))
        out = settle(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP), "found")
        forget(blocks)
        return out

    def floors(self, anchors: DataFrame, found: DataFrame) -> DataFrame:
        """anchors with the last score of each full list of found as the list's floor."""
        last = found.where(F.col("rank") == TOP).groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("list", "score"))).alias("reached"))  # TOP entries at most
        known = F.transform("floors", lambda x, k: F.coalesce(F.element_at("reached", k), x))
        return anchors.join(last, "akey", "left").withColumn("floors", F.when(F.col("reached").isNull(), F.col("floors")).otherwise(known)).drop("reached")


def hard_negatives(embeddings: DataFrame, **options: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (see above; options: those of Index)."""
    index = Index(embeddings, **options)
    none = F.array(F.lit(_NONE))
    anchors = index.anchors.withColumn("floors", none).withColumn("caps", none)
    near = index.search(anchors, negative=False, home=True)
    positives = index.search(index.floors(anchors, near), negative=False, home=False)
    lists = positives.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))  # TOP entries at most
    # the least whole score with 100 * score >= LEAST * positive; split, so that no product overflows
    least = F.expr(f"transform(p, x -> x.score div 100 * {LEAST} + if(x.score > 0, (x.score % 100 * {LEAST} + 99) div 100, x.score % 100 * {LEAST} div 100))")
    anchors = settle(index.anchors.join(lists, "akey").withColumn("caps", F.transform("p", lambda x: x["score"])).withColumn("floors", least), "lists")
    near = index.search(anchors.drop("p"), negative=True, home=True)
    found = index.search(index.floors(anchors.drop("p"), near), negative=True, home=False)
    return found.join(anchors.select("akey", F.col("vec_id").alias("anchor_id"), "p"), "akey").select(
        "anchor_id", F.col("p")[F.col("list")]["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p")[F.col("list")]["score"].alias("positive_score"), F.col("score").alias("negative_score"))
