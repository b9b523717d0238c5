"""Removal of repeated byte strings: every 200-byte string that starts at two places of the corpus goes at each of them.

Of all suffixes only those can matter whose string shares an anchor with another: the anchor of a string is its 32-byte
run of least hash (the leftmost of equals), so equal strings have equal anchors at the same place. Anchors are counted
over the corpus; those that stand at one place only drop out with all their strings. The others bring their strings'
bytes. Spark samples splitters and range-partitions them by their leading bytes; equal anchors never fall apart, so no
comparison crosses a boundary. A bucket sorts its suffixes by a key of all 200 bytes and compares neighbours.

Differences from the named method: a bucket's local sort takes a 64-bit hash of the 200 bytes as its key, in place of
multikey quicksort over the bytes; it decides equality only, which is all that is asked. An anchor at more than MOST
places is not sorted in one task: its strings are counted by a shuffle on two 64-bit hashes, with partial counts first.

Defined results: a null text is empty. Texts are grouped by a 64-bit hash first; a text of 200 bytes or more that stands in
several rows goes whole, in each of them. Shorter texts never lose a byte. Null keys stay null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import mixed, powers, prefix_hash, settle, slices, span_hash, utf8

LENGTH, ANCHOR = 200, 32
#: Places of one anchor that a task may sort together (some 20 MB), and bytes of strings it holds at once otherwise.
MOST, CHUNK = 65_536, 2 << 20
_PLACE_BITS = 22


def anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place, first string, last string) of each anchor; places within the slice. An anchor owns a run of
    strings: those whose least run it is."""
    size, reach = len(raw), LENGTH - ANCHOR + 1
    empty = np.zeros(0, np.int64)
    if size < LENGTH:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    prefix = prefix_hash(raw)
    runs = mixed((prefix[ANCHOR:] - prefix[:-ANCHOR]) * powers(len(prefix))[1][:size - ANCHOR + 1])
    bits = np.uint64(max(_PLACE_BITS, int(size).bit_length()))
    least = runs >> bits << bits | np.arange(len(runs), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    rest = reach - width
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    starts = np.arange(len(least))
    row = np.searchsorted(bounds, starts, "right") - 1
    fits = np.flatnonzero(starts + LENGTH <= bounds[row + 1])
    row, place = row[fits], (least[fits] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(fits), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(fits)) - 1
    return runs[place[first]], row[first], place[first], fits[first], fits[last[:len(first)]]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        key = batch.column("th").to_numpy(zero_copy_only=False)
        for a, b in slices(at):
            h, row, place, _, _ = anchors(data[at[a]:at[b]], at[a:b + 1] - at[a])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(key[a:b][row]), pa.array(place - (at[a:b] - at[a])[row])], ["h", "th", "p"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are about to be shuffled."""
    packer = zstandard.ZstdCompressor(3)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([packer.compress(t) for t in texts], pa.binary())], ["doc_id", "th", "z"])


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each marked anchor with the bytes of the strings it owns."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [unpacker.decompress(z) for z in batch.column("z").to_pylist()]
        keys, marks = batch.column("th").to_pylist(), batch.column("marks").to_pylist()
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for a, b in slices(at):
            raw = np.frombuffer(b"".join(texts[a:b]), np.uint8)
            bounds = at[a:b + 1] - at[a]
            h, row, place, first, last = anchors(raw, bounds)
            wanted = np.array([bounds[i - a] + m["p"] for i in range(a, b) for m in marks[i]], np.int64)
            many = np.array([m["n"] for i in range(a, b) for m in marks[i]], np.int64)
            order = np.argsort(wanted)
            wanted, many = wanted[order], many[order]
            at_wanted = np.minimum(np.searchsorted(wanted, place), max(len(wanted) - 1, 0))
            keep = np.flatnonzero(wanted[at_wanted] == place) if len(wanted) else np.zeros(0, np.int64)
            view = raw.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([view[p:p + 8] for p in place[keep].tolist()], pa.binary()), pa.array(h[keep].view(np.int64)), pa.array(many[at_wanted[keep]]),
                pa.array([keys[a + r] for r in row[keep].tolist()], pa.int64()), pa.array(first[keep] - bounds[row[keep]]), pa.array(place[keep] - first[keep]),
                pa.array([view[x:y + LENGTH] for x, y in zip(first[keep].tolist(), last[keep].tolist(), strict=True)], pa.binary())],
                ["lead", "h", "n", "th", "start", "off", "bytes"])


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position in the joined texts, text, place in the text) of every string of the texts."""
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    many = size - LENGTH + 1
    text = np.repeat(np.arange(len(texts)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    where = place + np.repeat(np.cumsum(size) - size, many)
    return span_hash(prefix_hash(raw), where, where + LENGTH), where, text, place


def _repeated(rows: list[tuple]) -> pa.RecordBatch:
    """Spans of the strings that stand twice among the rows (th, start, offset of the anchor, bytes).

    Equal strings lie alike about their anchor, so each distance from it is sorted by itself.
    """
    size = np.array([len(r[3]) for r in rows], np.int64)
    prefix = prefix_hash(np.frombuffer(b"".join([r[3] for r in rows]), np.uint8))
    base, many, anchor = np.cumsum(size) - size, size - LENGTH + 1, np.array([r[2] for r in rows], np.int64)
    texts, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for away in range(int(anchor.max()) + 1):
        place = anchor - away
        own = np.flatnonzero((place >= 0) & (place < many))
        where = base[own] + place[own]
        keys = span_hash(prefix, where, where + LENGTH)
        order = np.argsort(keys)
        equal = keys[order[1:]] == keys[order[:-1]]
        twice = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
        texts.append(own[twice])
        places.append(place[own[twice]])
    text, place = np.concatenate(texts), np.concatenate(places)
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text))[:len(first)] - 1
    th, start = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    begin = start[text[first]]
    return pa.RecordBatch.from_arrays([pa.array(th[text[first]]), pa.array(begin + place[first]), pa.array(begin + place[last] + LENGTH)], ["th", "a", "b"])


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are gathered up to a chunk and worked through."""
    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for h, th, start, off, data in zip(*(batch.column(c).to_pylist() for c in ("h", "th", "start", "off", "bytes")), strict=True):
            if size > CHUNK and h != last:
                yield _repeated(held)
                held, size = [], 0
            held.append((th, start, off, data))
            size, last = size + len(data), h
    if held:
        yield _repeated(held)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a common anchor as two hashes and its place."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts, th, start = (part.column(c).to_pylist() for c in ("bytes", "th", "start"))
            one, _, text, place = _windows(texts)
            two, _, _, _ = _windows([t[::-1] for t in texts])
            many = np.array([len(t) - LENGTH + 1 for t in texts])
            mirror = np.repeat(np.cumsum(many), many) - 1 - place  # the same string in the reversed text
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two[mirror].view(np.int64)), pa.array(np.array(th, np.int64)[text]), pa.array(np.array(start, np.int64)[text] + place)],
                ["w1", "w2", "th", "a"])


def _strip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for z, n_rows, spans in zip(*(batch.column(c).to_pylist() for c in ("z", "n_rows", "spans")), strict=True):
            text = unpacker.decompress(z)
            if n_rows > 1 and len(text) >= LENGTH:
                spans = [{"a": 0, "b": len(text)}]
            kept, removed, count, at = [], 0, 0, 0
            run = None
            for a, b in sorted((s["a"], s["b"]) for s in spans or []):
                if run and a <= run[1]:
                    run[1] = max(run[1], b)
                    continue
                if run:
                    kept.append(text[at:run[0]])
                    removed, count, at = removed + run[1] - run[0], count + 1, run[1]
                run = [a, b]
            if run:
                kept.append(text[at:run[0]])
                removed, count, at = removed + run[1] - run[0], count + 1, run[1]
            kept.append(text[at:])
            out.append((len(text), removed, count, hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    found = rows.select("th", "text").mapInArrow(_anchor_batches, "h bigint, th bigint, p bigint")
    at = F.xxhash64("th", "p")
    shared = found.groupBy("h").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n")
    marks = found.join(shared, "h").groupBy("th").agg(F.collect_set(F.struct("p", "n")).alias("marks"))
    texts = rows.groupBy("th").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))
    packed = rows.mapInArrow(_packed, "doc_id bigint, th bigint, z binary")
    marked = marks.join(texts, "th").select(F.col("th").alias("mark_th"), "first_id", "marks")
    once = packed.join(marked, (F.col("th") == F.col("mark_th")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    strings = settle(once.select("th", "z", "marks").mapInArrow(_string_batches, "lead binary, h bigint, n bigint, th bigint, start bigint, off bigint, bytes binary"), "strings")
    few = strings.where(F.col("n") <= most)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = few.repartitionByRange(parts, "lead", "h").sortWithinPartitions("lead", "h").select("h", "th", "start", "off", "bytes")
    spans = buckets.mapInArrow(_bucket_batches, "th bigint, a bigint, b bigint")
    many = strings.where(F.col("n") > most).select("th", "start", "bytes").mapInArrow(_window_batches, "w1 bigint, w2 bigint, th bigint, a bigint")
    twice = many.groupBy("w1", "w2").agg(F.min(F.xxhash64("th", "a")).alias("lo"), F.max(F.xxhash64("th", "a")).alias("hi")).where("lo <> hi")
    spans = spans.unionByName(many.join(twice.select("w1", "w2"), ["w1", "w2"]).select("th", "a", (F.col("a") + LENGTH).alias("b")))
    by_text = spans.groupBy("th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    told = texts.join(by_text, "th", "left").select("th", "n_rows", "spans")
    return packed.join(told, "th").select("doc_id", "z", "n_rows", "spans").mapInArrow(_strip_batches, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
