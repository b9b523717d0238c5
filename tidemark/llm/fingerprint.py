"""Context-triggered piecewise hashing of documents and of their edited texts.

A hash of the last seven bytes ends a chunk where its upper k bits are zero; each chunk gives one of 64 signs, and the
signs are the signature. A text takes the least k that leaves at most 64 chunks, and adds the signature of k + 1. Two
fingerprints are compared by edit distance (Myers, one 64-bit word) where their block sizes 2**k meet: the same, double or
half.

A document's neighbour is the next one by key. Splitters that are keys themselves cut the keys into ranges; the first
document of each range goes to the range before as well (that of the first range to the last), so every range can be
worked through alone, in order, holding one batch at a time.

Defined results: a null text is empty; an empty text has an empty signature, and two empty ones are alike by 1. Null keys
come first; rows of one key are ordered by a hash of the text. A single row is its own neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import keyed_text, powers, prefix_hash, slices, span_hash, utf8

REACH, LEAST_BITS, SIGNS = 7, 2, 64
RANGE_BYTES = 24 << 20
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


class Prints:
    """Fingerprints of many texts: bits k, and two signatures as codes with their lengths."""

    def __init__(self, bits: np.ndarray, codes: list[np.ndarray], sizes: list[np.ndarray]):
        self.bits, self.codes, self.sizes = bits, codes, sizes

    @classmethod
    def of(cls, texts: list[bytes]) -> Prints:
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        parts = [cls._slice(data[at[a]:at[b]], at[a:b + 1] - at[a]) for a, b in slices(at)]
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return cls(join([p.bits for p in parts]), [np.concatenate([p.codes[k] for p in parts]) if parts else np.zeros((0, SIGNS), np.uint8) for k in (0, 1)],
                   [join([p.sizes[k] for p in parts]) for k in (0, 1)])

    @classmethod
    def _slice(cls, raw: np.ndarray, bounds: np.ndarray) -> Prints:
        rows = len(bounds) - 1
        prefix = prefix_hash(raw)
        rolled = (prefix[REACH:] - prefix[:-REACH]) * powers(len(raw) + 1)[1][:max(len(raw) + 1 - REACH, 0)]
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9)
        hit = np.flatnonzero(rolled < np.uint64(1 << (64 - LEAST_BITS)))
        value, end = rolled[hit], hit + REACH  # a chunk ends before byte `end` of the slice
        row = np.searchsorted(bounds, end - 1, "right") - 1
        own = (end - REACH >= bounds[row]) & (end < bounds[row + 1])  # the text's end closes the last chunk by itself
        value, end, row = value[own], end[own], row[own]
        bits = np.full(rows, -1)
        for k in range(LEAST_BITS, 62):
            keep = value < np.uint64(1 << (64 - k))
            fits = np.bincount(row[keep], minlength=rows) < SIGNS
            bits[(bits < 0) & fits] = k
            if (bits >= 0).all():
                break
        bits[bits < 0] = 61
        made = [cls._signature(prefix, bounds, end, row, value, bits + more) for more in (0, 1)]
        return cls(bits, [m[0] for m in made], [m[1] for m in made])

    @staticmethod
    def _signature(prefix, bounds, end, row, value, bits) -> tuple[np.ndarray, np.ndarray]:
        rows = len(bounds) - 1
        keep = value < (np.uint64(1) << (64 - bits[row]).astype(np.uint64))
        end, row = end[keep], row[keep]
        full = np.flatnonzero(bounds[:-1] < bounds[1:])
        ends, owner = np.concatenate([end, bounds[1:][full]]), np.concatenate([row, full])
        order = np.lexsort((ends, owner))
        ends, owner = ends[order], owner[order]
        first = np.searchsorted(owner, np.arange(rows + 1))
        place = np.arange(len(owner)) - first[owner]
        count = np.diff(first)
        kept = (place < SIGNS - 1) | (place == count[owner] - 1)  # beyond 64 chunks the last takes the rest
        ends, owner, place = ends[kept], owner[kept], np.minimum(place[kept], SIGNS - 1)
        start = np.where(place == 0, bounds[owner], np.roll(ends, 1))
        codes = np.zeros((rows, SIGNS), np.uint8)
        codes[owner, place] = (span_hash(prefix, start, ends) >> np.uint64(58)).astype(np.uint8)
        return codes, np.minimum(count, SIGNS)

    def take(self, rows: np.ndarray) -> Prints:
        return Prints(self.bits[rows], [c[rows] for c in self.codes], [s[rows] for s in self.sizes])

    def strings(self) -> list[str]:
        return [f"{1 << int(k)}:{_ALPHABET[a[:m]].tobytes().decode()}:{_ALPHABET[b[:n]].tobytes().decode()}" for k, a, m, b, n in zip(
            self.bits, self.codes[0], self.sizes[0], self.codes[1], self.sizes[1], strict=True)]


def distance(p: np.ndarray, np_: np.ndarray, t: np.ndarray, nt: np.ndarray) -> np.ndarray:
    """Edit distance of many pairs of code rows of at most 64 codes."""
    rows, one = np.arange(len(p)), np.uint64(1)
    spots = np.zeros((len(p), SIGNS), np.uint64)
    for i in range(int(np_.max(initial=0))):
        spots[rows, p[:, i]] |= np.where(i < np_, one << np.uint64(i), np.uint64(0))
    up, down, score = np.full(len(p), ~np.uint64(0)), np.zeros(len(p), np.uint64), np_.astype(np.int64).copy()
    top = one << np.maximum(np_ - 1, 0).astype(np.uint64)
    for j in range(int(nt.max(initial=0))):
        live = j < nt
        same = spots[rows, t[:, j]]
        xv = same | down
        xh = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(xh | up), up & xh
        score += live & ((plus & top) != 0)
        score -= live & ((minus & top) != 0)
        plus = (plus << one) | one
        up, down = (minus << one) | ~(xv | plus), plus & xv
    return np.where(np_ == 0, nt, score)


def likeness(x: Prints, y: Prints) -> np.ndarray:
    """1 less edit distance by length, the best over compatible block sizes; 0 if there is none."""
    best = np.zeros(len(x.bits))
    for a, b, fit in ((0, 0, x.bits == y.bits), (1, 1, x.bits == y.bits), (0, 1, x.bits == y.bits + 1), (1, 0, x.bits + 1 == y.bits)):
        at = np.flatnonzero(fit)
        m, n = x.sizes[a][at], y.sizes[b][at]
        away = distance(x.codes[a][at], m, y.codes[b][at], n) / np.maximum(np.maximum(m, n), 1)
        best[at] = np.maximum(best[at], 1 - away)
    return best


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) gives way to as many first ones of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # the last row so far
    for batch in batches:
        rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True))
        held = rows[-1:]
        got = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        for k in range(0, len(got), 1000):
            part = got[k:k + 1000]
            here = sorted({*part, *(i + 1 for i in part)})
            whole = Prints.of([(rows[i][3] or "").encode() for i in here])
            place = {i: n for n, i in enumerate(here)}
            own, after = whole.take(np.array([place[i] for i in part])), whole.take(np.array([place[i + 1] for i in part]))
            changed = [edited(rows[i][3] or "", rows[i + 1][3] or "").encode() for i in part]
            other = Prints.of(changed)
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[i][2] for i in part], pa.int64()), pa.array([len(rows[i][3] or "") for i in part], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array(own.strings()), pa.array(other.strings()),
                pa.array(likeness(own, other)), pa.array(likeness(own, after))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: fingerprints of it and of its edited text, and how alike they and the next one's are."""
    lowest = -(1 << 63)
    rows = keyed_text(docs).withColumn("k", F.coalesce("doc_id", F.lit(lowest)))
    size, least = rows.agg(F.sum(F.octet_length("text")), F.min("k")).first()
    ranges = max(1, -(-(size or 0) // range_bytes))
    cuts = rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    splitters = np.unique(np.array([*([least] if least is not None else [lowest]), *(cuts if ranges > 1 else [])], np.int64))
    n = len(splitters)

    @F.pandas_udf("bucket int, head boolean")
    def placed(k: pd.Series) -> pd.DataFrame:
        at = np.maximum(np.searchsorted(splitters, k.to_numpy(), "right") - 1, 0)
        return pd.DataFrame({"bucket": at.astype(np.int32), "head": splitters[at] == k.to_numpy()})

    own = lambda bucket, tail: F.struct(bucket.cast("int").alias("bucket"), F.lit(tail).alias("tail"))
    at = F.col("at")
    sides = F.when(at["head"], F.array(own(at["bucket"], 0), own(F.pmod(at["bucket"] - 1, F.lit(n)), 1))).otherwise(F.array(own(at["bucket"], 0)))
    spread = rows.withColumn("at", placed("k")).select("doc_id", "text", "k", F.xxhash64("text").alias("h"), F.explode(sides).alias("to"))
    spread = spread.select("to.bucket", "to.tail", "doc_id", "text", "k", "h")
    ordered = spread.repartitionById(max(n, 1), F.col("bucket")).sortWithinPartitions("bucket", "tail", "k", "h")
    return ordered.select("bucket", "tail", "doc_id", "text").mapInArrow(_run, _SCHEMA)
