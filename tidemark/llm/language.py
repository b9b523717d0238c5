"""Language identification by interpolated Kneser-Ney character models.

A text becomes lower-case letters with single spaces between words. A character is its code point below 4096, else one of
4096 hashed codes, so that four of them are one 52-bit key. All four-character runs of all training documents are
counted, in every language there is, and every key is kept; the lower orders follow from them by continuation counts. Keys
stand in sorted arrays with a column of log probabilities per language. A document takes the language of the lowest
cross-entropy per character.

The model grows with its input. Languages are taken in blocks of at most BLOCK_KEYS keys (a language with more is a block of its
own); each block is built, sent and scored by itself, and a document carries its best language from block to block.

Rejection: `rejected` marks a text whose cross-entropy lies above the given quantile of its language's training documents,
all of them.

Defined results: lang_pred is `und`, score 0, for a null text, one without a letter, and where nothing could be learned.
Equal entropies go to the first language by name. Repeated rows are judged each. A null key counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, settle, slices, utf8

ORDER, CODE_BITS, ROW_BITS = 4, 13, 12
#: Keys of a block of languages.
BLOCK_KEYS = 4_000_000
REJECT_QUANTILE = 0.999
SHARPNESS = 8.0
UNKNOWN = "und"
_CODE = (1 << CODE_BITS) - 1


def letter_table() -> np.ndarray:
    """Code point of the basic plane to code; 32 for all but letters."""
    table = np.full(1 << 16, 32, np.int64)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = _code(ord(low) if len(low) == 1 else c)
    return table


def _code(point: int) -> int:
    return point if point < 4096 else 4096 + (point * 2654435761 >> 7) % 4096


def runs_of(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row) of each run of four codes, and whether each row has a letter."""
    raw = data[at[0]:at[-1]]
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at - at[0]]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = table[np.minimum(points, (1 << 16) - 1)]
    far = np.flatnonzero(points >= 1 << 16)
    if len(far):
        kinds, place = np.unique(points[far], return_inverse=True)
        codes[far] = np.array([_code(p) if chr(p).isalpha() else 32 for p in kinds.tolist()])[place]
    rows = len(at) - 1
    size = np.diff(lead)
    # two spaces before each row and one after
    where = np.arange(len(codes)) + np.repeat(3 * np.arange(rows) + 2, size)
    line = np.full(len(codes) + 3 * rows, 32, np.int64)
    line[where] = codes
    row = np.repeat(np.arange(rows), size + 3)
    space = line == 32
    keep = np.ones(len(line), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    edge = lead[:-1] + 3 * np.arange(rows)  # the two first spaces of each row stay, whatever stands before
    keep[edge] = keep[edge + 1] = True
    line, row = line[keep], row[keep]
    letters = np.bincount(row, line != 32, rows) > 0
    n = len(line) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    key = line[:n].copy()
    for k in range(1, ORDER):
        key = key << CODE_BITS | line[k:k + n]
    own = (row[:n] == row[ORDER - 1:]) & letters[row[:n]]
    return key[own], row[:n][own], letters


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, lang) to (lang, gram, n), merged as far as memory allows."""
    table, place = letter_table(), {}
    held, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate(held), np.concatenate(many)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        names = pa.array(list(place), pa.string()).take(pa.array(keys & ((1 << ROW_BITS) - 1)))
        return pa.RecordBatch.from_arrays([names, pa.array((keys.view(np.uint64) >> np.uint64(ROW_BITS)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        data, at = utf8(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for a, b in slices(at):
            for lo in range(a, b, 1 << (ROW_BITS - 1)):
                hi = min(b, lo + (1 << (ROW_BITS - 1)))
                if len(place) + hi - lo > 1 << ROW_BITS or sum(map(len, held)) > 2_000_000:
                    keys, n = merged()
                    held, many = [keys], [n]
                    if len(place) + hi - lo > 1 << ROW_BITS or len(keys) > 1_000_000:
                        yield out(keys, n)
                        held, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                        place.clear()
                own = np.array([place.setdefault(x, len(place)) for x in langs[lo:hi]], np.int64)
                key, row, _ = runs_of(data, at[lo:hi + 1], table)
                key = np.sort((key << ROW_BITS | own[row]).view(np.uint64)).view(np.int64)
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                held.append(key[first])
                many.append(np.diff(np.append(first, len(key))))
    yield out(*merged())


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and last character of a key."""
    return key >> CODE_BITS, key & _CODE


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other) if len(keys) else np.full(len(wanted), other)


class _Level:
    """One order of one language: interpolated probability of a key from its counts and the order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: _Level | None, letters: int):
        self.keys, self.counts, self.below, self.letters = keys, counts.astype(np.float64), below, letters
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        self.discount = float(ones / max(ones + 2 * twos, 1)) or 0.5
        context, _ = _split(keys)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.totals = np.add.reduceat(self.counts, first) if len(first) else self.counts
        self.weights = self.discount * np.diff(np.append(first, len(keys))) / np.maximum(self.totals, 1)

    def prob(self, keys: np.ndarray, order: int) -> np.ndarray:
        context, _ = _split(keys)
        lower = self.below.prob(keys & ((1 << CODE_BITS * (order - 1)) - 1), order - 1) if self.below else np.full(len(keys), 1 / self.letters)
        total = _lookup(self.contexts, self.totals, context, 0.0)
        seen = np.maximum(_lookup(self.keys, self.counts, keys, 0.0) - self.discount, 0)
        weight = _lookup(self.contexts, self.weights, context, 1.0)
        return np.where(total > 0, seen / np.maximum(total, 1), 0) + weight * lower


def _model(keys: np.ndarray, counts: np.ndarray) -> list[_Level]:
    """Levels of order 1 to 4 of one language."""
    order = np.argsort(keys)
    tables = [(keys[order], counts[order])]
    for n in range(ORDER - 1, 0, -1):
        tables.insert(0, np.unique(tables[0][0] & ((1 << CODE_BITS * n) - 1), return_counts=True))
    letters = len(tables[0][0]) + 1
    levels: list[_Level] = []
    for k, c in tables:
        levels.append(_Level(k, c, levels[-1] if levels else None, letters))
    return levels


def grams(training: DataFrame) -> DataFrame:
    """lang, gram, n of all four-character runs of the rows (text, lang) that have both."""
    rows = training.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(_count_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def blocks(counted: DataFrame, most: int = BLOCK_KEYS) -> Iterator[dict]:
    """Models of all languages of the settled grams, in blocks by name."""
    sizes = counted.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    parts: list[list[str]] = []
    total = 0
    for r in sizes:
        total += r["count"]
        if not parts or total > most:
            parts.append([])
            total = r["count"]
        parts[-1].append(r["lang"])
    for names in parts:
        table = counted.where(F.col("lang").isin(names) if len(parts) > 1 else F.lit(True)).toArrow()  # a block
        lang = np.asarray(pc.index_in(table.column("lang"), pa.array(names, pa.string())).combine_chunks())
        keys, counts = (table.column(c).to_numpy() for c in ("gram", "n"))
        order = np.argsort(lang, kind="stable")
        cut = np.searchsorted(lang[order], np.arange(len(names) + 1))
        own = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield {"languages": names, **_arrays([_model(keys[k], counts[k]) for k in own])}


def _arrays(levels: list[list[_Level]]) -> dict:
    """Sorted keys of each order with a column of log probabilities a language, and the weights of contexts."""
    out: dict[str, list[np.ndarray]] = {"keys": [], "logs": [], "contexts": [], "weights": []}
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([m[n - 1].keys for m in levels]))
        out["keys"].append(keys)
        out["logs"].append(np.stack([np.log2(m[n - 1].prob(keys, n)) for m in levels], axis=1).astype(np.float32))
        contexts = np.unique(np.concatenate([m[n - 1].contexts for m in levels]))
        out["contexts"].append(contexts)
        out["weights"].append(np.stack([np.log2(_lookup(m[n - 1].contexts, m[n - 1].weights, contexts, 1.0)) for m in levels], axis=1).astype(np.float32))
    out["floor"] = np.array([-np.log2(m[0].letters) for m in levels], np.float32)
    return out


def log_probs(model: dict, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
    """Rows of log2 probabilities, a column for each language; unseen keys go down one order."""
    if n == 0:
        return np.broadcast_to(model["floor"], (len(keys), len(model["floor"]))).copy()
    known, logs = model["keys"][n - 1], model["logs"][n - 1]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    out = logs[at]
    lost = np.flatnonzero(known[at] != keys)
    if len(lost):
        lower = log_probs(model, keys[lost] & ((1 << CODE_BITS * (n - 1)) - 1), n - 1)
        context = keys[lost] >> CODE_BITS
        contexts = model["contexts"][n - 1]
        c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        out[lost] = lower + np.where((contexts[c] == context)[:, None], model["weights"][n - 1][c], 0)
    return out


def entropies(model: dict, data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character (rows, languages), and whether each row has a letter."""
    width = len(model["languages"])
    parts, letters = [np.zeros((0, width))], [np.zeros(0, bool)]
    for a, b in slices(at):
        for lo in range(a, b, 1 << ROW_BITS):
            hi = min(b, lo + (1 << ROW_BITS))
            key, row, some = runs_of(data, at[lo:hi + 1], table)
            order = np.sort((key << ROW_BITS | row).view(np.uint64)).view(np.int64)
            key, row = order >> ROW_BITS & ((1 << CODE_BITS * ORDER) - 1), order & ((1 << ROW_BITS) - 1)
            new = np.append(True, key[1:] != key[:-1])[:len(key)]
            logs = log_probs(model, key[new])[np.cumsum(new) - 1]
            n = np.maximum(np.bincount(row, minlength=hi - lo), 1)
            parts.append(np.stack([-np.bincount(row, logs[:, k], hi - lo) / n for k in range(width)], axis=1))
            letters.append(some)
    return np.concatenate(parts), np.concatenate(letters)


_STATE = "doc_id bigint, held_out boolean, lang string, text string, lang_pred string, bits double, share double, own double"


def _scored(shared):
    """One block of languages: each row's best language so far, its entropy, the sum of all languages' weights over the best one's, and
    the entropy in the row's own language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = letter_table(), shared.value
        names = np.array(model["languages"], object)
        place = {name: i for i, name in enumerate(model["languages"])}
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            data, at = utf8(get("text"))
            bits, some = entropies(model, data, at, table)
            had, least = get("bits").to_numpy(), bits.min(1)
            before = np.where(np.isfinite(had), np.exp2(SHARPNESS * (np.minimum(had, least) - had)) * get("share").to_numpy(), 0.0)
            now = np.exp2(SHARPNESS * (np.minimum(had, least)[:, None] - bits)).sum(1)
            better = some & (least < had)
            lang = np.array([place.get(x, -1) for x in get("lang").to_pylist()], np.int64)
            mine = np.where(some & (lang >= 0), bits[np.arange(len(bits)), np.maximum(lang, 0)], get("own").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.where(better, names[bits.argmin(1)], np.array(get("lang_pred").to_pylist(), object)), pa.string()),
                 pa.array(np.where(some, np.minimum(had, least), had)), pa.array(np.where(some, before + now, 0.0)), pa.array(mine)], batch.schema.names)

    return run


def identify(docs: DataFrame, most: int = BLOCK_KEYS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected of every row; learned from rows that are not held out."""
    spark = docs.sparkSession
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")), F.lit(0)) % 5
    counted = settle(grams(docs.where(rest != 0).select("text", "lang")), "grams")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (rest == 0).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("share"), F.lit(float("inf")).alias("own"))
    for model in blocks(counted, most):
        rows = rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), _STATE)
    scored = settle(rows.drop("text"), "scored")
    forget(counted)
    known = (~F.col("held_out")) & F.col("lang").isNotNull() & (F.col("own") < float("inf"))
    limits = scored.where(known).groupBy(F.col("lang").alias("lang_pred")).agg(F.percentile_approx("own", REJECT_QUANTILE).alias("most"))
    out = scored.join(F.broadcast(limits), "lang_pred", "left")  # one row per language of the models sent before
    score = F.when(F.col("share") > 0, 1 / F.col("share")).otherwise(F.lit(0.0))
    return out.select("doc_id", "held_out", "lang_pred", score.alias("score"), F.when(F.col("bits") < float("inf"), F.col("bits")).otherwise(0.0).alias("bits"),
                      F.coalesce((F.col("bits") < float("inf")) & (F.col("bits") > F.col("most")), F.lit(False)).alias("rejected"))
