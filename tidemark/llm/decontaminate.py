"""Benchmark decontamination: rare seeds find the passages of documents that may hold a test item, and a Smith-Waterman
alignment of words scores each passage.

An alignment that reaches the threshold matches at least a known number of the item's words (each match earns MATCH, nothing else
earns), in a passage of bounded length (each further word costs). Seeds are all words of an item but the third that is
commonest among the items; so at least NEED of an item's seeds, all matches but those that the left-out third can account
for, must stand within such a length. Every such stretch is a candidate, none is missed, whatever the edits and however many
copies there are. A candidate scores its best local alignment over that of the item with itself. In items of fewer than SHORT words a few common words would be half of the
item; they need a run of three words (all words, if they have fewer) as their seed.

The items travel with the job. Their bytes are counted first: beyond BLOCK_BYTES they are taken in as many blocks as
needed, one pass over the documents each, so nothing grows without bound and no item is left out.

Defined results: null and empty texts, of documents or items, match nothing. Repeated items are found each under its id;
repeated documents each give a row. A document that holds an item several times gives one row, with the best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, found, free_name, keyed_text, slices, utf8, with_column

#: Items of fewer than SHORT words are sought by runs of SEED_WORDS words.
SEED_WORDS, SHORT = 3, 8
LEAK = 0.5
MATCH, OTHER, GAP = 2, -1, -1
BLOCK_BYTES = 32 << 20
#: Table cells of the pairs that are aligned together.
_CELLS = 1 << 15


class Items:
    """Test items as token hashes, with a sorted table of their seeds: the key of a seed and its item, each pair once."""

    def __init__(self, ids: list, texts: list, threshold: float = LEAK):
        self.ids, self.threshold = ids, threshold
        data, at = utf8(pa.array(texts, pa.string()))
        words = Words(data, at)
        cut = words.first
        self.tokens = [words.hash[cut[i]:cut[i + 1]] for i in range(len(ids))]
        known, times = np.unique(words.hash, return_counts=True)
        pairs = [np.zeros((2, 0), np.uint64)]
        self.missing = np.zeros(len(ids), np.int64)  # words of each item that are no seeds
        for i, own in enumerate(self.tokens):
            if len(own) >= SHORT:
                out = min(len(own) // 3, _least(len(own), threshold) - 1)  # an alignment can't match these alone
                rare = np.argsort(times[np.searchsorted(known, own)], kind="stable")[:len(own) - out]
                seeds = np.unique(own[rare])
                self.missing[i] = len(own) - np.isin(own, seeds).sum()
                pairs.append(np.stack([seeds, np.full(len(seeds), i, np.uint64)]))
        self.keys, self.items = self._sorted(pairs)
        self.sizes, self.runs = [], []
        for n in range(1, SEED_WORDS + 1):
            hashes, first = words.grams(n)
            item = words.row[first]
            size = (cut[1:] - cut[:-1])[item]
            fit = (size < SHORT) & ((size == n) if n < SEED_WORDS else (size >= n))
            if fit.any():
                self.sizes.append(n)
                self.runs.append(self._sorted([np.unique(np.stack([hashes[fit], item[fit].astype(np.uint64)]), axis=1)]))

    @staticmethod
    def _sorted(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, items = np.concatenate(pairs, axis=1)
        order = np.lexsort((items, keys))
        return keys[order], items[order].astype(np.int64)

    def plain(self) -> tuple:
        """For a broadcast: classes of this package can't travel in one."""
        return self.ids, self.threshold, self.tokens, self.missing, self.keys, self.items, self.sizes, self.runs

    @classmethod
    def of(cls, plain: tuple) -> Items:
        self = cls.__new__(cls)
        self.ids, self.threshold, self.tokens, self.missing, self.keys, self.items, self.sizes, self.runs = plain
        return self

    def stretches(self, words: Words) -> tuple[np.ndarray, ...]:
        """(row, item, first token, end) of all places, in order, that can hold an alignment at the threshold."""
        size = np.array([len(t) for t in self.tokens], np.int64)
        least = np.array([_least(n, self.threshold) for n in size.tolist()], np.int64)
        extra = np.floor(MATCH * size * (1 - self.threshold) / -max(OTHER, GAP) + 1e-9).astype(np.int64)  # other words it can afford
        reach = size + extra
        item, token = _met(self.keys, self.items, words.hash, np.arange(len(words)))
        need = np.maximum(least - self.missing, 1)
        order = np.lexsort((token, item))
        item, token = item[order], token[order]
        last = np.arange(len(item)) + need[item] - 1
        good = last < len(item)
        last = np.minimum(last, max(len(item) - 1, 0))
        good &= (item[last] == item) & (words.row[token[last]] == words.row[token]) & (token[last] - token < reach[item]) if len(item) else good
        parts = [(item[good], token[good], token[last[good]])]
        for n, (keys, items) in zip(self.sizes, self.runs, strict=True):
            hashes, first = words.grams(n)
            own, at = _met(keys, items, hashes, first)
            parts.append((own, at, at + n - 1))
        item, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        row = words.row[first]
        low = np.maximum(words.first[row], last - reach[item] + 1)
        high = np.minimum(words.first[row + 1], first + reach[item])
        order = np.lexsort((low, item, row))
        row, item, low, high = row[order], item[order], low[order], high[order]
        # both ends rise with the place, so stretches of an item that overlap become one
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
        begin = np.flatnonzero(new)
        return row[begin], item[begin], low[begin], high[np.append(begin[1:], len(row)) - 1] if len(row) else high


def _least(size: int, threshold: float) -> int:
    """Words that match in any alignment of an item of so many words at the threshold."""
    return max(1, int(np.ceil(threshold * size - 1e-9)))


def _met(keys: np.ndarray, items: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) for every hash that is a key; a key of several items counts once for each."""
    where, there = found(keys, hashes)
    where, places, hashes = where[there], places[there], hashes[there]
    many = np.searchsorted(keys, hashes, "right") - where
    each = np.repeat(where, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return items[each], np.repeat(places, many)


def alignment(item: np.ndarray, passage: np.ndarray) -> float:
    """Smith-Waterman score over the item's score with itself."""
    return float(alignments([item], [passage])[0])


def alignments(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The alignment of each item with its passage; pairs of similar length go through the rows of their tables together."""
    out = np.zeros(len(items))
    length, size = (np.array([len(t) for t in own], np.int64) for own in (passages, items))
    order = np.lexsort((size, length))
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * (length[order[last]] + 1) <= _CELLS:
            last += 1
        some = order[first:last]
        out[some] = _together([items[k] for k in some], [passages[k] for k in some])
        first = last
    return out


def _together(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    wide, tall = max(map(len, passages)), max(map(len, items))
    text, words = np.zeros((len(items), wide), np.uint64), np.zeros((len(items), tall), np.uint64)
    inside, real = np.zeros(text.shape, bool), np.zeros(words.shape, bool)
    for k, (item, passage) in enumerate(zip(items, passages, strict=True)):
        words[k, :len(item)], real[k, :len(item)] = item, True
        text[k, :len(passage)], inside[k, :len(passage)] = passage, True
    ramp = (np.arange(wide + 1) * -GAP).astype(np.int32)
    row, best = np.zeros((len(items), wide + 1), np.int32), np.zeros(len(items), np.int32)
    for j in range(tall):
        step = np.where((text == words[:, j, None]) & inside & real[:, j, None], np.int32(MATCH), np.int32(OTHER))
        new = np.maximum(row + GAP, 0)
        np.maximum(new[:, 1:], row[:, :-1] + step, out=new[:, 1:])
        new += ramp
        np.maximum.accumulate(new, axis=1, out=new)
        row = new - ramp
        np.maximum(best, row.max(1), out=best)
    return best / (MATCH * np.maximum([len(i) for i in items], 1))


def passages(items: Items, words: Words) -> list[tuple[int, int, float]]:
    """(row, item, best score) of every row and item with an alignment of at least the threshold."""
    if not len(words):
        return []
    row, item, low, high = items.stretches(words)
    threshold = items.threshold
    score = alignments([items.tokens[i] for i in item.tolist()], [words.hash[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    out: dict[tuple[int, int], float] = {}
    for r, i, got in zip(row.tolist(), item.tolist(), score.tolist(), strict=True):
        if got >= threshold:
            out[r, i] = max(out.get((r, i), 0.0), got)
    return [(r, i, s) for (r, i), s in out.items()]


def _blocks(spark: SparkSession, benchmark: DataFrame, threshold: float, most: int) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // most))
    for part in range(parts):
        block = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        got = block.orderBy("item_id", "text").collect()  # about `most` bytes
        if got:
            yield Items([r["item_id"] for r in got], [r["text"] for r in got], threshold)


def _prepared(docs: DataFrame, benchmark: DataFrame, threshold: float, most: int) -> Iterator:
    """Each block of items as a broadcast."""
    for items in _blocks(docs.sparkSession, benchmark, threshold, most):
        yield docs.sparkSession.sparkContext.broadcast(items.plain())


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = LEAK, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score of every document and item with an alignment of at least the threshold."""
    out = []
    for shared in _prepared(docs, benchmark, threshold, most):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items.of(shared.value)
            for batch in batches:
                data, at = utf8(batch.column("text"))
                got = [(a + r, i, s) for a, b in slices(at) for r, i, s in passages(items, Words(data, at[a:b + 1]))]
                doc = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array([items.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["doc_id", "item_id", "score"])

        out.append(keyed_text(docs).mapInArrow(run, "doc_id bigint, item_id bigint, score double"))
    if not out:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double")
    return reduce(DataFrame.unionByName, out)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = LEAK, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows that hold no test item, with their own columns."""
    for shared in _prepared(docs, benchmark, threshold, most):

        def run(column: pa.Array, shared=shared) -> pa.Array:
            data, at = utf8(column)
            clean = np.ones(len(at) - 1, bool)
            for a, b in slices(at):
                for r, _, _ in passages(Items.of(shared.value), Words(data, at[a:b + 1])):
                    clean[a + r] = False
            return pa.array(clean)

        mark = free_name(docs, "clean")
        docs = with_column(docs, mark, "boolean", run).where(F.col(mark)).drop(mark)
    return docs
