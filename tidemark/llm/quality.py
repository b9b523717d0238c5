"""Quality classifier: overlapping heuristic labellers vote, expectation-maximisation estimates how far each can be
trusted, and the posterior labels train a hashed linear scorer.

Defined results: a null or empty text, or one of white space only, has no tokens and is rejected with score 0. Ties,
repeated rows and null keys are scored like any other row. An empty table gives an empty result; if no row of the sample
has tokens, the posterior of its votes is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SOLID, Words, free_name, keyed_text, mixed, sample_texts, slices, utf8, with_column

LABELLERS = ("caps", "exclaiming", "symbols", "marked_tokens", "echo", "variety", "letters", "sentences", "clean_prose", "length")
#: Rows that train the scorer, at most twice as many; counts behind the labellers' accuracies cover all rows.
SAMPLE_ROWS = 4000
SHAPES, ECHOES, WORDS = 4096, 16, 16384
KEEP = 0.5
#: Words weigh less than shapes: the sample may be full of copies whose words say nothing about quality.
WORD_SCALE = 0.1

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(b"#$%&*|!<>{}@^~\\_=+", np.uint8)] = 1
_UPPER, _LETTER, _DIGIT, _EXCLAIM = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1
_DIGIT[48:58] = 1
_EXCLAIM[33] = 1


def _sums(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=out[1:])
    return out


def _band(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 no opinion. Kinds of junk exclude one another, so most labellers only ever say bad."""
    return np.where(bad, 0, np.where(good, 1, 2)).astype(np.int64)


def _bounds_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return words.bounds[:-1], words.bounds[1:]


def votes(words: Words) -> np.ndarray:
    """One vote of each labeller for each row, as digits of a number in base 3."""
    lo, hi = _bounds_of(words)
    rows = len(lo)
    per = lambda sums: sums[hi] - sums[lo]
    size = np.maximum(hi - lo, 1)
    n = np.bincount(words.row, minlength=rows)
    some = np.maximum(n, 1)
    upper, letters, symbols = (per(_sums(t, words.raw)) for t in (_UPPER, _LETTER, _SYMBOL))
    same = np.zeros(len(words), np.int64)
    if len(words) > 1:
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    echo = np.bincount(words.row, same, rows) / some
    order = np.sort(mixed(words.hash ^ mixed(words.row.astype(np.uint64))) & np.uint64(~0xFFFFFF & (2**64 - 1)) | (words.row % (1 << 24)).astype(np.uint64))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    distinct = np.bincount((order[new] & np.uint64(0xFFFFFF)).astype(np.int64), minlength=rows) / some
    stop = np.isin(words.raw[words.end - 1], np.frombuffer(b".?;:", np.uint8)) if len(words) else np.zeros(0, bool)
    stops = np.bincount(words.row, stop, rows) / some
    length = np.bincount(words.row, words.end - words.start, rows) / some
    caps, marks, alpha = upper / np.maximum(letters, 1), symbols / size, letters / size
    expected = np.minimum(1.0, 12 / np.sqrt(some))  # running prose repeats its function words
    shout = per(_sums(_EXCLAIM, words.raw)) / some
    ended = np.bincount(words.row, _SYMBOL[words.raw[words.end - 1]], rows) / some if len(words) else np.zeros(rows)
    never = np.zeros(rows, bool)
    ballots = [
        _band(never, caps > 0.35), _band(never, shout > 0.25), _band(never, marks > 0.04), _band(never, ended > 0.25),
        _band(never, echo > 0.1), _band(never, (distinct < 0.3 * expected) & (n >= 20)), _band(never, alpha < 0.62),
        _band((stops > 0.015) & (stops < 0.6), (stops <= 0.002) & (n >= 60)),
        _band((marks < 0.01) & (caps < 0.12) & (echo < 0.05) & (length > 2) & (length < 12), never), _band(n >= 40, n < 2)]
    code = np.zeros(rows, np.int64)
    for ballot in ballots:
        code = code * 3 + ballot
    return np.where(n == 0, -1, code)


def features(words: Words) -> list[np.ndarray]:
    """Three hashed features of each token: its shape, whether it repeats, and the word."""
    if not len(words):
        return [np.zeros(0, np.int64)] * 3
    upper, digits = _sums(_UPPER, words.raw), _sums(_DIGIT, words.raw)
    big = upper[words.end] - upper[words.start]
    size = words.end - words.start
    case = np.where((big > 1) & (big * 2 >= size), 2, np.minimum(big, 1))
    tail = words.raw[words.end - 1]
    tail = np.where(_SYMBOL[tail] > 0, tail, 0).astype(np.int64)
    code = ((case * 2 + (digits[words.end] > digits[words.start])) * 256 + tail) * 8 + np.minimum(size, 20) // 3
    shape = (mixed(code.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
    back = np.zeros(len(words), np.int64)
    for gap in (1, 2, 3, 5):
        back *= 2
        if len(words) > gap:
            back[gap:] += (words.hash[gap:] == words.hash[:-gap]) & (words.row[gap:] == words.row[:-gap])
    return [shape, SHAPES + back, SHAPES + ECHOES + (words.hash % np.uint64(WORDS)).astype(np.int64)]


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        out = [votes(Words(data, at[a:b + 1], SOLID)) for a, b in slices(at)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], ["votes"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        got, index, value = [], [], []
        for a, b in slices(at):
            words = Words(data, at[a:b + 1], SOLID)
            got += votes(words).tolist()
            n = np.maximum(np.bincount(words.row, minlength=b - a), 1)
            key = np.concatenate([words.row * (1 << 20) + f for f in features(words)])
            key, count = np.unique(key, return_counts=True)
            row = key >> 20
            cut = np.searchsorted(row, np.arange(1, b - a))
            index += np.split((key & ((1 << 20) - 1)).astype(np.int32), cut)
            x = count / n[row] * np.where((key & ((1 << 20) - 1)) >= SHAPES + ECHOES, WORD_SCALE, 1)
            value += np.split(x.astype(np.float32), cut)
        yield pa.RecordBatch.from_arrays(
            [pa.array(got, pa.int64()), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["votes", "at", "x"])


def label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of "good" for each pattern of votes, by expectation-maximisation over all patterns and their counts."""
    m = len(LABELLERS)
    ballot = (codes[:, None] // 3 ** np.arange(m - 1, -1, -1)) % 3
    good = ((ballot == 1).sum(1) + 1.0) / ((ballot != 2).sum(1) + 1.25)
    for _ in range(rounds):
        prior = np.clip((good * counts).sum() / max(counts.sum(), 1), 0.02, 0.98)
        odds = np.full(len(codes), np.log(prior / (1 - prior)))
        for k in range(m):
            table = np.full((2, 3), 1.0)
            np.add.at(table[1], ballot[:, k], good * counts)
            np.add.at(table[0], ballot[:, k], (1 - good) * counts)
            table /= table.sum(1, keepdims=True)
            # a labeller that says "good" is never evidence against, one that says "bad" never evidence for
            odds += np.array([min(np.log(table[1, 0] / table[0, 0]), 0), max(np.log(table[1, 1] / table[0, 1]), 0), 0])[ballot[:, k]]
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return good


def train_scorer(index: list, value: list, target: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias."""
    size = SHAPES + ECHOES + WORDS
    weights = np.zeros(size + 1)
    if not len(target):
        return weights
    row = np.repeat(np.arange(len(target)), [len(i) for i in index])
    col, x = np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float64)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 0.05), 0.5 / max((target <= 0.5).mean(), 0.05))
    for step in range(1, steps + 1):
        z = np.bincount(row, weights[col] * x, len(target)) + weights[-1]
        err = (1 / (1 + np.exp(-z)) - target) * balance / len(target)
        grad = np.append(np.bincount(col, err[row] * x, size), err.sum()) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return weights


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vote patterns, posterior of each, weights). Patterns are counted over all rows; at most 3**10 of them exist."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    seen = texts.mapInArrow(_vote_batches, "votes bigint").where("votes >= 0").groupBy("votes").count().toPandas()
    codes, counts = seen["votes"].to_numpy(np.int64), seen["count"].to_numpy(np.float64)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    posterior = label_model(codes, counts)
    some = sample_texts(texts, sample_rows).mapInArrow(_feature_batches, "votes bigint, at array<int>, x array<float>").where("votes >= 0").toPandas()
    where = np.searchsorted(codes, some["votes"].to_numpy(np.int64)) if len(some) else np.zeros(0, np.int64)
    return codes, posterior, train_scorer(list(some["at"]), list(some["x"]), posterior[where] if len(some) else np.zeros(0))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], column: str = "quality", text: str = "text") -> DataFrame:
    """All columns of docs and the score, 0 to 1; narrow, nothing is shuffled."""
    codes, posterior, weights = model
    trained = bool(np.any(weights))
    shared = docs.sparkSession.sparkContext.broadcast((codes, posterior, weights.astype(np.float32)))

    def run(column: pa.Array) -> pa.Array:
        codes, posterior, weights = shared.value
        data, at = utf8(column)
        out = [np.zeros(0)]
        for a, b in slices(at):
            words = Words(data, at[a:b + 1], SOLID)
            n = np.bincount(words.row, minlength=b - a)
            if trained:
                shape, back, word = features(words)
                total = weights[shape] + weights[back] + WORD_SCALE * weights[word]
                z = np.bincount(words.row, total, b - a) / np.maximum(n, 1) + weights[-1]
                s = 1 / (1 + np.exp(-z))
            else:
                where = np.searchsorted(codes, votes(words))
                s = posterior[np.minimum(where, len(posterior) - 1)] if len(posterior) else np.zeros(b - a)
            out.append(np.where(n > 0, s, 0.0))
        return pa.array(np.concatenate(out))

    return with_column(docs, column, "double", run, text)


def keep_good(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows that the classifier accepts, with their own columns."""
    mark = free_name(docs, "quality")
    return score(docs, fit(docs), mark).where(F.col(mark) >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def classify(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, score, keep, of every row."""
    rows = keyed_text(docs)
    return score(rows, fit(rows), "score").select("doc_id", "score", (F.col("score") >= keep).alias("keep"))
