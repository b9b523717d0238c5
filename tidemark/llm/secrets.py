"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as the begin of a secret,
inside one or outside.

The field sees the shape of a token, the words beside it, the signs between and features of its file (the document), and
is decoded by Viterbi. It is trained here, on windows around the patterns' own findings in a bounded sample of distinct texts
(SAMPLE_ROWS, by a hash of the text, half of them among texts that may hold a finding; a window may reach beyond its text's
edges), and so also finds secrets that stand in such places in another form. Before
decoding, a token whose margin for "outside" exceeds all that its two transitions could gain is fixed as outside; this
never changes the best path, and leaves short stretches to decode.

Defined results: a null or empty text has no spans. Repeated rows are scanned each. Patterns match ASCII letters only in
either case. A field span that overlaps a pattern's span is not added. If no text holds a finding, no field is
trained and the patterns' spans are all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Words, fold_table, forget, free_name, keyed_text, mixed, runs, sample_texts, settle, slices, utf8, with_column

# The patterns and the least sizes of the findings.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_SIZE, ACCESS_SIZE, HEX_SIZE = 6, 20, 24

#: What could hold a finding, for Spark's own regular expressions.
SCREEN = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}"

#: Bounds of the training set: texts, windows with a secret in the middle, windows without, and those of one text without.
SAMPLE_ROWS = 3000
SECRET_WINDOWS, QUIET_WINDOWS, QUIET = 1500, 4500, 4
WINDOW = 15
TAGS = 3  # outside, begin, inside
SHAPES, MIXES, WORDS, SIGNS, FILES = 4096, 64, 4096, 64, 16
_OFFSETS = np.cumsum([0, SHAPES, MIXES, WORDS, WORDS, WORDS, SIGNS])
SIZE = int(_OFFSETS[-1]) + FILES
FEATURES = 7

TOKEN = fold_table(lambda b: b >= 128 or chr(b).isalnum() or chr(b) in "+/_.-")
_HEX = fold_table(lambda b: chr(b) in "0123456789abcdef") != 0


def _mask(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars]).astype(np.int64)


_UPPER, _LOWER, _DIGIT = (_mask("".join(map(chr, range(*r)))) for r in ((65, 91), (97, 123), (48, 58)))
_PUNCT, _ASSIGNS, _QUOTES, _BREAKS = _mask("+/_.-"), _mask("=:"), _mask("\"'`"), _mask("\n\r")


def base_spans(raw: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, start, kind, end, start of the value), bytes in the slice, of the patterns, in that order."""
    out, text = [], raw.tobytes()
    start, end = runs(_HEX[raw], bounds)
    long = np.flatnonzero(end - start >= HEX_SIZE)
    row = np.searchsorted(bounds, start[long], "right") - 1
    out += [(r, s, 2, e, s) for r, s, e in zip(row.tolist(), start[long].tolist(), end[long].tolist(), strict=True)]
    low = text.lower()
    for words, whole, pattern, kind in ((KEYWORDS, low, ASSIGN, 0), ((b"AKIA",), text, ACCESS, 1)):
        spots = []
        for word in words:
            k = -1
            while (k := whole.find(word, k + 1)) >= 0:
                spots.append(k)
        for r in np.unique(np.searchsorted(bounds, spots, "right") - 1).tolist() if spots else []:
            for m in pattern.finditer(text[bounds[r]:bounds[r + 1]]):
                value = m.span(2) if kind == 0 else m.span()
                if value[1] - value[0] >= (ASSIGN_SIZE, ACCESS_SIZE)[kind]:
                    out.append((r, int(bounds[r]) + m.start(), kind, int(bounds[r]) + m.end(), int(bounds[r]) + value[0]))
    return sorted(out)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, FEATURES) indices of weights, and whether a line or row begins at the token."""
    raw, n = words.raw, len(words)
    if not n:
        return np.zeros((0, FEATURES), np.int64), np.zeros(0, bool)
    sums = lambda t: np.concatenate([[0], np.cumsum(t[raw])])
    start, end, size = words.start, words.end, words.end - words.start
    upper, lower, digit, punct, hexes = (s[end] - s[start] for s in map(sums, (_UPPER, _LOWER, _DIGIT, _PUNCT, _HEX.astype(np.int64))))
    bucket = np.searchsorted([3, 5, 7, 11, 15, 19, 23, 31, 39, 63], size)
    parts = [upper > 0, lower > 0, digit > 0, punct > 0, upper + lower + digit + punct < size, hexes == size, digit == size, lower == size - (upper == 1)]
    code = bucket.astype(np.int64)
    for p in parts:
        code = code * 2 + p
    kind = np.select([_DIGIT[raw] > 0, _UPPER[raw] > 0, _LOWER[raw] > 0], [1, 2, 3], 0)
    change = np.zeros(len(raw), np.int64)
    change[1:] = kind[1:] != kind[:-1]
    changes = np.concatenate([[0], np.cumsum(change)])
    turns = np.searchsorted([0, 1, 2, 4, 8, 12], changes[end] - changes[start + 1])
    head = (raw[start] == 65) & (size > 4)
    mix = turns * 8 + np.minimum(digit * 8 // size, 7) % 4 * 2 + head
    own = (words.hash % np.uint64(WORDS)).astype(np.int64)
    same = np.zeros(n, bool)
    same[1:] = words.row[1:] == words.row[:-1]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:] = np.where(same[1:], own[:-1], 0)
    after[:-1] = np.where(same[1:], own[1:], 0)
    gap_from, gap_to = np.zeros(n, np.int64), start
    gap_from[1:] = end[:-1]
    gap_from = np.maximum(gap_from, words.bounds[words.row])
    assigns, quotes, breaks = map(sums, (_ASSIGNS, _QUOTES, _BREAKS))
    between = lambda s: s[gap_to] - s[gap_from] > 0
    sign, quote, line = between(assigns), between(quotes), between(breaks)
    following = np.zeros(n, bool)
    following[:-1] = sign[1:] & same[1:]
    long = (size >= 16).astype(np.int64)
    signs = ((sign * 2 + quote) * 2 + line) * 2 + following
    signs = (signs * 2 + long) * 2 + (digit > 0)
    digits_of = np.bincount(words.row, digit, len(words.bounds) - 1) / np.maximum(np.diff(words.bounds), 1)
    equals_of = (assigns[words.bounds[1:]] - assigns[words.bounds[:-1]]) / np.maximum(np.diff(words.bounds), 1)
    file = (np.searchsorted([0.001, 0.01, 0.05], digits_of) * 4 + np.searchsorted([0.0001, 0.002, 0.02], equals_of))[words.row]
    short = np.where(size <= 14, own, 0)
    out = np.stack([mixed(code.astype(np.uint64)).astype(np.int64) & (SHAPES - 1), mix, short, before, after, signs, file], axis=1)
    return out + np.append(_OFFSETS[:-1], _OFFSETS[-1])[None, :FEATURES], line | ~same


def _labels(words: Words, spans: list) -> np.ndarray:
    """0 outside, 1 begin, 2 inside, by the values of the patterns' spans."""
    y = np.zeros(len(words), np.int64)
    for _, _, _, end, value in spans:
        a, b = np.searchsorted(words.end, value, "right"), np.searchsorted(words.start, end)
        y[a:b] = 2
        y[a:a + 1] = 1
    return y


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) token places and whether each has a secret in its middle; -1 stands beyond the text's edges.

    Every begin of a secret is a middle, and of each row the QUIET other tokens of least hash among every 97th word and all odd tokens.
    """
    y = _labels(words, base_spans(words.raw, words.bounds))
    signs = np.concatenate([[0], np.cumsum(_DIGIT[words.raw] | _PUNCT[words.raw])])
    odd = (words.end - words.start >= 10) & (signs[words.end] > signs[words.start])
    centres = np.flatnonzero(y == 1)
    quiet = np.flatnonzero(((words.hash % np.uint64(97) == 0) | odd) & (y == 0))
    order = np.lexsort((mixed(words.hash[quiet] + quiet.astype(np.uint64)), words.row[quiet]))
    quiet = quiet[order]
    quiet = quiet[np.arange(len(quiet)) - np.searchsorted(words.row[quiet], words.row[quiet]) < QUIET]
    middle = np.concatenate([centres, quiet]).astype(np.int64)
    places = middle[:, None] + np.arange(-(WINDOW // 2), WINDOW - WINDOW // 2)
    row = words.row[middle][:, None]
    inside = (places >= words.first[row]) & (places < words.first[row + 1])
    return np.where(inside, places, -1), np.arange(len(middle)) < len(centres)


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(0))
        xs, ys, has = [np.zeros((0, WINDOW * FEATURES), np.int32)], [np.zeros((0, WINDOW), np.int32)], [np.zeros(0, bool)]
        for a, b in slices(at):
            words = Words(data, at[a:b + 1], TOKEN)
            places, secret = _windows(words)
            x = np.append(features(words)[0], np.full((1, FEATURES), SIZE), axis=0)  # the last row stands beyond the edge
            y = np.append(_labels(words, base_spans(words.raw, words.bounds)), 0)
            xs.append(x[places].reshape(len(places), WINDOW * FEATURES).astype(np.int32))
            ys.append(y[places].astype(np.int32))
            has.append(secret)
        x, y, has = np.concatenate(xs), np.concatenate(ys), np.concatenate(has)
        yield pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WINDOW * FEATURES).cast(pa.list_(pa.int32())),
            pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), WINDOW).cast(pa.list_(pa.int32())), pa.array(has)], ["x", "y", "secret"])


def train(x: np.ndarray, y: np.ndarray, steps: int = 60, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(weights by feature and tag, transitions): the likelihood of the tags is raised by its gradient.

    Feature SIZE stands for what lies beyond a text's edge; its weight is learned with the others and then dropped.
    """
    n, length = y.shape
    weights, moves = np.zeros((SIZE + 1, TAGS)), np.zeros((TAGS, TAGS))
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, moves)]
    eye = np.eye(TAGS)
    flat = x.reshape(-1)
    repeat = np.repeat(np.arange(n * length), FEATURES)
    told = np.zeros((TAGS, TAGS))
    np.add.at(told, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        score = weights[x].sum(2)  # n, length, tags
        forward, back = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, length):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + score[:, t]
        for t in range(length - 2, -1, -1):
            back[:, t] = np.logaddexp.reduce(moves[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        wrong = np.exp(forward + back - total[:, None, None]) - eye[y]
        pair = np.zeros((TAGS, TAGS))
        for t in range(length - 1):
            pair += np.exp(forward[:, t, :, None] + moves + (score[:, t + 1] + back[:, t + 1])[:, None, :] - total[:, None, None]).sum(0)
        grad = np.stack([np.bincount(flat, wrong[..., k].reshape(-1)[repeat], SIZE + 1) for k in range(TAGS)], axis=1) / n + 1e-4 * weights
        for (m, v), w, g in zip(state, (weights, moves), (grad, (pair - told) / n + 0.05 * moves), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights[:SIZE], moves


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Trained on windows of a sample: half of the sampled texts are chosen among those that may hold a finding, half among all. Windows
    with and without a secret in their middle are chosen apart, by hash. None if no text has a finding: then there is nothing
    to learn from."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    half = max(1, sample_rows // 2)
    likely, any_ = sample_texts(texts, half, F.col("text").rlike(SCREEN)), sample_texts(texts, half)
    windows = likely.unionByName(any_).mapInArrow(_window_batches, "x array<int>, y array<int>, secret boolean")
    windows = settle(windows.withColumn("h", F.xxhash64("x", "y")).dropDuplicates(["h"]), "windows")
    bounds = ((True, SECRET_WINDOWS), (False, QUIET_WINDOWS))
    parts = [windows.where(F.col("secret") == F.lit(k)).orderBy("h").limit(n).select("x", "y").toPandas() for k, n in bounds]
    forget(windows)
    if not len(parts[0]):
        return None
    x, y = (np.stack([v for part in parts for v in part[c]]).astype(np.int64) for c in ("x", "y"))
    return train(x.reshape(len(y), WINDOW, FEATURES), y)


def viterbi(score: np.ndarray, begins: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of all lines; each line stands between two outside tags."""
    n = len(score)
    tags = np.zeros(n, np.int64)
    gain = max(moves[a, y] - moves[a, 0] for a in range(TAGS) for y in (1, 2)) + max(moves[y, b] - moves[0, b] for b in range(TAGS) for y in (1, 2))
    unsure = score[:, 0] - score[:, 1:].max(1) <= gain if n else np.zeros(0, bool)
    open_at = np.flatnonzero(unsure)
    if not len(open_at):
        return tags
    first = np.ones(len(open_at), bool)
    first[1:] = (np.diff(open_at) > 1) | begins[open_at[1:]]
    start = open_at[first]
    length = np.diff(np.append(np.flatnonzero(first), len(open_at)))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    best = moves[0] + score[start]
    backs = np.zeros((n, TAGS), np.int8)
    final = np.zeros((len(start), TAGS))
    for t in range(int(length[0])):
        alive = int(np.searchsorted(-length, -t, "left"))  # runs longer than t
        if t:
            paths = best[:alive, :, None] + moves[None]
            backs[start[:alive] + t] = paths.argmax(1)
            best = paths.max(1) + score[start[:alive] + t]
        ending = int(np.searchsorted(-length, -(t + 1), "left"))
        final[ending:alive] = best[ending:alive] + moves[:, 0]
    tag = final.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-length, -t, "left"))
        at = start[:alive] + t
        tags[at] = tag[:alive]
        tag[:alive] = backs[at, tag[:alive]]
    return tags


def spans_of(words: Words, model: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int, int, int]]:
    """(row, start, kind, end), bytes in the slice, sorted."""
    base = base_spans(words.raw, words.bounds)
    out = [s[:4] for s in base]
    if model is None or not len(words):
        return out
    weights, moves = model
    x, begins = features(words)
    score = weights[x[:, 0]]
    for k in range(1, FEATURES):
        score = score + weights[x[:, k]]
    tags = viterbi(score, begins, moves)
    inside = tags > 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (tags[1:] == 1) | begins[1:]
    first = np.flatnonzero(head)
    if len(first):
        index = np.flatnonzero(inside)
        last = index[np.append(np.searchsorted(index, first[1:]), len(index)) - 1]
        taken = np.zeros(len(words.raw) + 1, np.int64)
        for _, s, _, e in out:
            taken[s] += 1
            taken[e] -= 1
        taken = np.concatenate([[0], np.cumsum(np.cumsum(taken) > 0)])
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            s, e = int(words.start[a]), int(words.end[b])
            if taken[e] == taken[s]:
                out.append((int(words.row[a]), s, 3, e))
    return sorted(out)


def _points(raw: np.ndarray, bounds: np.ndarray, spans: list) -> list[tuple[int, int, int, int]]:
    """Byte positions to code points of the row."""
    out, row, points = [], -1, None
    for r, s, k, e in spans:
        if r != row:
            row, points = r, np.concatenate([[0], np.cumsum((raw[bounds[r]:bounds[r + 1]] & 0xC0) != 0x80)])
        out.append((r, int(points[s - bounds[r]]), k, int(points[e - bounds[r]])))
    return out


def _broadcast(docs: DataFrame, model):
    return docs.sparkSession.sparkContext.broadcast(None if model is None else (model[0].astype(np.float32), model[1].astype(np.float32)))


def scan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans of every row."""
    rows = keyed_text(docs)
    shared = _broadcast(rows, fit(rows, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            n = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            own: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for a, b in slices(at):
                words = Words(data, at[a:b + 1], TOKEN)
                for r, s, k, e in _points(words.raw, words.bounds, spans_of(words, shared.value)):
                    n[a + r, k] += 1
                    own[a + r].append((k, f"{KINDS[k]}:{s}:{e}"))
            base = [hashlib.sha256(",".join(t for k, t in o if k < 3).encode()).hexdigest() for o in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(n[:, k]) for k in range(len(KINDS))], pa.array(base, pa.string()),
                 pa.array([",".join(t for _, t in o) for o in own], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with every span replaced; n_chars, if there, follows the text. Null texts stay null."""
    shared = _broadcast(docs, fit(docs, sample_rows))

    def run(column: pa.Array) -> pa.Array:
        data, at = utf8(column)
        out: list[str | None] = []
        for a, b in slices(at):
            words = Words(data, at[a:b + 1], TOKEN)
            parts: dict[int, list] = {}
            for r, s, _, e in spans_of(words, shared.value):
                parts.setdefault(r, []).append((s, e))
            text = words.raw.tobytes()
            for r in range(b - a):
                lo, hi = int(words.bounds[r]), int(words.bounds[r + 1])
                kept = []
                for s, e in parts.get(r, []):
                    if s >= lo:
                        kept += [text[lo:s], mark.encode()]
                    lo = max(lo, e)
                out.append(b"".join([*kept, text[lo:hi]]).decode())
        return pa.array([t if v else None for t, v in zip(out, column.is_valid().to_pylist(), strict=True)], pa.string())

    fresh = free_name(docs, "text")
    done = with_column(docs, fresh, "string", run)
    names = {"text": F.col(fresh)} | ({"n_chars": F.length(fresh).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[names.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
