"""Packing of token ids into windows by the sum-of-squares rule, in one narrow pass over the documents.

A document is its ids and one end id. Its full windows are cut off; the rest goes to the fill level that keeps the sum of
squared counts of partially filled windows, by level, least (ties: the fuller result). The counts stand in one array. A
level that is a power of two needs no padding and so does not count. Each partition packs its own rows. What stays open
at its end, or when OPEN_WINDOWS are open, is cut anew into full windows; the last rest is cut into powers of two, so that
no window is padded.

Ids are those of the tokenizers library for the given file. The same vocabulary is applied through tiktoken, which is four
times as fast, and once for each different stretch of a slice; other texts go through tokenizers itself (see Encoder).

Defined results: a null or empty text is its end id alone. Repeated rows are packed each. Null keys stay null. An empty
table gives an empty result. sequence_id holds the partition in its upper bits; a partition that runs again gives the same
rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.shared import SOLID, keyed_text, prefix_hash, slices, span_hash, utf8

WINDOW, END_ID = 1024, 0
OPEN_WINDOWS = 4096
VOCABULARY = "byte_bpe_50k.json"
#: Bytes in which each different stretch (white space and what follows it, up to the next white space) is encoded once.
SLICE = 4 << 20
#: Texts with a longer stretch go through tokenizers, whose time per stretch doesn't grow with its square.
LONG_STRETCH = 4_096


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids of a byte-level BPE file of tokenizers."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        name = f"tidemark:{path}"
        if name not in tiktoken.registry.ENCODINGS:  # the library's own cache: a reused worker keeps it
            with open(path, encoding="utf-8") as file:
                content = json.load(file)
            signs = _byte_signs()
            added = {t["content"] for t in content.get("added_tokens", [])}
            ranks = {bytes(signs[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in added}
            tiktoken.registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fast = tiktoken.registry.ENCODINGS[name]
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

        self.widths = np.array([len(self.fast.decode_single_token_bytes(i)) if i not in self.whole.get_added_tokens_decoder() else 0 for i in range(self.whole.get_vocab_size())])

    def __call__(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def rows(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each row. No token crosses from a character into white space after it, so a row is cut there, and
        each different stretch of a slice is encoded once. Rows in which a cut could matter are encoded whole: those
        with white space beyond ASCII, a special token or a very long stretch."""
        raw, bounds = data[at[0]:at[-1]], at - at[0]
        rows = len(at) - 1
        if not len(raw):
            return [np.zeros(0, np.uint32)] * rows
        space = SOLID[raw] == 0
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        row = np.searchsorted(bounds, start, "right") - 1
        whole = self._odd_rows(raw, bounds)
        whole[row[end - start > LONG_STRETCH]] = True
        hashes = span_hash(prefix_hash(raw), start, end)
        keys, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        view = raw.tobytes()
        a, b = start[first], end[first]
        plain = space[a] & ~space[b - 1] & ~whole[row[first]]  # such stretches can stand one after another
        joined = np.flatnonzero(plain)
        ids = np.array(self.fast.encode_ordinary(b"".join([view[x:y] for x, y in zip(a[joined].tolist(), b[joined].tolist(), strict=True)]).decode()), np.uint32)
        upto = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(b[joined] - a[joined])) + 1
        size = np.zeros(len(keys), np.int64)
        size[joined] = np.diff(upto, prepend=0)
        at_first = np.zeros(len(keys), np.int64)
        at_first[joined] = upto - size[joined]
        rest, tail = np.flatnonzero(~plain), len(ids)
        others = [self.fast.encode_ordinary(view[x:y].decode()) if not w else [] for x, y, w in zip(a[rest].tolist(), b[rest].tolist(), whole[row[first[rest]]].tolist(), strict=True)]
        for k in np.flatnonzero(whole[row[first[rest]]]):  # its own row is encoded whole; another row may hold it too
            others[k] = self(view[a[rest[k]]:b[rest[k]]].decode())
        size[rest] = [len(o) for o in others]
        at_first[rest] = tail + np.cumsum(size[rest]) - size[rest]
        flat = np.concatenate([ids, np.fromiter(chain.from_iterable(others), np.uint32, int(size[rest].sum()))])
        many = size[place]
        upto = np.cumsum(many)
        ids = flat[np.repeat(at_first[place] - (upto - many), many) + np.arange(upto[-1])]
        edge = np.concatenate([[0], upto])[np.searchsorted(row, np.arange(rows + 1))]
        out = [ids[edge[i]:edge[i + 1]] for i in range(rows)]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self(view[bounds[i]:bounds[i + 1]].decode()), np.uint32)
        return out

    def _odd_rows(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        odd = np.zeros(len(bounds) - 1, bool)
        spots = []
        high = np.flatnonzero(raw[:-1] >= 0xC2)
        for a, b in _WIDE_SPACE:
            spots.append(high[(raw[high] == a) & (raw[high + 1] == b)])
        text = raw.tobytes()
        for sign in self.special:
            sign, k = sign.encode(), -1
            while (k := text.find(sign, k + 1)) >= 0:
                spots.append(np.array([k]))
        odd[np.searchsorted(bounds, np.concatenate(spots), "right") - 1] = True
        return odd


#: First two bytes of every white-space character beyond ASCII in UTF-8 (and of some other characters).
_WIDE_SPACE = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]


def _byte_signs() -> dict[str, int]:
    """Byte-level BPE files write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Packer:
    """Pieces (doc, start, ids) to windows; done holds (pieces, ...) of closed windows in the order they closed."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.window, self.most_open = window, most_open
        self.count = np.zeros(window + 1, np.int64)
        self.weight = np.ones(window + 1, np.int64)
        self.weight[[2**k for k in range(window.bit_length()) if 2**k <= window]] = 0
        self.weight[[0, window]] = 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.open_windows = 0
        self.done: list[list[tuple]] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for at in range(0, full, self.window):
            self.done.append([(doc, at, ids[at:at + self.window])])
        if full < len(ids):
            self._place((doc, full, ids[full:]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        room = self.window - size + 1
        cost = self.weight[size:] * (2 * self.count[size:] + 1) - self.weight[:room] * (2 * self.count[:room] - 1)
        cost[0] = self.weight[size] * (2 * self.count[size] + 1)
        usable = self.count[:room] > 0
        usable[0] = True
        at = np.flatnonzero(usable)
        cost = cost[at]
        level = int(at[len(at) - 1 - int(np.argmin(cost[::-1]))])
        pieces = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        self.open_windows -= level > 0
        pieces.append(piece)
        self._put(level + size, pieces)
        if self.open_windows > self.most_open:
            self.recut()

    def _put(self, level: int, pieces: list[tuple]) -> None:
        if level == self.window:
            self.done.append(pieces)
        else:
            self.open[level].append(pieces)
            self.count[level] += 1
            self.open_windows += 1

    def recut(self, last: bool = False) -> None:
        """Close all windows without padding; short of the end, one rest may stay open."""
        loose = []
        for level in range(1, self.window):
            for pieces in self.open[level]:
                if self.weight[level] == 0:
                    self.done.append(pieces)
                else:
                    loose += pieces
            self.open[level] = []
        self.count[:] = 0
        self.open_windows = 0
        left = sum(len(p[2]) for p in loose)
        current: list[tuple] = []
        fill, goal = 0, self._goal(left, last)
        for doc, start, ids in loose:
            while len(ids):
                take = min(len(ids), goal - fill)
                current.append((doc, start, ids[:take]))
                start, ids, fill = start + take, ids[take:], fill + take
                if fill == goal:
                    left -= fill
                    if last or goal == self.window:
                        self.done.append(current)
                    else:
                        self._put(fill, current)
                    current, fill, goal = [], 0, self._goal(left, last)

    def _goal(self, left: int, last: bool) -> int:
        if left >= self.window or not left:
            return self.window
        return 1 << (left.bit_length() - 1) if last else left

    def take(self) -> list[list[tuple]]:
        done, self.done = self.done, []
        return done


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(path), Packer(window)
        sequence = TaskContext.get().partitionId() << 40
        keys: dict[int, tuple] = {}  # row to (doc_id, tokens), of rows that are still open
        row = 0

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for pieces in windows:
                offset = 0
                for doc, start, ids in pieces:
                    key, tokens = keys[doc]
                    out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset, ids))
                    offset += len(ids)
                sequence += 1
            columns = list(zip(*out, strict=True)) or [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, NAMES[:len(arrays)])

        for batch in batches:
            data, at = utf8(batch.column("text"))
            for a, b in slices(at, SLICE):
                for key, ids in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), encoder.rows(data, at[a:b + 1]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                    keys[row] = (key, len(ids))
                    packer.add(row, ids)
                    row += 1
                yield rows(packer.take())
                if len(keys) > 4 * OPEN_WINDOWS:
                    alive = {p[0] for level in packer.open for pieces in level for p in pieces}
                    keys = {r: v for r, v in keys.items() if r in alive}
        packer.recut(last=True)
        yield rows(packer.take())

    return keyed_text(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
SCHEMA = ", ".join(f"{n} bigint" for n in NAMES[:7])
