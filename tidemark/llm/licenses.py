"""License scans: MinHash bands over overlapping windows of words retrieve templates; exact shingle containment verifies.

Templates are cut into pieces of at most PIECE words; documents are looked at through windows of every piece length, at
every word. A window and a piece of Jaccard similarity s meet in some band with probability 1 - (1 - s**ROWS)**BANDS: 1
for a verbatim piece, 0.9997 at 0.8. A retrieved template is verified around the window: the share of its five-word
shingles (the whole, if it has fewer words) that stand there must be CONTAINMENT or more.

Defined results: a null or empty text has no license. Repeated rows give a row each; several places of one template in a
document count one by one, and the best containment is given. Ties between templates are all reported, by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import Words, found, keyed_text, mixed, slices, utf8

SHINGLE, PIECE, BANDS, ROWS, CONTAINMENT = 5, 12, 8, 2, 0.8
_SALTS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

# Notices by which public licenses are named, and openings of their texts.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "This work is dedicated to the public domain.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-line": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the run of SHINGLE words at each place of one row's word hashes."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - n + 1 + k]
    return mixed(out)


class Templates:
    def __init__(self, texts: dict[str, str], piece: int = PIECE):
        self.names = sorted(texts)
        data, at = utf8(pa.array([texts[n] for n in self.names], pa.string()))
        words = Words(data, at)
        self.words = [words.hash[words.first[i]:words.first[i + 1]] for i in range(len(self.names))]
        self.shingles = [np.unique(shingles(w)) for w in self.words]
        pieces: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                size = min(len(w), piece)
                for k in range(len(w) - size + 1):
                    pieces.setdefault(size, []).append((w[k:k + size], i, k))
        # for each piece length: per band a sorted array of keys, with the template and the place in it
        self.tables = []
        for size, own in sorted(pieces.items()):
            joined = np.concatenate([p[0] for p in own])
            signs = _band_keys(_row_shingles(joined, min(SHINGLE, size)), size)[:, ::1][:, np.arange(len(own)) * size]
            owner, place = np.array([p[1] for p in own]), np.array([p[2] for p in own])
            bands = []
            for keys in signs:
                order = np.argsort(keys, kind="stable")
                screen = np.zeros(1 << 16, bool)
                screen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
                bands.append((keys[order], owner[order], place[order], screen))
            self.tables.append((size, bands))


def _row_shingles(words: np.ndarray, n: int) -> np.ndarray:
    out = words[:max(len(words) - n + 1, 0)].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(out)]
    return mixed(out)


def _band_keys(grams: np.ndarray, size: int) -> np.ndarray:
    """(BANDS, windows) keys: least permuted shingles of windows of so many words, rows of a band combined."""
    return _combined([_least(_permuted(grams, k), max(size - SHINGLE + 1, 1)) for k in range(BANDS * ROWS)])


def _permuted(grams: np.ndarray, k: int) -> np.ndarray:
    x = grams * _SALTS[k]
    return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    done, n = values, 1
    while n * 2 <= width:
        done, n = np.minimum(done[:len(done) - n], done[n:]), n * 2
    rest = width - n
    return np.minimum(done[:len(done) - rest], done[rest:]) if rest and len(done) > rest else done[:max(len(values) - width + 1, 0)]


def _combined(least: list[np.ndarray]) -> np.ndarray:
    out = []
    for b in range(BANDS):
        key = least[b * ROWS].copy()
        for r in range(1, ROWS):
            key = key * np.uint64(0xBF58476D1CE4E5B9) + least[b * ROWS + r]
        out.append(key ^ (key >> np.uint64(29)))
    return np.stack(out) if out else np.zeros((0, 0), np.uint64)


def matches(words: Words, templates: Templates) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first word, end word, containment) of every verified place; places of one template do not overlap."""
    hits = [np.zeros((0, 3), np.int64)]
    by_length: dict[int, list[np.ndarray]] = {}
    for size, bands in templates.tables:
        n = min(SHINGLE, size)
        if len(words) < size:
            continue
        if n not in by_length:
            grams = _row_shingles(words.hash, n)
            by_length[n] = [_permuted(grams, k) for k in range(BANDS * ROWS)]
        width = max(size - SHINGLE + 1, 1)
        keys = _combined([_least(p, width) for p in by_length[n]])
        within = words.row[:len(words) - size + 1] == words.row[size - 1:]
        for own, (known, owner, place, screen) in zip(keys, bands, strict=True):
            at = np.flatnonzero(screen[(own & np.uint64(0xFFFF)).astype(np.int64)] & within[:len(own)])
            where, there = found(known, own[at])
            at, where = at[there], where[there]
            many = np.searchsorted(known, own[at], "right") - where
            each = np.repeat(where, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            spot = np.repeat(at, many)
            hits.append(np.stack([owner[each], words.row[spot], spot - place[each]], axis=1))
    all_hits = np.unique(np.concatenate(hits), axis=0)
    out, last = [], (-1, -1, -1)
    for t, r, begin in all_hits.tolist():
        own = templates.words[t]
        if (t, r) == last[:2] and begin < last[2]:
            continue
        slack = len(own) // 5
        lo, hi = max(begin - slack, int(words.first[r])), min(begin + len(own) + slack, int(words.first[r + 1]))
        n = min(SHINGLE, len(own))
        here = _row_shingles(words.hash[lo:hi], n)
        there = np.isin(here, templates.shingles[t])
        share = len(np.unique(here[there])) / len(templates.shingles[t])
        if share >= CONTAINMENT:
            spots = np.flatnonzero(there)
            end = lo + int(spots[-1]) + n
            out.append((r, t, lo + int(spots[0]), end, share))
            last = (t, r, end)
    return _best(out)


def _best(places: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Without the places that overlap one of another template with a higher containment."""
    places.sort(key=lambda m: (m[0], m[2], m[1]))
    out, reach = [], []  # reach: the furthest end of the row's places so far
    for r, _, _, hi, _ in places:
        reach.append((r, max(hi, reach[-1][1]) if reach and reach[-1][0] == r else hi))
    for i, (r, t, lo, hi, share) in enumerate(places):
        near, k = [], i - 1
        while k >= 0 and reach[k][0] == r and reach[k][1] > lo:
            near.append(places[k])
            k -= 1
        k = i + 1
        while k < len(places) and places[k][0] == r and places[k][2] < hi:
            near.append(places[k])
            k += 1
        if not any(m[4] > share and m[1] != t and m[2] < hi and lo < m[3] for m in near):
            out.append((r, t, lo, hi, share))
    return out


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licenses (names, comma-joined), n_places, containment (the best), spans (name:start:end in bytes)."""
    shown = texts or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(shown)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            own: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for a, b in slices(at):
                words = Words(data, at[a:b + 1])
                for r, t, lo, hi, share in matches(words, templates):
                    start, end = words.start[lo] - words.bounds[r], words.end[hi - 1] - words.bounds[r]
                    own[a + r].append((templates.names[t], int(start), int(end), share))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([",".join(sorted({m[0] for m in o})) for o in own], pa.string()),
                pa.array([len(o) for o in own], pa.int64()), pa.array([max((m[3] for m in o), default=0.0) for o in own], pa.float64()),
                pa.array([",".join(f"{n}:{s}:{e}" for n, s, e, _ in sorted(o, key=lambda m: (m[1], m[0]))) for o in own], pa.string())],
                ["doc_id", "licenses", "n_places", "containment", "spans"])

    return keyed_text(docs).mapInArrow(run, "doc_id bigint, licenses string, n_places bigint, containment double, spans string")
