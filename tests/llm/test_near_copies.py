"""Near copies against the Jaccard similarity of all pairs, over one tile and over many, and on odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_copies

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def components_of(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    like = [[not a and not b or len(a & b) * 10 >= 8 * len(a | b) > 0 for b in sets] for a in sets]
    while True:
        new = [min(root[j] for j in range(len(texts)) if near[j]) for near in like]
        if new == root:
            return root
        root = new


def edited(rng, base, edits):
    text = list(base)
    for k in range(edits):
        text[rng.randrange(len(text))] = f"e{rng.randrange(10**9)}x{k}"
    return text


def texts_of(seed):
    rng, out = random.Random(seed), []
    for size in (3, 5, 9, 12, 40, 40, 200, 600):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 9, 15):
            text = edited(rng, base, edits if size > 9 else min(edits, 1))
            out.append(" ".join(text) if len(out) % 3 else "  ".join(text).upper())
        out.append(" ".join(base[:-1]))
    # a group of texts that share most of their shingles with one another without reaching the likeness
    base = [f"g{k}" for k in range(300)]
    out += [" ".join(edited(rng, base, 11)) for _ in range(60)]
    return [*out, "", None, " "]


@pytest.mark.parametrize("tile", [near_copies.TILE, 7])
def test_components_by_jaccard_of_five_words(spark, tile, monkeypatch):
    monkeypatch.setattr(near_copies, "LEAST_TILE", min(tile, near_copies.LEAST_TILE))
    texts = texts_of(8)
    rows = [(n, t, "en") for n, t in enumerate(texts)]
    root = components_of(texts)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, tile).collect()} == dict(enumerate(root))
    kept = near_copies.keep_one(df, tile)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(root)) and kept.columns == df.columns


def test_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    root = components_of([r["text"] for r in rows])
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({rows[k]["doc_id"] for k in root})


def test_pairs_of_the_least_likeness_are_proposed():
    """The radius holds nearly all pairs at 0.8, however few shingles they have."""
    rng = np.random.default_rng(3)
    for size in (5, 6, 10, 15, 40, 100, 400):
        common, missed = -(-8 * size // 10), 0
        for _ in range(200):
            all_ = np.sort(rng.integers(0, 1 << 63, size).astype(np.uint64))
            own = rng.permutation(all_)
            mine = rng.integers(0, size - common + 1)
            pair = [np.sort(own[:common + mine]), np.sort(np.concatenate([own[:common], own[common + mine:]]))]
            marks = [near_copies.prints(x, np.array([0, len(x)])) for x in pair]
            side = [{"node": np.array([k]), "class": np.array([k]), "size": np.array([len(x)]), "prints": m} for k, (x, m) in enumerate(zip(pair, marks, strict=True))]
            assert near_copies.alike(*pair)
            missed += not any(len(a) for a, _, _ in near_copies._near(*side, same=False))
        assert missed <= 1


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "en"), (3, " \t", "en"), (5, "same text " * 9, "en"), (6, "same text " * 9, "en"), (6, "same text " * 9, "en"),
            (6, "Same text " * 9, "en"), (7, long, "en"), (8, long + " end", None), (None, "no key in this row at all", "en"), (None, "no key in this row at all", "en")]
    odd = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "size", "class", "band", "f0", "_hash", "_kept_id", "_n", "c0", "pick", "text_hash"):
        odd = odd.withColumn(name, F.lit("x"))
    got = near_copies.keep_one(odd)
    assert got.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(1, None), (5, "same text " * 9), (7, long), (0, "no key in this row at all")])
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []
