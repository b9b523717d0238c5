"""The conversation trie against a plain trie of tuples, on random and odd conversations, and against its SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in own.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    return out


def plain(convs):
    """Every node of the trie, each total by walking the whole subtree."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        turns = tuple(convs[c])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, out = Counter(p[:-1] for p in members if p), Counter()
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    for p, who in members.items():
        out[(
            who[0], len(p), members[p[:-1]][0] if p else None, len(who), children[p], sum(not children[q] for q in below[p]),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q), hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in FIELDS) for r in df.select(*FIELDS).collect())


def test_the_given_conversations_and_their_sql(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = plain(rebuild(ordered(rows)))
    assert got(trie.rebuilt_trie(df)) == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cur = con.execute(trie.SQL)
    at = [[c[0] for c in cur.description].index(f) for f in FIELDS]
    assert Counter(tuple(r[i] for i in at) for r in cur.fetchall()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_prefixes_of_any_length(spark, seed):
    rng = random.Random(seed)
    rows, trunk = [], [(rng.choice("ua"), rng.choice(["x", "yy", ""])) for _ in range(40)]
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 37])
        turns = trunk[:rng.randint(0, n)]
        turns += [(rng.choice("ua"), rng.choice(["x", "yy", "é"])) for _ in range(n - len(turns))]
        rows += [(c * 7, k, *t) for k, t in enumerate(turns)]
    rows += [(5000 + c, k, *t) for c in range(30) for k, t in enumerate(trunk[:3])]  # a hot conversation
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(trie.trie(*trie.plain_sequences(df))) == plain(ordered(rows))
    assert got(trie.rebuilt_trie(df)) == plain(rebuild(ordered(rows)))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (100, None, None, None), (100, None, "user", "a"), (100, 3, "user", ""), (100, 3, "user", ""),
        (100, 3, "use", "r"), (101, 0, None, "a" * 300_000), (102, 0, "", "a" * 300_000), (-5, 0, "user", "hi"), (0, 0, "user", "ho"),
        (205, 1, "a", "b"), (305, 1, "a", "b")]
    odd = spark.createDataFrame(rows, KIND)
    for name in ("tree", "token", "seq", "depth", "pos", "at", "n", "level", "_local", "own"):
        odd = odd.withColumn(name, F.lit("z"))
    assert got(trie.rebuilt_trie(odd)) == plain(rebuild(ordered(rows)))
    assert got(trie.trie(*trie.plain_sequences(odd))) == plain(ordered(rows))
    assert trie.rebuilt_trie(spark.createDataFrame([], KIND)).collect() == []


def test_conversations_without_turns_belong_to_the_root(spark):
    ids = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "u", "x") for c in ids]  # their first conversation is absent and the only turn of their own is left out
    (root,) = trie.rebuilt_trie(spark.createDataFrame(rows, KIND)).collect()
    assert (root["depth"], root["n_convs"], root["n_leaves"], root["n_children"]) == (0, 3, 1, 0)
    assert root["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_ids_are_joined_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 10)
    rows = [(c, 0, "u", "x") for c in range(0, 90_000, 100)]
    nodes = {r["depth"]: r for r in trie.trie(*trie.plain_sequences(spark.createDataFrame(rows, KIND))).collect()}
    assert nodes[1]["ends_sha256"] == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert (nodes[0]["saved_tokens"], nodes[1]["n_convs"]) == (899, 900)
