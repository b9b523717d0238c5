"""Prefix trie of conversations by van Emde Boas recursion: cut at half depth, name, build both halves, graft totals upward.

The trie of sequences of height h (a power of two) is cut at h/2. What a sequence has above the cut is named; equal names are one
leaf of the upper trie, and the sequences that go on below it form a lower trie that carries this name. Upper trie and lower
forest are tries of half the height, and all tries of one height are cut in the same job, so a conversation of L turns takes
log L rounds, whatever its length. A trie of height one is a set of last turns: each (trie, turn) is a node, and the trie's name
stands for its parent. On the way back, from the lowest cut to the highest, each lower trie's totals are added to the
nodes on the path above its cut. Every total crosses each cut once, so a node is not added to all of its ancestors one by one.

At scale: turns are reduced to a 16-byte token and a length before the first shuffle. Positions come from a range partitioning
(shared.positions), so a conversation may hold any share of all rows. Equal conversations are one weighted sequence. Names are
bit_xor sums of hashed (position, token) pairs, two of 64 bits, which combine before they shuffle; a round touches only
sequences longer than its cut. The ids that end at a node are joined piece by piece in ranges of ids; only the pieces of one
digest stream through one task, as SHA-256 itself asks.

Defined results: rows without conv_id belong to no conversation and take no part. A null turn comes first; rows of one turn are
ordered by the MD5 of their role and text, repeated rows are turns of their own. A null role or text counts as empty. An empty
table has no root. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import forget, positions, settle

#: Bytes of a piece of comma-joined ids.
PIECE = 1 << 16
_NODE = ["tree", "token"]
_ROOT = hashlib.md5(b"root").digest()


def turn_token(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the role's length keeps role and text apart."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), token, size (code points of the text) of every turn."""
    rows = settle(turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        turn_token(F.col("role"), F.col("text")).alias("token"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("at")), "turns")
    return positions(rows, ["conv_id"], ["turn", "token", "at"], "pos").select("conv_id", "pos", "token", "size")


def rebuilt(turns: DataFrame, stride: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c begins with the first h turns of c - c % stride, h = crc32(c) % heads, and goes on with its own after h.

    Two tables: conv_id, length of every conversation; conv_id, depth, token, size of their turns.
    """
    own = numbered_turns(turns)
    counts = settle(own.groupBy("conv_id").agg(F.count("*").alias("own")), "counts")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = counts.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("base"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = settle(convs.select("conv_id", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "convs")
    after = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "token", "size")
    first = own.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "token", "size")
    before = first.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("depth <= taken")
    rows = settle(after.unionByName(before.select("conv_id", "depth", "token", "size")), "rebuilt")
    forget(counts)
    return convs.select("conv_id", "length"), rows


def _sums(pos: str = "pos") -> list[Column]:
    return [F.bit_xor(F.xxhash64(F.lit(k), F.col(pos).cast("bigint"), F.col("token"))).alias(f"x{k}") for k in (1, 2)]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def classes(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal sequences as one. seq (least conversation), length, n of each class; seq, conv_id of the members of classes of several."""
    names = rows.groupBy("conv_id").agg(*_sums("depth"))
    key = ["length", "x1", "x2"]
    named = settle(convs.join(names, "conv_id", "left").select("conv_id", "length", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("x1", "x2")]), "named")
    found = settle(named.groupBy(*key).agg(F.min("conv_id").alias("seq"), F.count("*").alias("n")), "classes")
    members = named.join(found.where("n > 1").select(*key, "seq"), key).select("seq", "conv_id")
    return found.select("seq", "length", "n"), members


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (seq, conv_id) to comma-joined pieces; first orders the pieces of a seq."""
    now, ids, size = None, [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([int(ids[0])], pa.int64()), pa.array([",".join(ids)])], ["seq", "first", "ids"])

    for batch in batches:
        for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.string()).to_pylist(), strict=True):
            if ids and (seq != now or size > PIECE):
                yield flush()
                ids, size = [], 0
            now = seq
            ids.append(conv)
            size += len(conv) + 1
    if ids:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (seq, first) to one digest per seq, piece after piece."""
    now = digest = None
    for batch in batches:
        seqs, out = [], []
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if seq != now:
                if digest is not None:
                    seqs.append(now)
                    out.append(digest.hexdigest())
                now, digest = seq, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(out, pa.string())], ["seq", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["seq", "ends_sha256"])


def ends(found: DataFrame, members: DataFrame) -> DataFrame:
    """seq, ends_sha256: digest of the comma-joined ids of each class, ascending."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = members.repartitionByRange(parts, "conv_id").sortWithinPartitions("seq", "conv_id").select("seq", "conv_id").mapInArrow(_pieces, "seq bigint, first bigint, ids string")
    several = pieces.repartition(parts, "seq").sortWithinPartitions("seq", "first").mapInArrow(_digests, "seq bigint, ends_sha256 string")
    single = found.where("n = 1").select("seq", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("ends_sha256"))
    return single.unionByName(several)


def cut(state: DataFrame, height: int) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The recursion down. state: seq, depth, length, token, size, n of distinct sequences, none longer than height.

    Returns the rows with tree (name of the prefix above the row) and level (half height of the cut that made this tree, height
    for the root), and by level the lower tries it made: name, seq (the least that goes through its cut), base (depth of the
    tree that was cut).
    """
    tables = [state.select(
        F.lit(_ROOT).alias("tree"), "seq", F.col("length").alias("rem"), F.col("depth").alias("pos"), "depth", (F.col("depth") == F.col("length")).alias("last"),
        "token", "size", "n", F.lit(height).alias("level"))]
    made, lower, half = [], {}, height // 2
    while half:
        long = _union([t.where(F.col("rem") > half) for t in tables])
        upper = F.col("pos") <= half
        name = F.unhex(F.md5(F.concat_ws(":", F.hex("tree"), F.lit(half).cast("string"), F.col("x1").cast("string"), F.col("x2").cast("string")).cast("binary")))
        names = settle(long.where(upper).groupBy("tree", "seq").agg(*_sums(), F.min(F.col("depth") - F.col("pos")).alias("base")).select("tree", "seq", name.alias("name"), "base"), "names")
        parts = settle(long.join(names.drop("base"), ["tree", "seq"]).select(
            F.when(upper, F.col("tree")).otherwise(F.col("name")).alias("tree"), "seq",
            F.when(upper, F.lit(half)).otherwise(F.col("rem") - half).alias("rem"), F.when(upper, F.col("pos")).otherwise(F.col("pos") - half).alias("pos"),
            "depth", "last", "token", "size", "n", F.when(upper, F.col("level")).otherwise(F.lit(half)).alias("level")), "halves")
        lower[half] = names.groupBy("name").agg(F.min("seq").alias("seq"), F.min("base").alias("base"))
        tables = [*[t.where(F.col("rem") <= half) for t in tables], parts]
        made.append(parts)
        half //= 2
    rows = settle(_union(tables).drop("rem", "pos"), "rows")
    for t in made:
        forget(t)
    return rows, lower


def graft(own: DataFrame, rows: DataFrame, lower: dict[int, DataFrame]) -> DataFrame:
    """The recursion up. own: tree, token, level, leaves, saved of each node alone; the same summed over subtrees, as addends."""
    log = [own]
    for half in sorted(lower):
        sums = _union([t.where(F.col("level") == half) for t in log]).groupBy("tree").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        path = lower[half].join(sums.withColumnRenamed("tree", "name"), "name").select(
            "seq", F.explode(F.sequence(F.col("base") + 1, F.col("base") + half)).alias("depth"), "leaves", "saved")
        above = path.join(rows.select("seq", "depth", "tree", "token", "level"), ["seq", "depth"])
        log.append(settle(above.groupBy(*_NODE, "level").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "grafts"))
    return _union([t.select(*own.columns) for t in log])


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences. convs: conv_id, length; rows: conv_id, depth, token, size of every turn (depth from 1).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and the node's last token.
    """
    spark = convs.sparkSession
    found, members = classes(convs, rows)
    digest = settle(ends(found, members), "ends")
    all_ = found.agg(F.min("seq"), F.sum("n"), F.max("length")).first()
    kind = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
            "ends_sha256 string, token binary")
    if all_[1] is None:
        return spark.createDataFrame([], kind)
    height = 1 << max(0, all_[2] - 1).bit_length()
    state = settle(rows.join(found.select(F.col("seq").alias("conv_id"), "length", "n"), "conv_id").withColumnRenamed("conv_id", "seq"), "state")
    rows, lower = cut(state, height)
    nodes = settle(rows.groupBy(*_NODE).agg(
        F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("depth").alias("depth"), F.max("level").alias("level"),
        F.max("size").alias("size"), F.max(F.when(F.col("last"), F.col("seq"))).alias("end")), "nodes")
    trees = nodes.groupBy("tree").agg(F.count("*").alias("n_children"), F.min("conv_id").alias("seq"), (F.max("depth") - 1).alias("depth"))
    parents = trees.where("depth > 0").join(rows.select("seq", "depth", F.col("tree").alias("up"), F.col("token").alias("up_token")), ["seq", "depth"])
    # the least conversation that goes on below a node need not be the node's least: some end there
    mothers = nodes.select(F.col("tree").alias("up"), F.col("token").alias("up_token"), F.col("conv_id").alias("parent_conv_id"))
    parents = settle(parents.join(mothers, ["up", "up_token"]).select("tree", "n_children", "up", "up_token", "parent_conv_id"), "parents")
    full = settle(nodes.join(parents.select(F.col("up").alias("tree"), F.col("up_token").alias("token"), "n_children"), _NODE, "left").fillna(0, ["n_children"]), "children")
    own = full.select(*_NODE, "level", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    log = graft(own, rows, lower)
    sums = log.groupBy(*_NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top = log.where(F.col("level") == height).agg(F.sum("leaves"), F.sum("saved")).first()
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = full.join(settle(sums, "sums"), _NODE).join(parents.select("tree", "parent_conv_id"), "tree", "left").join(
        digest.withColumnRenamed("seq", "end"), "end", "left")
    least, n, _ = all_
    children = nodes.where("depth = 1").count()
    turnless = found.where("length = 0").join(digest, "seq").first()
    root = spark.createDataFrame([(
        least, 0, None, n, children, top[0] if children else 1, top[1] or 0,
        turnless["ends_sha256"] if turnless else hashlib.sha256().hexdigest(), None)], kind)
    return root.unionByName(out.select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "token"))


def plain_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: conv_id, length; conv_id, depth, token, size."""
    rows = settle(numbered_turns(turns).withColumnRenamed("pos", "depth"), "plain")
    return rows.groupBy("conv_id").agg(F.max("depth").alias("length")), rows


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, without tokens."""
    return trie(*rebuilt(turns)).drop("token")


#: The same nodes by plain definitions: prefixes as text, every ancestor of every node.
SQL = """
with ordered as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first,
            md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
    from conversations where conv_id is not null),
crc_table as (
    select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end) as v
    from range(256) t(n)),
convs as (
    select conv_id, count(*) as own, conv_id - conv_id % 100 as base from ordered group by conv_id),
digits as (
    select conv_id, i, ascii(substr(conv_id::varchar, i::int, 1)) as b, length(conv_id::varchar) as n
    from convs, range(1, 21) t(i) where i <= length(conv_id::varchar)),
crc as (
    with recursive steps as (
        select conv_id, 0::bigint as i, 4294967295::bigint as c from convs
        union all
        select s.conv_id, s.i + 1, xor(t.v::bigint, s.c // 256)
        from steps s join digits d on d.conv_id = s.conv_id and d.i = s.i + 1 join crc_table t on t.n = xor(s.c % 256, d.b::bigint))
    select conv_id, xor(max_by(c, i), 4294967295) % 6 as h from steps group by conv_id),
plan as (
    select c.conv_id, c.own, c.base, h, least(h, coalesce(b.own, 0)) as taken
    from convs c join crc using (conv_id) left join convs b on b.conv_id = c.base),
seqs as (
    select p.conv_id, o.pos as depth, role, text from plan p join ordered o on o.conv_id = p.base and o.pos <= p.taken
    union all
    select p.conv_id, o.pos - p.h + p.taken, role, text from plan p join ordered o on o.conv_id = p.conv_id and o.pos > p.h),
prefixes as (
    select conv_id, depth, length(text) as size, string_agg(length(role)::varchar || ':' || length(text)::varchar || ':' || role || text, '') over (
        partition by conv_id order by depth) as prefix
    from seqs
    union all
    select conv_id, 0, 0, '' from convs),
nodes as (
    select depth, prefix, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size from prefixes group by depth, prefix),
steps as (
    select n.depth, n.prefix, u.depth as up_depth, u.prefix as up_prefix
    from nodes n join prefixes u on u.conv_id = n.conv_id and u.depth <= n.depth),
children as (
    select up_depth as depth, up_prefix as prefix, count(*) as n from steps where up_depth = depth - 1 group by all),
totals as (
    select up_depth as depth, up_prefix as prefix, sum((c.n is null)::int) as n_leaves, sum((n.n_convs - 1) * n.size) as saved
    from steps s join nodes n using (depth, prefix) left join children c using (depth, prefix) group by all),
lasts as (
    select conv_id, max(depth) as depth, max_by(prefix, depth) as prefix from prefixes group by conv_id),
ended as (
    select depth, prefix, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as h from lasts group by all)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0)::bigint as n_children,
    t.n_leaves::bigint as n_leaves, t.saved::bigint as saved_tokens, coalesce(e.h, sha256('')) as ends_sha256
from nodes n join totals t using (depth, prefix) left join children c using (depth, prefix) left join ended e using (depth, prefix)
left join steps s on s.depth = n.depth and s.prefix = n.prefix and s.up_depth = n.depth - 1
left join nodes u on u.depth = s.up_depth and u.prefix = s.up_prefix
"""
