"""Prefix trie of rebuilt conversations by composable fingerprints.

Conversations of one family share a head: a rebuilt conversation is the first turns of its family's
first conversation and then its own later turns. A sequence of turns has the product of its turns
in a monoid of affine maps as its fingerprint, (B^n, sum of turn_i * B^(n-i)) modulo 2^127 - 1. Products
compose, so prefix products of the conversations as they are stored give those of every
rebuilt prefix: head product times own product, less what the own head contributed. No rebuilt
text is ever made; a node refers to the stored turns.

Equal prefixes have equal (depth, fingerprint). That this holds the other way round is verified: all
members of a group must have the same parent and the same last turn, and all turns of one turn
hash the same role and text. If a check fails, everything is done again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .naming import beside

FAMILY = 5          # conv_ids that share the head of the first of them
HEADS = 9           # a head has 0 to HEADS - 1 turns
PIECE = 4096        # depths, or turns, of a conversation handled as one group
ENDS = 8192         # conv_ids in one piece of a list of ends
MODULUS = (1 << 127) - 1
_LOW = (1 << 64) - 1


def base_of(attempt: int) -> int:
    return int.from_bytes(hashlib.sha256(b"base of the products %d" % attempt).digest()[:15], "big") | 1


def _join(high: int, low: int) -> int:
    return high << 64 | low & _LOW


def _split(value: int) -> tuple[int, int]:
    low = value & _LOW
    return value >> 64, low - (1 << 64) if low >> 63 else low


def _turn(t1: int, t2: int) -> int:
    return ((t1 & _LOW) << 64 | t2 & _LOW) % MODULUS


_LONGS = T.LongType()


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _LONGS) for n in names])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


_SCANNED = ["pid", "conv_id", "i", "t1", "t2", "v1", "v2", "bytes", "end"]


def _scan(base: int):
    """Prefix products of sorted turns (conv_id, t1, t2, bytes) within a partition. The last row (end = 1)
    repeats the product of the conversation at the partition's end, which may go on in the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, conv, i, value, seen = TaskContext.get().partitionId(), None, 0, 0, False
        for batch in batches:
            out = []
            for c, t1, t2, size in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if c != conv or not seen:
                    conv, i, value, seen = c, 0, 0, True
                i, value = i + 1, (value * base + _turn(t1, t2)) % MODULUS
                out.append((pid, c, i, t1, t2, *_split(value), size, 0))
            yield _batch(out, _SCANNED)
        if seen:
            yield _batch([(pid, conv, i, 0, 0, *_split(value), 0, 1)], _SCANNED)

    return run


def _shift(base: int):
    """Adds what earlier partitions hold of the same conversation (before_i, before_1, before_2)."""
    names = ["conv_id", "i", "t1", "t2", "v1", "v2", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(c, before + i, t1, t2, *_split((_join(b1, b2) * pow(base, i, MODULUS) + _join(v1, v2)) % MODULUS), size)
                          for c, i, t1, t2, v1, v2, size, before, b1, b2 in zip(*[x.to_pylist() for x in batch.columns])], names)

    return run


def prefixes(turns: DataFrame, base: int) -> DataFrame:
    """(conv_id, i, t1, t2, v1, v2, bytes), stored: the i-th turn and the product of the first i turns.

    Turns are sorted over all partitions, so a conversation may be longer than a partition. One row
    per partition goes to the driver to chain the partitions.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions(*order)
    scanned = stored(placed.select("conv_id", "t1", "t2", "bytes").mapInArrow(_scan(base), _longs(*_SCANNED)))
    carry, open_conv, i, value = [], None, 0, 0
    for r in sorted(scanned.where("end = 1").select("pid", "conv_id", "i", "v1", "v2").collect()):
        if open_conv is not None:
            carry.append((r.pid, open_conv, i, *_split(value)))
        if r.conv_id == open_conv:      # the whole partition belongs to it
            i, value = i + r.i, (value * pow(base, r.i, MODULUS) + _join(r.v1, r.v2)) % MODULUS
        else:
            open_conv, i, value = r.conv_id, r.i, _join(r.v1, r.v2)
    carry = turns.sparkSession.createDataFrame(carry, _longs("pid", "conv_id", "before_i", "before_1", "before_2"))
    own = scanned.where("end = 0").join(carry, ["pid", "conv_id"], "left")
    columns = ["conv_id", "i", "t1", "t2", "v1", "v2", "bytes"]
    moved = own.where("before_i is not null").select(*columns, "before_i", "before_1", "before_2").mapInArrow(_shift(base), _longs(*columns))
    return stored(own.where("before_i is null").select(*columns).union(moved))


_NODE_ROWS = ["conv_id", "depth", "f1", "f2", "p1", "p2", "t1", "t2", "bytes", "is_end"]


def _compose(base: int):
    """One row per prefix of a rebuilt conversation from rows (conv_id, h, total, head, own, first):
    head: the family's turns it takes; own: turns of its own after its first h; at: the product of its own first h."""
    inverse = pow(base, -1, MODULUS)

    def row(conv: int, depth: int, value: int, t1: int, t2: int, size: int, total: int) -> tuple:
        parent = (value - _turn(t1, t2)) * inverse % MODULUS
        return (conv, depth, *_split(value), *_split(parent), t1, t2, size, int(depth == total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, h, total, head, own, a1, a2, root in zip(*[x.to_pylist() for x in batch.columns]):
                if root:
                    out.append((conv, 0, 0, 0, 0, 0, 0, 0, 0, int(total == 0)))
                value = 0
                for depth, x in enumerate(head, 1):
                    value = _join(x["v1"], x["v2"])
                    if root:
                        out.append(row(conv, depth, value, x["t1"], x["t2"], x["bytes"], total))
                less = value - (_join(a1, a2) if h else 0)
                for x in own:
                    k = x["i"] - h
                    whole = (less * pow(base, k, MODULUS) + _join(x["v1"], x["v2"])) % MODULUS
                    out.append(row(conv, len(head) + k, whole, x["t1"], x["t2"], x["bytes"], total))
            yield _batch(out, _NODE_ROWS)

    return run


def _rebuilt(turn_rows: DataFrame, base: int, family: int, heads: int) -> DataFrame:
    """(conv_id, depth, f1, f2, p1, p2, t1, t2, bytes, is_end), stored: every prefix of every rebuilt
    conversation with its fingerprint, its parent's, and its last turn."""
    near = heads - 1
    turn = "struct(i, t1, t2, v1, v2, bytes)"
    convs = stored(turn_rows.groupBy("conv_id").agg(
        F.max("i").alias("n"), F.expr(f"sort_array(collect_list({turn}) filter (where i <= {near}))").alias("near")))
    bases = convs.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"), F.col("near").alias("base_near"))
    built = convs.selectExpr("*", f"crc32(cast(cast(conv_id as string) as binary)) % {heads} as h", f"conv_id - conv_id % {family} as base_id")
    built = built.join(bases, "base_id", "left").selectExpr(
        "conv_id", "n", "h", "near", "slice(coalesce(base_near, array()), 1, cast(h as int)) as head").selectExpr(
        "*", "size(head) + greatest(n - h, 0L) as total", "try_element_at(near, cast(nullif(least(h, n), 0) as int)) as at")
    built = stored(built)
    columns = ["conv_id", "h", "total", "head", "own", "coalesce(at.v1, 0L) as a1", "coalesce(at.v2, 0L) as a2", "root"]
    close = built.selectExpr("*", "filter(near, x -> x.i > h) as own", "true as root").selectExpr(*columns)
    # Turns beyond the longest head are joined in pieces, so a very long conversation is not one group.
    pieces = built.where(f"n > {near}").selectExpr("conv_id", "h", "total", "head", "at", f"explode(sequence(0L, n div {PIECE})) as piece")
    far = (turn_rows.where(f"i > {near}").selectExpr("conv_id", f"i div {PIECE} as piece", f"array({turn}) as own")
           .join(pieces, ["conv_id", "piece"]).selectExpr("*", "false as root").selectExpr(*columns))
    return stored(close.union(far).mapInArrow(_compose(base), _longs(*_NODE_ROWS)))


_KEY = ["depth", "f1", "f2"]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (depth, f1, f2, ids) of lists to the SHA-256 of each whole list, piece by piece."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *at, ids in zip(*[x.to_pylist() for x in batch.columns]):
            if at != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = at, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _digests(done)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], names=[*_KEY, "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of nodes at which conversations end. Lists are built in pieces of a
    fixed range of conv_ids; the digest then streams over the pieces of a node."""
    pieces = rows.where("is_end = 1").groupBy(*_KEY, F.floor(F.col("conv_id") / F.lit(ENDS)).alias("piece")).agg(
        F.expr("array_join(sort_array(collect_list(conv_id)), ',')").alias("ids"))
    return stored(pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece").select(*_KEY, "ids")
                  .mapInArrow(_digest, "depth bigint, f1 bigint, f2 bigint, ends_sha256 string"))


def _subtrees(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, f1, f2, n_leaves, saved_tokens) for every node.

    The smallest member of a node is that of all nodes below it on its path, so each node belongs
    to one conversation, whose nodes are the end of its path. A node's sum over its subtree is the sum over
    its members of what they own, less what its own conversation owns above it.
    """
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max(F.expr("if(n_children = 0, 1L, 0L)")).alias("leaves"),
                                         F.max("depth").alias("last"))
    owned = stored(owned.where("saved > 0 or leaves > 0")).selectExpr("conv_id", "saved", "leaves", f"explode(sequence(0L, last div {PIECE})) as piece")
    sums = (rows.selectExpr("conv_id", *_KEY, f"depth div {PIECE} as piece").join(owned, ["conv_id", "piece"])
            .groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("below")))
    shared = nodes.where("saved > 0 or n_convs > 1").selectExpr("conv_id", *_KEY, "saved", f"depth div {PIECE} as piece")
    over = "over (partition by conv_id{} order by {} rows between unbounded preceding and 1 preceding)"
    pieces = (shared.groupBy("conv_id", "piece").agg(F.sum("saved").alias("total"))
              .selectExpr("conv_id", "piece", f"coalesce(sum(total) {over.format('', 'piece')}, 0L) as earlier"))
    above = (shared.selectExpr("*", f"coalesce(sum(saved) {over.format(', piece', 'depth')}, 0L) as within")
             .join(pieces, ["conv_id", "piece"]).selectExpr(*_KEY, "earlier + within as above"))
    return sums.join(above, _KEY, "left").selectExpr(*_KEY, "n_leaves", "if(above is null, 0L, below - above) as saved_tokens")


def _verified(turns: DataFrame, nodes: DataFrame) -> bool:
    """Turns of equal hash are equal, and members of a node have one parent and one last turn."""
    differ = " or ".join(f"min_{c} <> max_{c}" for c in ("p1", "p2", "t1", "t2"))
    if not nodes.where(differ).isEmpty():
        return False
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)]
    return turns.groupBy("t1", "t2").agg(*bounds).where("min_role <> max_role or min_text <> max_text").isEmpty()


def trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per distinct prefix of the rebuilt ``conversations`` (conv_id, turn, role, text, ...).

    Turns are in order of turn (null first), then role and text; null role or text is empty. The
    conversation c is rebuilt from the first h turns of conversation c - c % family (all if fewer, none if
    absent) and its own turns after its first h, with h = crc32(c) % heads. Columns: conv_id (smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Repeated rows are turns of their own. Rows without conv_id take no part. No rows give no nodes, not even a root.
    """
    raw = conversations.where("conv_id is not null").selectExpr(
        "cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    for attempt in count():
        turns = raw.selectExpr("*", *[f"xxhash64({2 * attempt + k}L, role, text) as t{k + 1}" for k in (0, 1)],
                               "cast(octet_length(text) as bigint) as bytes")
        rows = _rebuilt(prefixes(turns, base_of(attempt)), base_of(attempt), family, heads)
        bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("p1", "p2", "t1", "t2") for f in (F.min, F.max)]
        nodes = stored(rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                               F.max("bytes").alias("bytes"), *bounds))
        if _verified(turns, nodes):
            break
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("min_p1").alias("f1"), F.col("min_p2").alias("f2")).agg(
        F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, _KEY, "left").selectExpr(
        "conv_id", *_KEY, "min_p1 as p1", "min_p2 as p2", "n_convs", "coalesce(n_children, 0L) as n_children", "(n_convs - 1) * bytes as saved"))
    parents = nodes.selectExpr("conv_id as parent_conv_id", "depth + 1 as depth", "f1 as p1", "f2 as p2")
    named = beside(nodes, parents, ["depth", "p1", "p2"], F.xxhash64("f1", "f2"), "left")
    return (named.join(_subtrees(rows, nodes), _KEY, "left").join(_ends(rows), _KEY, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
                    F.coalesce("saved_tokens", F.lit(0)).cast("bigint").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def sql(family: int = FAMILY, heads: int = HEADS) -> str:
    """The same for DuckDB, from whole texts: every prefix is a list of (role, text)."""
    return f"""
with convs as (
    select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                         order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
    from conversations where conv_id is not null group by conv_id),
heads as (
    select *, conv_id - conv_id % {family} as base_id, xor(list_reduce(
        list_concat([4294967295::ubigint], list_transform(range(length(conv_id::varchar)), lambda i: ascii((conv_id::varchar)[i + 1])::ubigint)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
                                   lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)),
        4294967295::ubigint)::bigint % {heads} as h
    from convs),
rebuilt as (
    select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns
    from heads c left join convs b on b.conv_id = c.base_id),
members as (
    select conv_id, unnest(range(len(turns) + 1)) as depth, turns from rebuilt),
nodes as (
    select depth, turns[1:depth] as path, min(conv_id) as conv_id, count(*) as n_convs,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(turns) = depth), '')) as ends_sha256
    from members group by all),
children as (
    select depth - 1 as depth, path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by all),
counted as (
    select n.*, coalesce(c.n_children, 0) as n_children,
           case when n.depth = 0 then 0 else (n.n_convs - 1) * strlen(n.path[n.depth].text) end as saved
    from nodes n left join children c using (depth, path)),
below as (
    select depth as at, path, n_children, saved, unnest(range(depth + 1)) as depth from counted),
sums as (
    select depth, path[1:depth] as path, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
    from below group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from counted n join sums s using (depth, path) left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]
"""
