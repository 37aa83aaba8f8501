"""SimHash near-duplicates by a Gray-order hierarchical index.

Two fingerprints that differ in at most 3 of 64 bits agree on one of four 16-bit blocks.
Each distinct fingerprint is therefore filed four times, rotated so that another block
leads, and sorted by Gray rank. Neighbours in Gray order share long bit patterns, so a run
of them is one node that keeps the pattern all its members have in common (the AND and the
OR of the bits). Leaves hold up to 256 fingerprints, upper nodes up to 64 leaves. Whole
nodes are dropped as soon as the differences of their common bits exceed the limit, upper
nodes before leaves, leaves before members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, stored, with_python
from .components import components

BITS = 3            # fingerprints link at so many differing bits or fewer
SHINGLE = 3         # words
LEAF = 256          # fingerprints in a leaf
FANOUT = 64         # leaves in an upper node
_BLOCKS = 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased word shingles, as a signed number; 0 if there is no word."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        octets = hashes[part:part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with ``text`` replaced by its fingerprint ``fp`` (bigint)."""
    return with_python(docs, text, {"fp": T.LongType()}, lambda texts: [[fingerprint(t, width) for t in texts]], binary=True)


def gray_rank(code: Column) -> Column:
    """Position of a 64-bit codeword in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _rotated(code: Column, bits: int) -> Column:
    return F.shiftleft(code, bits).bitwiseOR(F.shiftrightunsigned(code, 64 - bits)) if bits else code


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The same groups as the links a-b, as links of each member to its group's smallest one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [(x, y) for x, y in pairs if x != y]
    return [x for x, _ in pairs], [y for _, y in pairs]


def _close_in_leaves(fps: np.ndarray, leaf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one leaf within the limit; ``leaf`` numbers the members, equal ones adjacent."""
    left, right = [], []
    index = np.arange(len(fps))
    step = 1
    while True:
        index = index[index + step < len(fps)]
        index = index[leaf[index] == leaf[index + step]]
        if not len(index):
            break
        near = index[np.bitwise_count(fps[index] ^ fps[index + step]) <= bits]
        left.append(near)
        right.append(near + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (index, index)


_LEAF_SCHEMA = T.StructType([
    T.StructField("block", T.IntegerType()), T.StructField("bucket", T.LongType()),
    T.StructField("upper", T.LongType()), T.StructField("leaf", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType())),
    T.StructField("all_and", T.LongType()), T.StructField("all_or", T.LongType()),
    T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType()))])


def _leaf_builder(bits: int, size: int, fanout: int):
    """Turns sorted (block, bucket, rank, fp) into leaves with the links inside them.

    Leaves that are a bucket of their own and hold no link are not written.
    """
    names = _LEAF_SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            block, bucket, rank, signed = (batch.column(i).to_numpy() for i in range(4))
            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1])])
            run_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
            place = np.arange(n) - first[run_of]
            start = place % size == 0
            leaf = np.cumsum(start) - 1
            begins = np.flatnonzero(start)
            ends = np.r_[begins[1:], n]
            fps = signed.view(np.uint64)
            x, y = _close_in_leaves(fps, leaf, bits)
            order = np.argsort(leaf[x], kind="stable")
            x, y = x[order], y[order]
            cut = np.searchsorted(leaf[x], np.arange(len(begins) + 1))
            run_length = np.diff(np.r_[first, n])
            out = []
            for k in np.flatnonzero((run_length[run_of[begins]] > size) | (run_of[begins] == 0)
                                    | (run_of[begins] == len(first) - 1) | (np.diff(cut) > 0)):
                at, members = begins[k], signed[begins[k]:ends[k]]
                upper = first[run_of[at]] + place[at] // (size * fanout) * (size * fanout)
                stars = _stars(signed[x[cut[k]:cut[k + 1]]], signed[y[cut[k]:cut[k + 1]]])
                out.append((int(block[at]), int(bucket[at]), int(rank[upper]), int(rank[at]), members.tolist(),
                            int(np.bitwise_and.reduce(members)), int(np.bitwise_or.reduce(members)), *stars))
            if out:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(),
                         pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _pair_linker(bits: int):
    """Links between the members of two leaves, as stars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column(0), batch.column(1)):
                one, two = (np.array(v.as_py(), np.int64) for v in (left, right))
                x, y = np.nonzero(np.bitwise_count(one.view(np.uint64)[:, None] ^ two.view(np.uint64)[None, :]) <= bits)
                more = _stars(one[x], two[y])
                a += more[0]
                b += more[1]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _differences(x: str, y: str) -> Column:
    """Bits in which all members of node x differ from all members of node y."""
    return F.expr(f"bit_count(({x}.all_and ^ {y}.all_and) & ~({x}.all_and ^ {x}.all_or) & ~({y}.all_and ^ {y}.all_or))")


def links(distinct: DataFrame, bits: int = BITS, size: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column ``fp``, distinct) within ``bits``.

    A group of close fingerprints comes out as stars around one member, not as all pairs.
    bits may be 0 to 3. No rows give no links.
    """
    if not 0 <= bits < _BLOCKS:
        raise ValueError(f"bits must be 0 to {_BLOCKS - 1}")
    filed = distinct.select("fp", F.inline(F.array(*[
        F.struct(F.lit(i).alias("block"), gray_rank(_rotated(F.col("fp"), 64 // _BLOCKS * i)).alias("rank"))
        for i in range(_BLOCKS)])))
    filed = filed.select("block", F.shiftrightunsigned("rank", 48).alias("bucket"), "rank", "fp")
    filed = filed.repartitionByRange("block", "bucket", "rank").sortWithinPartitions("block", "bucket", "rank")
    leaves = stored(filed.mapInArrow(_leaf_builder(bits, size, fanout), _LEAF_SCHEMA))
    inside = leaves.select(F.inline(F.arrays_zip("a", "b")))
    key = ["block", "bucket"]
    uppers = stored(leaves.groupBy(*key, "upper").agg(F.bit_and("all_and").alias("all_and"), F.bit_or("all_or").alias("all_or")))
    couples = (uppers.alias("x").join(uppers.alias("y"), key).where("x.upper <= y.upper").where(_differences("x", "y") <= bits)
               .select(*key, F.col("x.upper").alias("one"), F.col("y.upper").alias("two")))
    nodes = leaves.select(*key, "upper", "leaf", "fps", "all_and", "all_or")
    x, y = nodes.withColumnRenamed("upper", "one").alias("x"), nodes.withColumnRenamed("upper", "two").alias("y")
    close = (couples.join(x, [*key, "one"]).join(y, [*key, "two"]).where("x.leaf < y.leaf or one < two")
             .where(_differences("x", "y") <= bits).select(F.col("x.fps").alias("left"), F.col("y.fps").alias("right")))
    return inside.union(close.mapInArrow(_pair_linker(bits), "a bigint, b bigint"))


def _grouped(docs: DataFrame, bits: int, width: int) -> DataFrame:
    """(doc_id, key, fp, grp, component_id) per row; key tells the texts of equal doc_ids apart."""
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    marked = stored(fingerprints(keyed, "text", width))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = stored(components(links(distinct, bits), "a", "b"))
    rooted = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"))
    smallest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    alone = distinct.join(roots, distinct["fp"] == roots["node"], "left_anti").select("fp", F.col("fp").alias("grp"), "first_id")
    classes = stored(rooted.join(smallest, "root").select("fp", F.col("root").alias("grp"), "component_id").union(alone))
    return marked.join(classes, "fp")


def near_duplicates(docs: DataFrame, bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    fingerprint: 16 hex digits. component_id: the smallest doc_id that links of at most
    ``bits`` differing bits reach, the row's own included; null if all of them are null.
    Null and empty texts have fingerprint 0 and form a group like any other. Repeated rows
    and rows with equal doc_id come out once per row. Texts are used whole. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    return _grouped(docs, bits, width).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one row left of each group: that of the smallest doc_id.

    All columns are kept. Of several texts with this doc_id the one with the smallest hash
    stays, of repeated rows any one. A doc_id that is null comes after all others.
    """
    return keep_first(docs, stored(_grouped(docs, bits, width).select("doc_id", "key", "grp")))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each group; ``rows`` (doc_id, key, grp) name the group of every row of ``docs``."""
    keep = stored(rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("kept")))
    losers = stored(rows.join(keep, "grp").where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key"))))
                    .select("doc_id", "key").distinct())
    twins = stored(rows.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("its_key"))

    def found(side: DataFrame):
        return marked["id"].eqNullSafe(side["doc_id"]) & (marked["its_key"] == side["key"])

    kept = marked.join(losers.hint("merge"), found(losers), "left_anti")     # losers grow with the corpus
    if twins.isEmpty():
        return kept.select("row.*")
    once = kept.join(twins, found(twins), "left_semi").dropDuplicates(["id", "its_key"])
    return kept.join(twins, found(twins), "left_anti").union(once).select("row.*")
