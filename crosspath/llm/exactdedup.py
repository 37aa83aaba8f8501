"""Exact duplicates by deterministic block naming.

The normalised text is cut into blocks of BLOCK bytes. All blocks are sorted, and equal blocks
get one integer as their name; then neighbouring names are paired, and the pairs are sorted and
named, until every text has a single name. A name stands for exactly one content, because blocks
and pairs are compared and not only hashed, so texts are equal if and only if their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .naming import named, with_totals
from .simhash import _LOWER

BLOCK = 1024        # bytes
_PARTS = 4 << 20    # bytes of blocks in a batch

_BLOCKS = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sha", pa.binary()), ("pos", pa.int64()),
                     ("hash", pa.int64()), ("block", pa.binary())])


def _cut(size: int):
    """Texts to rows of blocks; an empty text is one empty block. The digest goes with the first block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            texts = batch.column("text").cast(pa.binary())
            for rid, doc_id, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), texts):
                text = (text.as_py() or b"").translate(_LOWER)
                n = max(1, -(-len(text) // size))
                for pos in range(n):
                    block = text[pos * size:(pos + 1) * size]
                    rows.append((rid, doc_id, n, None if pos else hashlib.sha256(text).digest(), pos,
                                 xxhash.xxh64_intdigest(block) - (1 << 63), block))
                    held += len(block)
                    if held >= _PARTS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)

    return run


def identities(texts: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rid, doc_id, sha, level, name) per row of ``texts`` (rid, doc_id, text): rid tells rows apart,
    (level, name) is the text's identity."""
    kinds = T.StructType([T.StructField(f.name, T.BinaryType() if pa.types.is_binary(f.type) else T.LongType()) for f in _BLOCKS])
    # The hash only puts the blocks in an order that sorts fast and spreads evenly; equality is that of the blocks.
    blocks = stored(named(texts.mapInArrow(_cut(size), kinds), ["hash", "block"], 1, F.xxhash64("rid", "pos")))
    heads = blocks.where("pos = 0").select("rid", "doc_id", "sha", F.lit(0).alias("level"), "name", "n")
    rows = blocks.where("n > 1").select("rid", "n", "pos", "name")
    done, level, left = [], 0, blocks.agg(F.max("n")).first()[0] or 0
    while left > 1:
        level, left = level + 1, -(-left // 2)
        pairs = rows.groupBy("rid", F.expr("(n + 1) div 2").alias("n"), F.expr("pos div 2").alias("pos")).agg(
            F.expr("max(name) filter (where pos % 2 = 0)").alias("one"), F.expr("coalesce(max(name) filter (where pos % 2 = 1), -1L)").alias("two"))
        rows = stored(named(pairs, ["one", "two"], 2, F.xxhash64("rid", "pos")))
        done.append(rows.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        rows = rows.where("n > 1")
    result = heads.where("n = 1").drop("n")
    if done:
        longer = done[0]
        for more in done[1:]:
            longer = longer.union(more)
        result = result.union(heads.where("n > 1").select("rid", "doc_id", "sha").join(longer, "rid").select("rid", "doc_id", "sha", "level", "name"))
    return result


def duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text, ...).

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of
    equal texts the row with the largest doc_id stays (any one of repeated rows; a row whose doc_id
    is null only if all are), and keep_id names it. group_size counts the rows of the group.
    Texts are used whole. An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stored(identities(texts, size))
    last = F.max(F.struct("doc_id", "rid"))
    grouped = with_totals(rows, ["level", "name"], F.xxhash64("rid"), last=last, group_size=F.count("*"))
    return grouped.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept"),
                          F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that ``duplicates`` keeps, with all their columns; of repeated rows one."""
    wrapped = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")))
    rows = stored(identities(wrapped.select("rid", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text")), size))
    keep = stored(rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("last")).select(F.col("last.rid").alias("rid")))
    return wrapped.join(keep, "rid", "left_semi").select("row.*")


SQL = """
with texts as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
placed as (
    select *, row_number() over (partition by t order by doc_id desc nulls last) as place from texts)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       place = 1 as kept, sha256(t) as text_sha256
from placed
"""
