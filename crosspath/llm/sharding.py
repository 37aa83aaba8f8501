"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots that never change. A small versioned table maps
slots to shards. It is made from the bytes of each slot, and edited, slot by slot, when the
shards are rebalanced; only the records of moved slots move.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, stored

SLOTS = 4096
SHARDS = 24
_PARTS = 64             # of a slot, for row numbers
_PIECE = 1 << 16        # places of a mass of repeated rows that are listed at once


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, key, virtual_slot, part, copies): the distinct records of ``docs`` (doc_id, text, ...)."""
    text = F.col("text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
                       F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"), row_key("doc_id", "text").alias("key"))
    rows = rows.withColumns({"virtual_slot": F.pmod("key", F.lit(slots)).cast("int"),
                             "part": F.pmod(F.shiftright("key", 32), F.lit(_PARTS)).cast("int")})
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def plan(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """Version 0 of the map, rows (version, virtual_slot, shard): largest slots first, each to the lightest shard."""
    heap = [(0, 0, s) for s in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        load, n, shard = heapq.heappop(heap)
        out.append((0, slot, shard))
        heapq.heappush(heap, (load + slot_bytes.get(slot, 0), n + 1, shard))
    return sorted(out)


def rebalance(current: list[tuple[int, int, int]], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.02) -> list[tuple[int, int, int]]:
    """The next version of the map for the bytes of today and ``shards`` shards.

    Moves slots from the heaviest to the lightest shard, each time the largest one that
    makes their difference smaller, until the heaviest is within ``tolerance`` of the mean
    or no move helps. Slots of shards that are given up all move. Others stay.
    """
    held: dict[int, set[int]] = {s: set() for s in range(shards)}
    load = dict.fromkeys(held, 0)
    orphans = []
    for _, slot, shard in current:
        if shard in held:
            held[shard].add(slot)
            load[shard] += slot_bytes.get(slot, 0)
        else:
            orphans.append(slot)

    def move(slot: int, shard: int) -> None:
        held[shard].add(slot)
        load[shard] += slot_bytes.get(slot, 0)

    for slot in sorted(orphans, key=lambda s: (-slot_bytes.get(s, 0), s)):
        move(slot, min(load, key=lambda s: (load[s], s)))
    mean = sum(load.values()) / shards
    while True:
        heavy, light = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fitting = [s for s in held[heavy] if 0 < slot_bytes.get(s, 0) < gap]
        if load[heavy] <= mean * (1 + tolerance) or not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        held[heavy].remove(slot)
        load[heavy] -= slot_bytes[slot]
        move(slot, light)
    version = max((v for v, _, _ in current), default=-1) + 1
    return sorted((version, slot, shard) for shard, its in held.items() for slot in its)


def map_table(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """A map as a table (version, virtual_slot, shard) of as many rows as there are slots."""
    columns = list(zip(*rows))
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("version", "virtual_slot", "shard"), columns)}))


def write_map(spark: SparkSession, folder: str, rows: list[tuple[int, int, int]]) -> None:
    """Add a version to the stored maps; a version that exists is an error."""
    map_table(spark, rows).coalesce(1).write.parquet(f"{folder}/v{rows[0][0]:06d}")


def read_map(spark: SparkSession, folder: str, version: int) -> list[tuple[int, int, int]]:
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/v{version:06d}").collect())     # one row per slot


def slot_sizes(recs: DataFrame) -> dict[int, int]:
    """Bytes per slot: at most as many rows as there are slots reach the driver."""
    return {r[0]: r[1] for r in recs.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies"))).collect()}


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, current: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) per row of ``docs``.

    size: UTF-8 bytes of the text plus 8. law: ``bytes``, the shards hold nearly equal bytes.
    slot: place of the row in its shard, from 0 without gaps. ``current``: the map to use,
    version 0 of a new one if none. Null texts count as empty. Null doc_ids are a value.
    Repeated rows go to one shard and get places of their own. An empty table gives an empty
    result. Other columns are not read.
    """
    recs = stored(records(docs, slots))
    chosen = current or plan(slot_sizes(recs), shards, slots)
    where = F.broadcast(stored(map_table(docs.sparkSession, chosen)))           # one row per slot
    cut = ["virtual_slot", "part"]
    parts = recs.groupBy(*cut).agg(F.sum("copies").alias("rows")).join(where, "virtual_slot")
    before = W.partitionBy("shard").orderBy(*cut).rowsBetween(W.unboundedPreceding, -1)
    parts = stored(parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows"))
    inside = W.partitionBy(*cut).orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = recs.join(parts, cut).withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    # A record's copies take consecutive places, listed piece by piece: no array grows with their number.
    pieces = placed.withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_PIECE})")))
    places = F.expr(f"sequence(first + piece * {_PIECE}, first + least(copies, (piece + 1) * {_PIECE}) - 1)")
    return pieces.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.explode(places).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
