"""Exact integer names for keys, by sorting: equal keys get one name, different keys never share one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SALTS = 1024        # a key may spread over so many pieces of the sort
SPLIT = 64          # parts of a hot group in ``with_totals``


def _changes(column: pa.Array, last: object) -> np.ndarray:
    """Per row: is the value another one than in the row before (``last`` before the first)?"""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    if last is not None:
        out[0] = column[0].as_py() != last
    return out


def _namer(keys: list[str], spread: int, carried: list[str], schema: pa.Schema):
    """Names the runs of sorted rows. A run whose first ``spread`` keys are the first or the last ones
    of its partition may go on in another partition; its keys come out once more as a border row."""
    def border(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.nulls(len(rows), schema.field(c).type) for c in carried]
        columns.append(pa.array([r[0] for r in rows], pa.int64()))
        columns += [pa.array([r[1 + i] for r in rows], schema.field(k).type) for i, k in enumerate(keys)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (TaskContext.get().partitionId() << 33) - 1
        last: list = [None] * len(keys)
        at_first, tail = True, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            changed = [_changes(c, v) for c, v in zip(columns, last)]
            starts = np.logical_or.reduce(changed)
            names = name + np.cumsum(starts)
            begun = np.flatnonzero(starts)
            moved = np.flatnonzero(np.logical_or.reduce(changed[:spread]))     # rows where the place, not only the key, is another
            if last[0] is None:
                moved = moved[1:]
            keyed = [(int(names[i]), *[c[int(i)].as_py() for c in columns])
                     for i in begun if at_first and not (len(moved) and i >= moved[0])]
            if len(moved):
                at_first, tail = False, []
            tail += [(int(names[i]), *[c[int(i)].as_py() for c in columns]) for i in begun if not len(moved) or i >= moved[-1]]
            name, last = int(names[-1]), [c[n - 1].as_py() for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried] + [pa.array(names, pa.int64())] + [pa.nulls(n, schema.field(k).type) for k in keys], schema=schema)
            if keyed:
                yield border(keyed)
        if tail:
            yield border(tail)

    return run


def named(rows: DataFrame, keys: list[str], spread: int, salt: Column) -> DataFrame:
    """``rows`` with the columns ``keys`` (no nulls) replaced by their integer ``name``, stored.

    Rows are sorted by the keys over all partitions and numbered where the keys change. Only the
    first ``spread`` keys and ``salt`` choose the partition, so a key that very many rows share is
    dealt over several neighbouring ones. What such runs are called there is made equal afterwards:
    every partition tells the keys at its two ends, a few rows each, and the smallest name holds.
    """
    carried = [c for c in rows.columns if c not in keys]
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in carried] + [T.StructField("name", T.LongType())]
                          + [T.StructField(k, types[k]) for k in keys])
    arrow = pa.schema([(f.name, {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}[type(f.dataType)])
                       for f in schema.fields])
    placed = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS))).repartitionByRange(*keys[:spread], "_salt").drop("_salt")
    numbered = stored(placed.sortWithinPartitions(*keys).mapInArrow(_namer(keys, spread, carried, arrow), schema))
    borders = numbered.where(F.col(keys[0]).isNotNull())
    least = borders.groupBy(*keys).agg(F.min("name").alias("least"), F.count("*").alias("ends")).where("ends > 1")
    alias = stored(borders.join(least, keys).where("name <> least").select("name", "least").distinct())
    return (numbered.where(F.col(keys[0]).isNull()).join(alias, "name", "left")
            .select(*carried, F.coalesce("least", "name").alias("name")))


def beside(rows: DataFrame, table: DataFrame, keys: list[str], part: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (at most one row per key), with hot keys split over SPLIT parts.

    ``part`` must differ among the rows of a key. The table's row is first copied to the parts
    that occur, so no task gets all rows of a key, and nothing depends on the size of the table.
    """
    parted = rows.withColumn("_part", F.pmod(part, F.lit(SPLIT)))
    copies = parted.select(*keys, "_part").distinct().join(table, keys)
    return parted.join(copies, [*keys, "_part"], how).drop("_part")


def with_totals(rows: DataFrame, keys: list[str], part: Column, **totals: Column) -> DataFrame:
    """``rows`` with aggregates of all rows of equal ``keys``; combined before each shuffle, as in ``beside``."""
    return beside(rows, rows.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()]), keys, part)
