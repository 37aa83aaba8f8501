"""What the operators share: stored tables, row keys, and columns computed in Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import checkpoint_folder

# One word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and lets later joins see the true size of a
    side and split its large partitions.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*columns: Column | str) -> Column:
    """64-bit hash of the columns that tells a null from any value."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def same(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> Column:
    """Join condition: equal in all columns, nulls equal to nulls."""
    condition = None
    for c in columns:
        one = left[c].eqNullSafe(right[c])
        condition = one if condition is None else condition & one
    return condition


def with_python(df: DataFrame, source: str, fields: dict[str, T.DataType],
                compute: Callable[[list], Iterable[Iterable]], binary: bool = False) -> DataFrame:
    """``df`` without column ``source``, plus the columns that ``compute`` makes of it.

    compute gets the values of a batch (with binary=True as UTF-8 bytes) and returns one
    sequence per field. All other columns pass through untouched, as Arrow arrays.
    """
    kept = [c for c in df.columns if c != source]
    schema = T.StructType([f for f in df.schema.fields if f.name != source]
                          + [T.StructField(name, kind) for name, kind in fields.items()])
    kinds = [to_arrow_type(kind) for kind in fields.values()]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(source)
            values = values.cast(pa.binary()) if binary else values
            made = compute(values.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept]
                                             + [pa.array(x, kind) for x, kind in zip(made, kinds)], names=names)

    return df.mapInArrow(run, schema)
