"""Store intermediate tables on reliable storage.

Lost executors then never replay a whole job, and several passes read one stored table.
Everything goes to the folder the cluster names in ``spark.checkpoint.dir``; a private one
is set only where there is none and all runs in one process (local runs and tests). Stored files outlive the session,
like any checkpoint; clean the folder when the job is done.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000
_tables: list[str] = []     # bucketed tables that are still in the catalog


def checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once (an eager, reliable checkpoint)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Materialize ``df`` once as Parquet, for results that grow with the data.

    Later reads take only the columns they need, are split anew, and know the true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_all(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """One table of all ``parts`` (equal columns, one at least), materialized one after another like ``store``, so the driver plans one at a time."""
    path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(path)
        schema = part.schema
        del part
        gc.collect()        # the listings in the JVM live as long as their DataFrame here
    return spark.read.schema(schema).parquet(path)


def stage_bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Materialize ``df`` as a parquet table bucketed by ``keys``.

    Joins on the keys read it without an exchange, and each reads only the columns it
    needs. Each task writes one bucket when ``df`` is already partitioned by the keys.
    """
    spark = df.sparkSession
    name = f"crosspath_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(bucket_count(spark), *keys)
     .option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name))
    _tables.append(name)
    table = spark.table(name)
    table._crosspath_table = name
    return table


def append_bucketed(table: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (same columns) added to a table of ``stage_bucketed``, in the same buckets."""
    spark = table.sparkSession
    name = table._crosspath_table
    more.select(*table.columns).write.insertInto(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a stored table: ``spark.crosspath.buckets``, else as many as shuffle partitions.

    A bucket is one scan task, so set it to the size of the tracks in use over that of a task.
    """
    return int(spark.conf.get("spark.crosspath.buckets", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def drop_tables(spark: SparkSession) -> None:
    """Take the bucketed tables of this process out of the catalog, once no result needs them any more."""
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (short rows of bounded width) marked for broadcast if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
