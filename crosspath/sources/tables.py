"""Stage tables between the steps: parameters and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write parameters or samples: parquet partitioned by class (lossless), or csv with header."""
    if fmt == "parquet":
        df.write.mode("overwrite").partitionBy("class").parquet(path)
    elif fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown table format {fmt!r}; choose from ('parquet', 'csv')")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read a stage table back. CSV needs the schema (``df.schema`` of what was written);
    doubles are written with enough digits to come back unchanged."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        if schema is None:
            raise ValueError("reading csv needs a schema")
        return spark.read.schema(schema).csv(path, header=True)
    raise ValueError(f"unknown table format {fmt!r}; choose from ('parquet', 'csv')")
