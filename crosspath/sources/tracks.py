"""Track sources: recorded samples in the levelXdata column layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import norm
from ..schema import RAW_TRACK_COLUMNS

DEFAULT_RECORDING = "0"


def scan_tracks(df: DataFrame, track_ids: DataFrame | list[int] | None = None) -> DataFrame:
    """The nine track columns (plus recording_id if present), limited to ``track_ids``.

    A list becomes a pushed-down IN filter; a DataFrame of (track_id[, recording_id])
    becomes a semi-join, which also works when the id set is large.
    """
    if track_ids is None:
        pass
    elif isinstance(track_ids, DataFrame):
        ids = track_ids.withColumnRenamed("track_id", "trackId")
        df = df.join(ids, [c for c in ids.columns if c in ("recording_id", "trackId")], "left_semi")
    else:
        df = df.where(F.col("trackId").isin([int(i) for i in track_ids]))
    lead = ["recording_id"] if "recording_id" in df.columns else []
    return df.select(*lead, *RAW_TRACK_COLUMNS)


def normalize_tracks(raw: DataFrame, recording_id: str | Column | None = None) -> DataFrame:
    """Raw track columns to the engine's track relation; speed is the velocity's length."""
    if recording_id is None:
        rec = F.col("recording_id") if "recording_id" in raw.columns else F.lit(DEFAULT_RECORDING)
    else:
        rec = recording_id if isinstance(recording_id, Column) else F.lit(recording_id)
    speed = norm("cast(xVelocity as double)", "cast(yVelocity as double)")
    return raw.select(rec.alias("recording_id"), *map(F.expr, (
        "cast(trackId as bigint) as track_id", "cast(frame as bigint) as frame", "cast(xCenter as double) as x",
        "cast(yCenter as double) as y", "cast(heading as double) as heading", f"{speed} as speed",
        "cast(length as double) as length", "cast(width as double) as width")))


def read_tracks(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet",
    track_ids: DataFrame | list[int] | None = None, recording_pattern: str | None = None,
) -> DataFrame:
    """Read one or many recordings (parquet or csv) as the normalized track relation.

    ``recording_pattern`` is a regular expression with one group, applied to the file
    path, that names the recording (for files like ``07_tracks.csv``). Without it the
    files must have a recording_id column or hold a single recording.
    """
    if fmt == "parquet":
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif fmt == "csv":
        raw = spark.read.csv(path, header=True)
        raw = raw.select(*[_numeric(c) for c in raw.columns])
    else:
        raise ValueError(f"unknown track format {fmt!r}; choose from ('parquet', 'csv')")
    if recording_pattern is not None:
        raw = raw.withColumn("recording_id", F.regexp_extract(F.col("_metadata.file_path"), recording_pattern, 1))
    return normalize_tracks(scan_tracks(raw, track_ids))


def _numeric(name: str) -> Column:
    """CSV columns arrive as text; the columns in use get their type, others are pruned anyway."""
    if name in ("trackId", "frame"):
        return F.col(name).cast(T.LongType()).alias(name)
    return F.col(name).cast(T.DoubleType()).alias(name) if name in RAW_TRACK_COLUMNS else F.col(name)
