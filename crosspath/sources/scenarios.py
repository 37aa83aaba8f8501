"""Scenario lists (one ego-target interaction per row) and class settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ANCHOR_METHODS, SCENARIO_COLUMNS, SCENARIO_INTEGERS
from ..staging import stage
from .tracks import DEFAULT_RECORDING


def check_scenarios(df: DataFrame) -> DataFrame:
    """Require the scenario columns, give ids and frames their types, keep everything else.

    Adds recording_id, input_ordinal (place in the list), base_xosc and anchor_frame when
    absent. A value that is not an integer raises, as in any ANSI cast. A list that gets its
    ordinals here is stored at once: evaluated again, its rows could be numbered otherwise.
    """
    missing = sorted(set(SCENARIO_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"scenario list: missing columns {missing}")
    typed = {c: F.col(c).cast("bigint") for c in SCENARIO_INTEGERS}
    typed["scenario_id"] = F.col("scenario_id").cast("string")
    typed["recording_id"] = (F.col("recording_id").cast("string") if "recording_id" in df.columns
                             else F.lit(DEFAULT_RECORDING))
    typed["anchor_frame"] = (F.col("anchor_frame").cast("double").cast("bigint") if "anchor_frame" in df.columns
                             else F.lit(None).cast("bigint"))
    numbered = "input_ordinal" in df.columns
    typed["input_ordinal"] = F.col("input_ordinal").cast("bigint") if numbered else F.monotonically_increasing_id()
    if "base_xosc" not in df.columns:
        typed["base_xosc"] = F.lit(None).cast("string")
    typed_list = df.withColumns(typed)
    return typed_list if numbered else stage(typed_list)


def read_scenarios(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scenario list from CSV; every column is read as text and cast explicitly.

    Ordinals follow file name, split and row. A split holds fewer than 2^33 rows.
    """
    rows = spark.read.csv(path, header=True)
    if "input_ordinal" in rows.columns:
        return check_scenarios(rows)
    placed = stage(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                               F.monotonically_increasing_id().alias("_row")))
    splits = placed.groupBy("_file", "_split").agg(F.min("_row").alias("_first"))
    splits = splits.withColumn("_number", F.row_number().over(Window.orderBy("_file", "_split")))      # one row per split
    ordinal = F.shiftleft((F.col("_number") - 1).cast("bigint"), 33) + F.col("_row") - F.col("_first")
    return check_scenarios(placed.join(splits, ["_file", "_split"]).select(*rows.columns, ordinal.alias("input_ordinal")))


def class_settings(spark: SparkSession, config: dict) -> DataFrame:
    """The per-class overrides as a relation (class, anchor, L, middle_cp_weight).

    A key a class leaves out stays NULL here and falls back to ``default`` in
    ``with_class_settings``. Unknown anchor methods raise here, before any job runs.
    """
    classes = config.get("classes") or {}
    for name, settings in {**classes, "default": config.get("default") or {}}.items():
        method = (settings or {}).get("anchor")
        if method is not None and method not in ANCHOR_METHODS:
            raise ValueError(f"settings of {name!r} name no known anchor method: {method!r} is not one of {ANCHOR_METHODS}")
    for name, settings in classes.items():
        for key in ("anchor", "L"):
            if {**(config.get("default") or {}), **{k: v for k, v in (settings or {}).items() if v is not None}}.get(key) is None:
                raise ValueError(f"neither class {name!r} nor the default sets {key!r}")

    def number(settings: dict, key: str) -> float | None:
        return None if settings.get(key) is None else float(settings[key])

    kinds = {"class": "string", "anchor": "string", "L": "double", "middle_cp_weight": "double"}
    rows = [(name, s.get("anchor"), number(s, "L"), number(s, "middle_cp_weight")) for name, s in ((n, c or {}) for n, c in classes.items())]
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    # As literals the relation has a known, small size, so Spark joins it without a shuffle.
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(row, kinds.items())]) for row in rows])))


def with_class_settings(scenarios: DataFrame, settings: DataFrame, default: dict) -> DataFrame:
    """Overlay ``default`` by the scenario's class, key by key: adds anchor, L_m, middle_cp_weight.

    A class that is not listed fails the job if the default lacks anchor or L.
    """
    def required(name: str, kind: str):
        lack = F.concat(F.lit(f"the default sets no {name!r}, needed by class "), F.coalesce("s.class", F.lit("null")))
        return F.coalesce(filled(name, kind), F.raise_error(lack).cast(kind))

    def filled(name: str, kind: str):
        return F.coalesce(F.col(f"cfg.{name}"), F.lit(default.get(name)).cast(kind))

    return (scenarios.alias("s").join(settings.alias("cfg"), F.col("s.class") == F.col("cfg.class"), "left")
            .select("s.*", required("anchor", "string").alias("anchor"), required("L", "double").alias("L_m"),
                    filled("middle_cp_weight", "double").alias("middle_cp_weight")))
