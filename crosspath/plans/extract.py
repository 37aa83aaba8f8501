"""Step 1: recorded interactions to conflict-anchored parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.anchors import find_anchor
from ..operators.circle import disk_points
from ..operators.pairs import Prepared, prepare
from ..operators.theta import theta_geometry
from ..schema import CONFLICT_THRESHOLD, FPS, KEY
from ..sources.scenarios import class_settings, with_class_settings
from ..staging import store

POINT_COLUMNS = ["qc_x", "qc_y", "qm_x", "qm_y", "t_in_frame", "qp_x", "qp_y", "t_out_frame"]
ANGLE_COLUMNS = ["u1_x", "u1_y", "u1_source", "L1", "L2", "theta1_deg", "theta2_deg"]
KMH = 3.6


def configured(scenarios: DataFrame, config: dict) -> DataFrame:
    """Scenarios with their class settings (anchor, L_m, middle_cp_weight)."""
    return with_class_settings(scenarios, class_settings(scenarios.sparkSession, config), config.get("default") or {})


def prepare_configured(tracks: DataFrame, scenarios: DataFrame) -> Prepared:
    """``pairs.prepare`` with the settings the anchor search and the circle need on each pair."""
    return prepare(tracks, scenarios, keep=["anchor", "anchor_frame", "L_m"])


def anchored_pairs(prep: Prepared, config: dict) -> DataFrame:
    """Pairs that have an anchor, with anchor_kind, anchor_frame and radius."""
    anchors = find_anchor(prep, float(config.get("conflict_threshold", CONFLICT_THRESHOLD)), float(config.get("fps", FPS)))
    pairs = prep.pairs.select(*KEY, "target", "target_lo", "target_hi", "target_cover", "target_first", F.col("L_m").alias("radius"))
    return pairs.join(anchors, KEY)


def extract_params(tracks: DataFrame, scenarios: DataFrame, config: dict) -> DataFrame:
    """One row per scenario: its columns, the class settings used, a status, and as much of
    anchor, points, angles and end speed as could be determined."""
    scenarios = configured(scenarios, config)
    prep = prepare_configured(tracks, scenarios)
    points = store(disk_points(anchored_pairs(prep, config), prep.chunks))
    angles = theta_geometry(points.where("status = 'ok'"), prep.chunks).select(*KEY, *ANGLE_COLUMNS)
    found = points.selectExpr(*KEY, "anchor_kind", "anchor_frame as found_frame", "status", *POINT_COLUMNS, "at.speed as speed")
    gate = prep.pairs.selectExpr(*KEY, "true as paired")
    rows = scenarios.join(gate, KEY, "left").join(found.join(angles, KEY, "left"), KEY, "left")
    computed = [*KEY, "anchor", "anchor_frame", "L_m", "middle_cp_weight"]
    passed = [c for c in scenarios.columns if c not in computed]
    final = """case when paired is null then 'no_track' when status is null then 'no_anchor'
        when status = 'ok' and L1 is null then 'degenerate_geometry' else status end as final"""
    return rows.selectExpr("*", final).selectExpr(
        *KEY, *passed, "if(anchor_kind = 'given', 'given', anchor) as anchor_method", "L_m", "final as status",
        "anchor_kind", "coalesce(found_frame, anchor_frame) as anchor_frame", *POINT_COLUMNS, *ANGLE_COLUMNS,
        f"case when final = 'ok' then speed * {KMH}D end as end_speed_kmh",
        "case when final = 'ok' then middle_cp_weight end as middle_cp_weight")


def status_counts(params: DataFrame) -> DataFrame:
    """How many scenarios ended in each status."""
    return params.groupBy("status").agg(F.count("*").alias("n"))
