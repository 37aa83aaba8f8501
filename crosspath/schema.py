"""Relations of the engine: column names and types.

Everything is keyed by recording, so one job can span any number of recordings:
a track is ``(recording_id, track_id)`` and an interaction is ``KEY``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# One ego-target interaction. input_ordinal is its place in the scenario list.
KEY = ["recording_id", "scenario_id", "input_ordinal"]

RAW_TRACK_COLUMNS = ["trackId", "frame", "xCenter", "yCenter", "heading",
                     "xVelocity", "yVelocity", "length", "width"]

TRACK_SCHEMA = T.StructType(
    [T.StructField("recording_id", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("track_id", "frame")]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "heading", "speed", "length", "width")]
)

# Payload of one track sample. The order is also the tie order that decides which
# of several rows for the same (track, frame) is kept.
SAMPLE_FIELDS = ["x", "y", "heading", "speed", "length", "width"]

SCENARIO_COLUMNS = ["scenario_id", "class", "ego", "target", "min_frame", "max_frame"]
SCENARIO_INTEGERS = ["ego", "target", "min_frame", "max_frame"]

ANCHOR_METHODS = ("pet", "cross", "min_dist")

PARAMETERS = ["theta1_deg", "theta2_deg", "end_speed_kmh"]

# Fixed values of the method.
FPS = 30.0
CONFLICT_THRESHOLD = 2.0
CONTROL_POINT_WEIGHT = 5.0
RUN_MARGIN_S = 1.0
DRAWS_PER_CLASS = 1000
SEED = 2026
