"""Hand-made tracks and scenarios for the unit tests."""

from crosspath.schema import TRACK_SCHEMA
from crosspath.sources.scenarios import check_scenarios

CONFIG = {"fps": 10.0, "conflict_threshold": 2.0, "default": {"anchor": "pet", "L": 10.0},
          "classes": {"cross": {"anchor": "cross"}, "near": {"anchor": "min_dist"}, "tiny": {"anchor": "cross", "L": 0.5},
                      "heavy": {"middle_cp_weight": 8.0}}}


def straight(track, start, step, frames, heading, recording="r", length=4.0, width=2.0):
    """A vehicle that moves by ``step`` per frame from ``start``."""
    speed = 10 * (step[0] ** 2 + step[1] ** 2) ** 0.5
    return [(recording, track, f, start[0] + step[0] * i, start[1] + step[1] * i, float(heading), speed, length, width)
            for i, f in enumerate(frames)]


def tracks(spark, *parts):
    return spark.createDataFrame([row for part in parts for row in part], TRACK_SCHEMA)


def scenarios(spark, rows):
    """rows: (scenario_id, class, ego, target, min_frame, max_frame, anchor_frame)."""
    schema = ("recording_id string, scenario_id string, class string, ego bigint, target bigint, min_frame bigint, "
              "max_frame bigint, anchor_frame bigint, input_ordinal bigint")
    return check_scenarios(spark.createDataFrame([("r", *row, i) for i, row in enumerate(rows)], schema))
