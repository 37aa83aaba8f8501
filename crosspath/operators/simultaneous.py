"""Same-frame pairing of ego and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import between
from ..schema import KEY
from .blocks import explode_blocks, salt_of
from .pairs import Prepared

_COMMON = """filter(transform(ego_samples, s -> struct(s as e, at_frame[s.frame] as t)),
    p -> p.t is not null and p.e.frame >= lo and p.e.frame <= hi)"""


def common_blocks(prep: Prepared, carry: list[str] = ()) -> DataFrame:
    """Blocks both windows touch, with an array ``both`` of the (ego, target) samples that
    share a frame: (KEY, carry, both)."""
    keep = list(dict.fromkeys(["ego", "target", "target_cover", *carry]))
    windows = prep.pairs.selectExpr(*KEY, *keep, "ego_cover as cover", "greatest(ego_lo, target_lo) as lo",
                                    "least(ego_hi, target_hi) as hi")
    ego = prep.chunks.selectExpr("recording_id", "track_id as ego", "block", "salt", "samples as ego_samples")
    target = prep.chunks.selectExpr("recording_id", "track_id as target", "block", "salt",
                                    "map_from_arrays(samples.frame, samples) as at_frame")
    rows = explode_blocks(windows).join(ego, ["recording_id", "ego", "block", "salt"]).selectExpr(
        *KEY, *keep, "lo", "hi", "block", f"{salt_of('block', 'target_cover')} as salt", "ego_samples")
    return (rows.join(target, ["recording_id", "target", "block", "salt"])
            .selectExpr(*KEY, *carry, f"{_COMMON} as both"))


def simultaneous_distance(prep: Prepared) -> DataFrame:
    """Distance of the two vehicles in every frame both have: (KEY, frame, distance)."""
    return common_blocks(prep).selectExpr(
        *KEY, f"inline(transform(both, p -> struct(p.e.frame as frame, {between('p.e', 'p.t')} as distance)))")


def min_simultaneous(prep: Prepared, carry: list[str] = ()) -> DataFrame:
    """Smallest same-frame distance, first frame among ties, with both positions there.

    (KEY, carry, nearest: struct<distance, frame, ego_x, ego_y, target_x, target_y>); an
    interaction without a common frame has no row.
    """
    found = f"""array_min(transform(both, p -> struct({between('p.e', 'p.t')} as distance, p.e.frame as frame,
        p.e.x as ego_x, p.e.y as ego_y, p.t.x as target_x, p.t.y as target_y))) as nearest"""
    return (common_blocks(prep, carry).selectExpr(*KEY, *carry, found).where("nearest is not null")
            .groupBy(*KEY, *carry).agg(F.expr("min(nearest) as nearest")))
