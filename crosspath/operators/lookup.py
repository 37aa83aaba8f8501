"""Frame lookups on a window track: exact and nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .blocks import IN_WINDOW, TRACK_BLOCK, block_of, salt_of


def sample_at(rows: DataFrame, chunks: DataFrame, frame: str, out: str) -> DataFrame:
    """Add the target sample of exactly ``frame`` inside [target_lo, target_hi] as struct ``out``.

    At most one block can hold it, so this is one left equi-join and no aggregation.
    """
    blocks = chunks.selectExpr("recording_id", "track_id as target", "block", "salt", "samples")
    hit = f"get(filter(samples, s -> s.frame = {frame} and s.frame between target_lo and target_hi), 0) as {out}"
    return (rows.selectExpr("*", f"{block_of(frame)} as block").selectExpr("*", f"{salt_of('block', 'target_cover')} as salt")
            .join(blocks, ["recording_id", "target", "block", "salt"], "left").selectExpr(*rows.columns, hit))


# The blocks that can hold the sample nearest to frame ``at``: its own, and the nearest existing one on either side.
_AROUND = """array_compact(array(
    if(exists(cover.runs, r -> mid between r.from and r.to), mid, null),
    array_max(transform(filter(cover.runs, r -> r.from < mid), r -> least(r.to, mid - 1))),
    array_min(transform(filter(cover.runs, r -> r.to > mid), r -> greatest(r.from, mid + 1)))))"""


def nearest_sample(windows: DataFrame, chunks: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Sample nearest in time to frame ``at`` of each window row; ties go to the lower frame.

    windows: (KEY, carry, track_id, lo, hi, cover, at), a row per (KEY, carry).
    Result: (KEY, carry, near: struct<gap, frame, x, y>). At most three blocks of a window are opened.
    """
    near = "array_min(transform(samples, s -> struct(abs(s.frame - at) as gap, s.frame as frame, s.x as x, s.y as y))) as near"
    probes = (windows.where("at is not null").selectExpr("*", f"{block_of('at')} as mid").selectExpr("*", f"explode({_AROUND}) as block")
              .where(f"block between {block_of('lo')} and {block_of('hi')}").selectExpr("*", f"{salt_of('block', 'cover')} as salt"))
    return (probes.join(chunks, TRACK_BLOCK).selectExpr(*KEY, *carry, "at", f"{IN_WINDOW} as samples").selectExpr(*KEY, *carry, near)
            .groupBy(*KEY, *carry).agg(F.expr("min(near) as near")))
