"""Circular window around the conflict anchor.

Walking the target track away from the anchor sample q_c, q_in (backward in time) and
q_out (forward) are the first points at distance L, interpolated on the segment that
leaves the circle, so both chords have length L.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import circle_fraction, distance, point_gap_sq, point_reach_sq
from ..schema import KEY
from ..staging import store
from .blocks import IN_WINDOW, TRACK_BLOCK, block_of, boxes, in_blocks, opened, salt_of
from .closest import SLACK
from .lookup import sample_at


def _points(samples: str) -> str:
    return f"transform({samples}, s -> struct(s.frame as frame, s.x as x, s.y as y))"


def crossing_blocks(circle: DataFrame, chunks: DataFrame) -> DataFrame:
    """Window rows of the blocks that can hold the first sample outside the circle on either side.

    Found from the boxes alone: a block whose farthest corner is inside has none, and the search ends at the
    nearest block on either side that is wholly outside.
    """
    windows = circle.where("at is not null").selectExpr(
        *KEY, "target as track_id", "target_lo as lo", "target_hi as hi", "target_cover as cover", "at", "radius")
    box, limit = "struct(x0, x1, y0, y1)", f"radius * radius * {1 - SLACK}D"
    sure = f"{point_gap_sq('at', box)} >= radius * radius * {1 + SLACK}D"
    rows = store(in_blocks(windows, boxes(chunks)).where(f"{point_reach_sq('at', box)} >= {limit}").selectExpr(
        *TRACK_BLOCK, *[k for k in KEY if k not in TRACK_BLOCK], "lo", "hi", "f0", "f1", "at", "radius",
        f"{sure} and f1 < at.frame and f1 >= lo as before", f"{sure} and f0 > at.frame and f0 <= hi as after"))
    ends = rows.groupBy(*KEY).agg(F.expr("max(block) filter (where before) as first_block"), F.expr("min(block) filter (where after) as last_block"))
    return rows.drop("before", "after").join(ends, KEY).where("block >= coalesce(first_block, block) and block <= coalesce(last_block, block)")


def _leaving(circle: DataFrame, chunks: DataFrame) -> DataFrame:
    """First sample outside the circle on either side: circle's columns, back and fwd, each
    struct<out, inner>. ``inner`` is the sample before it on the walk, if in the same block."""
    outside = f"filter(points, s -> {distance('s.x', 's.y', 'at.x', 'at.y')} >= radius)"
    rows = (opened(crossing_blocks(circle, chunks), chunks).selectExpr(*KEY, "at", "radius", f"{_points('samples')} as points")
            .selectExpr("*", f"{outside} as outside")
            .selectExpr("*", "array_max(filter(outside, s -> s.frame < at.frame)) as b",
                        "array_min(filter(outside, s -> s.frame > at.frame)) as f"))
    back = "case when b is not null then struct(b as out, array_min(filter(points, s -> s.frame > b.frame)) as inner) end as back"
    fwd = "case when f is not null then struct(f as out, array_max(filter(points, s -> s.frame < f.frame)) as inner) end as fwd"
    found = rows.selectExpr(*KEY, back, fwd).groupBy(*KEY).agg(F.expr("max(back) as back"), F.expr("min(fwd) as fwd"))
    return circle.join(found, KEY, "left")


def _inner_elsewhere(walked: DataFrame, chunks: DataFrame) -> DataFrame:
    """The sample before ``out`` on the walk where a block border (or gap) lies between the two: it is in the
    neighbouring block towards the anchor."""
    runs = "target_cover.runs"
    after = f"array_min(transform(filter({runs}, r -> r.to > {{0}}), r -> greatest(r.from, {{0}} + 1)))".format(block_of("back.out.frame"))
    before = f"array_max(transform(filter({runs}, r -> r.from < {{0}}), r -> least(r.to, {{0}} - 1)))".format(block_of("fwd.out.frame"))
    probes = walked.selectExpr(*KEY, f"""inline(array(
        struct('back' as side, target as track_id, target_cover as cover, back.out.frame + 1 as lo, at.frame as hi,
               back.out is not null and back.inner is null as open, {after} as block),
        struct('fwd' as side, target as track_id, target_cover as cover, at.frame as lo, fwd.out.frame - 1 as hi,
               fwd.out is not null and fwd.inner is null as open, {before} as block)))""").where("open and block is not null")
    rows = (probes.selectExpr("*", f"{salt_of('block', 'cover')} as salt").join(chunks, TRACK_BLOCK)
            .selectExpr(*KEY, "side", f"{IN_WINDOW} as samples").selectExpr(*KEY, "side", f"{_points('samples')} as points"))
    return rows.groupBy(*KEY).agg(F.expr("min(array_min(points)) filter (where side = 'back') as back_inner"),
                                  F.expr("max(array_max(points)) filter (where side = 'fwd') as fwd_inner"))


def circle_crossings(anchored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Locate the anchor sample and both crossings.

    anchored: (KEY, target, target_lo, target_hi, target_cover, anchor_frame, radius, ...), other columns
    are kept. Adds at (the anchor sample or NULL) and q_in, q_out: struct<x, y, frame>.
    """
    located = sample_at(anchored, chunks, "anchor_frame", "at")
    walked = store(_leaving(located, chunks))
    rows = walked.join(_inner_elsewhere(walked, chunks), KEY, "left").selectExpr(
        *located.columns, "back.out as b_out", "coalesce(back.inner, back_inner) as b_in",
        "fwd.out as f_out", "coalesce(fwd.inner, fwd_inner) as f_in")
    rows = rows.selectExpr("*", *[f"{circle_fraction(f'{w}_in', f'{w}_out', 'at.x', 'at.y', 'radius')} as {w}_s" for w in "bf"])

    def crossing(w: str, out: str) -> str:
        parts = ", ".join(f"{w}_in.{c} + {w}_s * ({w}_out.{c} - {w}_in.{c}) as {c}" for c in ("x", "y", "frame"))
        return f"case when {w}_s is not null then struct({parts}) end as {out}"

    return rows.selectExpr(*located.columns, crossing("b", "q_in"), crossing("f", "q_out"))


def disk_points(anchored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entry, anchor and exit points with their status.

    Adds at, status, qc_x, qc_y, qm_x, qm_y, t_in_frame, qp_x, qp_y, t_out_frame; a point
    that exists is reported even when the other side is missing.
    """
    status = """case when at is null then 'no_anchor_sample' when q_in is null and q_out is null then 'both_unavailable'
        when q_in is null then 'q_in_unavailable' when q_out is null then 'q_out_unavailable' else 'ok' end as status"""
    return circle_crossings(anchored, chunks).selectExpr(
        *anchored.columns, "at", status, "at.x as qc_x", "at.y as qc_y", "q_in.x as qm_x", "q_in.y as qm_y",
        "q_in.frame as t_in_frame", "q_out.x as qp_x", "q_out.y as qp_y", "q_out.frame as t_out_frame")
