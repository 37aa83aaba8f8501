"""Deflection angles of the target path through the circular window, and their inverse.

theta1 turns the incoming direction u1 onto q_in -> q_c, theta2 turns that onto
q_c -> q_out; L1 and L2 are the two chord lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import between, distance, norm, rotate, signed_angle
from ..schema import KEY
from ..staging import stage
from .blocks import attach

RESAMPLE_POINTS = 200
NEAR_START_M = 1.0
MIN_CHORD_M = 1.0
START_HEADING_M = 2.0
STILL_M = 1e-9

# Blocks per group in the two-level running sums below.
GROUP = 1024

_KEYS = ", ".join(KEY)
_BEFORE = "rows between unbounded preceding and 1 preceding"


def _linked_blocks(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks of each window with the next block's first sample (next), the path length up
    to their first sample (start) and the whole path's length (total).

    This needs the order of a whole track. It is established in two levels: inside groups
    of GROUP blocks, and over one row per group, so no task orders a long track's samples.
    """
    inner = f"""aggregate(sequence(1, greatest(size(samples) - 1, 1)), 0D, (acc, i) -> acc + coalesce(
        {between('get(samples, i)', 'get(samples, i - 1)')}, 0D)) as inner"""
    rows = stage(attach(windows, chunks).where("size(samples) > 0").selectExpr(
        *KEY, "block", f"floor(block / {GROUP}) as grp", "samples", "get(samples, 0) as first",
        "get(samples, size(samples) - 1) as last", inner))
    heads = rows.groupBy(*KEY, "grp").agg(F.expr("min(first) as head")).selectExpr(
        *KEY, "grp", f"lead(head) over (partition by {_KEYS} order by grp) as next_head")
    in_group = f"partition by {_KEYS}, grp order by block"
    rows = (rows.selectExpr("*", f"lead(first) over ({in_group}) as nxt").join(heads, [*KEY, "grp"])
            .selectExpr(*KEY, "grp", "block", "samples", "inner", "last", "coalesce(nxt, next_head) as next")
            .selectExpr("*", f"inner + coalesce({between('last', 'next')}, 0D) as length"))
    sums = rows.groupBy(*KEY, "grp").agg(F.expr("sum(length) as len")).selectExpr(
        *KEY, "grp", f"coalesce(sum(len) over (partition by {_KEYS} order by grp {_BEFORE}), 0D) as grp_start",
        f"sum(len) over (partition by {_KEYS}) as total")
    return (rows.selectExpr("*", f"coalesce(sum(length) over ({in_group} {_BEFORE}), 0D) as before")
            .join(sums, [*KEY, "grp"])
            .selectExpr(*KEY, "block", "samples", "next", "grp_start + before as start", "total"))


def arc_resample(windows: DataFrame, chunks: DataFrame, k: int = RESAMPLE_POINTS) -> DataFrame:
    """k points at equal arc length along each window track: (KEY, i, x, y), i = 0..k-1.

    windows: (KEY, track_id, lo, hi, cover). Linear interpolation; a track that does not move
    gives k copies of its first point.
    """
    linked = _linked_blocks(windows, chunks)
    in_block = f"partition by {_KEYS}, block order by frame"
    ends = (linked.where(f"total > {STILL_M}D").selectExpr(*KEY, "block", "start", f"total / {k - 1} as step", "next", "inline(samples)")
            .selectExpr("*", f"coalesce(lead(x) over ({in_block}), next.x, x) as bx",
                        f"coalesce(lead(y) over ({in_block}), next.y, y) as b_y")
            .selectExpr("*", f"{distance('x', 'y', 'bx', 'b_y')} as seg")
            .selectExpr("*", f"start + coalesce(sum(seg) over ({in_block} {_BEFORE}), 0D) as s"))
    hit = (ends.selectExpr("*", "greatest(ceil(s / step - 1e-9D), 0L) as i0",
                           f"least(floor((s + seg) / step + 1e-9D), {k - 1}L) as i1")
           .where("i0 <= i1").selectExpr("*", "explode(sequence(i0, i1)) as i")
           .selectExpr("*", "case when seg > 0 then least(greatest((i * step - s) / seg, 0D), 1D) else 0D end as part"))
    # A point on a sample is found from both adjoining segments, with the same value.
    once = (hit.selectExpr(*KEY, "i", "struct(frame, x + part * (bx - x) as x, y + part * (b_y - y) as y) as p")
            .groupBy(*KEY, "i").agg(F.expr("min(p) as p")).selectExpr(*KEY, "i", "p.x", "p.y"))
    still = (linked.where(f"total <= {STILL_M}D").groupBy(*KEY).agg(F.expr("min(get(samples, 0)) as p"))
             .selectExpr(*KEY, f"explode(sequence(0L, {k - 1}L)) as i", "p.x", "p.y"))
    return once.unionByName(still)


def start_heading(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Unit direction of each window track over its first 2 m (or first half): (KEY, hx, hy).

    Works on the RESAMPLE_POINTS resampled points, so each group is of fixed size.
    """
    w = f"partition by {_KEYS} order by i"
    arc = (arc_resample(windows, chunks)
           .selectExpr("*", f"coalesce({distance('x', 'y', f'lag(x) over ({w})', f'lag(y) over ({w})')}, 0D) as d")
           .selectExpr("*", f"sum(d) over ({w}) as s")
           .selectExpr("*", f"least({START_HEADING_M}D, 0.5D * max(s) over (partition by {_KEYS})) as reach"))
    ends = arc.groupBy(*KEY).agg(F.expr("min(struct(x, y)) filter (where i = 0) as a"),
                                 F.expr("min(struct(i, x, y)) filter (where i >= 1 and s >= reach) as b"))
    return (ends.selectExpr(*KEY, "b.x - a.x as dx", "b.y - a.y as dy").selectExpr("*", f"{norm('dx', 'dy')} + 1e-9D as len")
            .selectExpr(*KEY, "dx / len as hx", "dy / len as hy"))


def theta_geometry(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add u1_x, u1_y, u1_source, L1, L2, theta1_deg, theta2_deg to rows with three points.

    points: (KEY, target, target_lo, target_hi, target_cover, target_first, qm_*, qc_*, qp_*, ...).
    All added columns are NULL when a chord is shorter than 1 m. Only the few rows whose
    q_in lies within 1 m of the track start are resampled.
    """
    l0 = distance("qm_x", "qm_y", "target_first.x", "target_first.y")
    near = points.where(f"{l0} < {NEAR_START_M}D").selectExpr(
        *KEY, "target as track_id", "target_lo as lo", "target_hi as hi", "target_cover as cover")
    rows = points.join(start_heading(near, chunks), KEY, "left").selectExpr(
        "*", f"{l0} as l0", "qc_x - qm_x as v2x", "qc_y - qm_y as v2y", "qp_x - qc_x as v3x", "qp_y - qc_y as v3y")
    far = f"l0 >= {NEAR_START_M}D"
    rows = rows.selectExpr("*", *[
        f"case when {far} then (qm_{c} - target_first.{c}) / l0 else h{c} end as ux_{c}" for c in ("x", "y")],
        f"{norm('v2x', 'v2y')} as c1", f"{norm('v3x', 'v3y')} as c2")
    out = {
        "u1_x": "ux_x", "u1_y": "ux_y", "u1_source": f"case when {far} then 'init_pt' else 'start_heading' end",
        "L1": "c1", "L2": "c2", "theta1_deg": signed_angle("ux_x", "ux_y", "v2x", "v2y"),
        "theta2_deg": signed_angle("v2x", "v2y", "v3x", "v3y"),
    }
    return rows.selectExpr(*points.columns, *[
        f"case when least(c1, c2) >= {MIN_CHORD_M}D then {v} end as {c}" for c, v in out.items()])


def theta_to_cps(df: DataFrame, theta1: str = "theta1_deg", theta2: str = "theta2_deg") -> DataFrame:
    """Rebuild the three points from the angles: adds p1_x, p1_y (q_in) .. p3_x, p3_y (q_out)."""
    d1 = rotate("u1_x", "u1_y", theta1)
    d2 = rotate("u1_x", "u1_y", f"{theta1} + {theta2}")
    return (df.selectExpr("*", "qm_x as p1_x", "qm_y as p1_y", f"qm_x + L1 * {d1[0]} as p2_x", f"qm_y + L1 * {d1[1]} as p2_y")
            .selectExpr("*", f"p2_x + L2 * {d2[0]} as p3_x", f"p2_y + L2 * {d2[1]} as p3_y"))
