"""Plane geometry as Spark SQL expression text.

The functions build expressions for ``selectExpr``/``expr`` from expressions, so they work
on columns and inside array lambdas alike, and everything is evaluated JVM-side.
"""

from __future__ import annotations


def norm(dx: str, dy: str) -> str:
    """Length of the vector (dx, dy)."""
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


def distance_sq(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def distance(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt({distance_sq(ax, ay, bx, by)})"


def between(a: str, b: str) -> str:
    """Distance of two structs that have fields x and y."""
    return distance(f"{a}.x", f"{a}.y", f"{b}.x", f"{b}.y")


def signed_angle(ux: str, uy: str, vx: str, vy: str) -> str:
    """Angle in degrees that turns u onto v, counter-clockwise positive."""
    return f"degrees(atan2(({ux}) * ({vy}) - ({uy}) * ({vx}), ({ux}) * ({vx}) + ({uy}) * ({vy})))"


def rotate(ux: str, uy: str, deg: str) -> tuple[str, str]:
    """u turned by ``deg`` degrees."""
    c, s = f"cos(radians({deg}))", f"sin(radians({deg}))"
    return f"({c} * {ux} - {s} * {uy})", f"({s} * {ux} + {c} * {uy})"


def footprint_touches_circle(s: str, length: str, width: str, cx: str, cy: str, radius: str) -> str:
    """Does the rotated rectangle of sample ``s`` (x, y, heading) reach into a circle?

    The circle center is moved into the vehicle's own axes, where the rectangle is
    axis-parallel and the gap to it is a per-axis excess.
    """
    c, n = f"cos(radians({s}.heading))", f"sin(radians({s}.heading))"
    dx, dy = f"({cx} - {s}.x)", f"({cy} - {s}.y)"
    over_l = f"greatest(abs({c} * {dx} + {n} * {dy}) - {length} / 2, 0D)"
    over_w = f"greatest(abs({c} * {dy} - {n} * {dx}) - {width} / 2, 0D)"
    return f"({norm(over_l, over_w)} <= {radius})"


def box_gap_sq(a: str, b: str) -> str:
    """Squared distance of two axis-parallel boxes (structs x0, x1, y0, y1); 0 when they overlap."""
    gx = f"greatest({b}.x0 - {a}.x1, {a}.x0 - {b}.x1, 0D)"
    gy = f"greatest({b}.y0 - {a}.y1, {a}.y0 - {b}.y1, 0D)"
    return f"({gx} * {gx} + {gy} * {gy})"


def point_gap_sq(p: str, box: str) -> str:
    """Squared distance of a point (struct x, y) to a box; 0 inside it."""
    gx = f"greatest({box}.x0 - {p}.x, {p}.x - {box}.x1, 0D)"
    gy = f"greatest({box}.y0 - {p}.y, {p}.y - {box}.y1, 0D)"
    return f"({gx} * {gx} + {gy} * {gy})"


def point_reach_sq(p: str, box: str) -> str:
    """Squared distance of a point (struct x, y) to the farthest corner of a box."""
    rx = f"greatest(abs({p}.x - {box}.x0), abs({p}.x - {box}.x1))"
    ry = f"greatest(abs({p}.y - {box}.y0), abs({p}.y - {box}.y1))"
    return f"({rx} * {rx} + {ry} * {ry})"


def circle_fraction(p: str, q: str, cx: str, cy: str, radius: str) -> str:
    """Fraction s in [0, 1] at which the segment p -> q (structs x, y) leaves the circle.

    Larger root of |p + s (q - p) - c|^2 = radius^2; NULL for a zero-length segment.
    """
    vx, vy, wx, wy = f"({q}.x - {p}.x)", f"({q}.y - {p}.y)", f"({p}.x - {cx})", f"({p}.y - {cy})"
    a = f"({vx} * {vx} + {vy} * {vy})"
    b = f"(2 * ({vx} * {wx} + {vy} * {wy}))"
    c = f"({wx} * {wx} + {wy} * {wy} - {radius} * {radius})"
    root = f"(sqrt(greatest({b} * {b} - 4 * {a} * {c}, 0D)) - {b}) / nullif(2 * {a}, 0D)"
    return f"case when {a} > 0 then least(greatest({root}, 0D), 1D) end"
