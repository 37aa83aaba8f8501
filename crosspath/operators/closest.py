"""Any-time closest pair of ego and target samples, exact and without pairing all samples.

Each track is a tree: samples, blocks of BLOCK frames, and nodes of 2^FANOUT_BITS nodes of the level
below. A node keeps a bounding box and its first sample. Node pairs give a lower bound (box gap) and an
upper bound (distance of the two first samples in the window, so a distance that really occurs). The search
goes down in rounds, one level each: the bound of an interaction is the minimum over its node pairs,
combined before the shuffle and joined back; pairs whose lower bound exceeds it
cannot hold the minimum and are dropped before their children are opened. Nothing is dropped that could tie for the
minimum, except ties that come later in the tie order.

The search starts where no window has more than a few nodes, so the number of rounds is the logarithm of the
longest window, and the work of a round is the node pairs that are still close enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_gap_sq, distance_sq, point_gap_sq
from ..schema import KEY
from ..staging import store
from . import blocks as B
from .pairs import Prepared

# Rounding slack on the lower bound, so that a tie in the last bit is never pruned.
SLACK = 1e-9

TOP = 4             # the search starts at the level where a window spans at most 2^TOP nodes

ENDS = [f"{r}{c}" for r in B.ROLES for c in ("", "_lo", "_hi", "_cover", "_first")]

# Both vehicles stand still in these nodes: every sample pair has exactly the same distance.
_STILL = "e.x0 = e.x1 and e.y0 = e.y1 and t.x0 = t.x1 and t.y0 = t.y1"


def _node(role: str) -> str:
    """A node row as struct: its box (never too small) and its first sample inside the window, which is that of
    the window where the node begins before it."""
    return f"""struct(x0, x1, y0, y1, if(f0 >= {role}_lo, struct(f0 as frame, px as x, py as y),
        struct({role}_first.frame as frame, {role}_first.x as x, {role}_first.y as y)) as p)"""


def _nodes(chunks: DataFrame, level: int) -> DataFrame:
    """(recording_id, track_id, node, x0, x1, y0, y1, f0, px, py): the nodes of a level above the blocks."""
    box = [f"{agg}({c}) as {c}" for agg, c in (("min", "x0"), ("max", "x1"), ("min", "y0"), ("max", "y1"))]
    rows = chunks.where("salt = 0").groupBy(*B.TRACK, F.expr(f"shiftright(block, {level * B.FANOUT_BITS})").alias("node")).agg(
        *map(F.expr, (*box, "min(struct(f0, px, py)) as p")))
    return rows.selectExpr(*B.TRACK, "node", "x0", "x1", "y0", "y1", "p.*")


def _in_node(role: str, level: int, parent: str | None = None) -> str:
    """Array of a window's nodes of a level: those that hold blocks of the window, under node ``parent`` of the level above."""
    low, high = (B.block_of(f"{role}_{end}") for end in ("lo", "hi"))
    if parent:
        bits = (level + 1) * B.FANOUT_BITS
        low, high = f"greatest({low}, shiftleft({parent}, {bits}))", f"least({high}, shiftleft({parent} + 1L, {bits}) - 1L)"
    bits = level * B.FANOUT_BITS
    spans = f"filter({role}_cover.runs, r -> r.to >= {low} and r.from <= {high})"
    return f"""array_distinct(flatten(transform({spans}, r -> sequence(
        shiftright(greatest(r.from, {low}), {bits}), shiftright(least(r.to, {high}), {bits})))))"""


def _with_block(rows: DataFrame, prep: Prepared, role: str, block: str, *out: str) -> DataFrame:
    """Join one role's track block and select ``out``, where lo..hi is that role's window."""
    chunks = prep.chunks.withColumnsRenamed({"track_id": role, "block": block})
    salted = rows.selectExpr("*", f"{B.salt_of(block, f'{role}_cover')} as salt")
    return (salted.join(chunks, ["recording_id", role, block, "salt"])
            .selectExpr("*", f"{role}_lo as lo", f"{role}_hi as hi").selectExpr(*out))


def _with_node(rows: DataFrame, prep: Prepared, role: str, name: str, level: int, *out: str) -> DataFrame:
    """Join the node of a level that column ``name`` says and select ``out``."""
    if level == 0:
        return _with_block(rows, prep, role, name, *out)
    nodes = _nodes(prep.chunks, level).withColumnsRenamed({"track_id": role, "node": name})
    return rows.join(nodes, ["recording_id", role, name]).selectExpr(*out)


def _prune(pairs: DataFrame, keep: list[str], by_target: str) -> DataFrame:
    """Keep the node pairs (e, t) that can hold their interaction's minimum; adds ``bound``,
    which no closest pair exceeds.

    Of node pairs in which both vehicles stand still only the one with the smallest
    distance and the first frames can hold it, so a parked pair does not keep all its blocks.
    """
    seen = distance_sq("e.p.x", "e.p.y", "t.p.x", "t.p.y")
    first = f"struct({seen} as seen, if({by_target}, t.p.frame, e.p.frame) as f1, if({by_target}, e.p.frame, t.p.frame) as f2)"
    rows = store(pairs.selectExpr(*keep, f"{box_gap_sq('e', 't')} as gap", f"{first} as first", f"{_STILL} as still"))
    least = rows.groupBy(*KEY).agg(F.expr(f"min(first.seen) * {1 + SLACK}D + {SLACK * SLACK}D as bound"),
                                   F.expr("min(first) filter (where still) as still_first"))
    return rows.join(least, KEY).where("gap <= bound and (not still or first = still_first)").select(*keep, "bound")


def candidate_blocks(prep: Prepared, carry: list[str] = (), by_target: str = "false") -> DataFrame:
    """Block pairs that can hold the closest sample pair: (KEY, window columns, carry, e_block,
    t_block, e, t, bound), where e and t are the blocks' nodes."""
    ends = list(dict.fromkeys([*ENDS, *carry]))
    spans = ", ".join(f"{B.block_of(f'{r}_hi')} - {B.block_of(f'{r}_lo')}" for r in B.ROLES)
    longest = prep.pairs.agg(F.expr(f"max(greatest({spans}))")).first()[0] or 0
    level = 0
    while longest >> (level * B.FANOUT_BITS) >= 1 << TOP:
        level += 1
    rows = prep.pairs.select(*KEY, *ends).selectExpr("*", f"explode({_in_node('ego', level)}) as e_block")
    rows = _with_node(rows, prep, "ego", "e_block", level, *KEY, *ends, "e_block", f"{_node('ego')} as e")
    rows = rows.selectExpr("*", f"explode({_in_node('target', level)}) as t_block")
    rows = _with_node(rows, prep, "target", "t_block", level, *KEY, *ends, "e_block", "t_block", "e", f"{_node('target')} as t")
    keep = [*KEY, *ends, "e_block", "t_block", "e", "t"]
    rows = _prune(rows, keep, by_target)
    while level:
        level -= 1
        # The bound of the level above already rules out most children of one side before the other side's are opened.
        rows = rows.selectExpr(*KEY, *ends, "t_block as t_up", "t as t_over", "bound", f"explode({_in_node('ego', level, 'e_block')}) as e_block")
        rows = (_with_node(rows, prep, "ego", "e_block", level, *KEY, *ends, "e_block", f"{_node('ego')} as e", "t_up", "t_over", "bound")
                .where(f"{box_gap_sq('e', 't_over')} <= bound")
                .selectExpr(*KEY, *ends, "e_block", "e", "bound", f"explode({_in_node('target', level, 't_up')}) as t_block"))
        rows = (_with_node(rows, prep, "target", "t_block", level, *KEY, *ends, "e_block", "t_block", "e", f"{_node('target')} as t", "bound")
                .where(f"{box_gap_sq('e', 't')} <= bound"))
        rows = _prune(rows, keep, by_target)
    return rows


_D2 = distance_sq("e.x", "e.y", "t.x", "t.y")


def closest_pair(prep: Prepared, carry: list[str] = (), by_target: str = "false") -> DataFrame:
    """Closest ego/target sample pair over all times.

    Ties go to the lowest ego frame, then the lowest target frame. Where the condition
    ``by_target`` holds, distances are compared as rounded square roots and ties go to the
    lowest target frame (the order of the crossing anchor).
    (KEY, carry, best: struct<rank, tie, d2, ego_frame, target_frame, ego_x, ego_y, target_x, target_y>)
    """
    ends = list(dict.fromkeys([*ENDS, *carry]))
    near_t = f"filter({B.IN_WINDOW}, s -> {point_gap_sq('s', 't')} <= bound) as es"
    near_e = f"filter({B.IN_WINDOW}, s -> {point_gap_sq('s', 'e')} <= bound) as ts"
    rows = _with_block(candidate_blocks(prep, carry, by_target), prep, "ego", "e_block", *KEY, *ends, "t_block", "e", "bound", near_t)
    rows = _with_block(rows.where("size(es) > 0"), prep, "target", "t_block", *KEY, *carry, "es", near_e)
    pair = f"""struct(if({by_target}, sqrt({_D2}), {_D2}) as rank, if({by_target}, t.frame, e.frame) as tie, {_D2} as d2,
        e.frame as ego_frame, t.frame as target_frame, e.x as ego_x, e.y as ego_y, t.x as target_x, t.y as target_y)"""
    best = f"array_min(transform(es, e -> array_min(transform(ts, t -> {pair})))) as best"
    return rows.selectExpr(*KEY, *carry, best).where("best is not null").groupBy(*KEY, *carry).agg(F.expr("min(best) as best"))


def crossing_frame(prep: Prepared) -> DataFrame:
    """Target frame closest to the ego path: (KEY, best), see ``closest_pair``."""
    return closest_pair(prep, by_target="true")
