"""Post-encroachment time (PET) of ego (vehicle 1) and target (vehicle 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import footprint_touches_circle, point_gap_sq
from ..schema import CONFLICT_THRESHOLD, FPS, KEY
from ..staging import store
from .blocks import ROLES, attach, boxes, in_blocks, opened, role_view
from .closest import ENDS, SLACK, closest_pair
from .lookup import nearest_sample
from .pairs import Prepared
from .simultaneous import min_simultaneous

PAIR = ENDS


def encounters(prep: Prepared) -> DataFrame:
    """Pairs with a common frame, plus ``nearest`` (same time) and ``best`` (any time).

    Pairs that share no frame leave before the closest-pair search.
    """
    met = store(min_simultaneous(prep, PAIR))
    return closest_pair(Prepared(met, prep.chunks), [*PAIR, "nearest"])


def conflict_zones(encounter: DataFrame, threshold: float = CONFLICT_THRESHOLD) -> DataFrame:
    """Window rows of both roles with their zone circle, where the paths come close enough.

    Each vehicle's zone lies on its own path at the closest point; its radius is the
    other vehicle's width.
    """
    sides = ", ".join(
        f"""struct('{r}' as role, {r} as track_id, {r}_lo as lo, {r}_hi as hi, {r}_cover as cover, best.{r}_x as zone_x, best.{r}_y as zone_y,
        {other}_first.width as radius, {r}_first.length as length, {r}_first.width as width)"""
        for r, other in (("ego", "target"), ("target", "ego")))
    return encounter.where(f"sqrt(best.d2) <= {float(threshold)}D").selectExpr(*KEY, f"inline(array({sides}))")


_INSIDE = footprint_touches_circle("s", "length", "width", "zone_x", "zone_y", "radius")


def zone_overlap(zones: DataFrame, prep: Prepared) -> DataFrame:
    """Per-sample overlap of the vehicle footprint with its zone: (KEY, role, frame, inside)."""
    return attach(zones, prep.chunks).selectExpr(
        *KEY, "role", f"inline(transform(samples, s -> struct(s.frame as frame, {_INSIDE} as inside)))")


def zone_blocks(zones: DataFrame, prep: Prepared) -> DataFrame:
    """Blocks whose box lies so near to the zone that a footprint in it can touch the circle; the others are not opened."""
    reach = "(radius + sqrt(length * length + width * width) / 2)"
    return in_blocks(zones, boxes(prep.chunks)).where(
        f"{point_gap_sq('struct(zone_x as x, zone_y as y)', 'struct(x0, x1, y0, y1)')} <= {reach} * {reach} * {1 + SLACK}D + {SLACK}D")


def zone_enter_exit(zones: DataFrame, prep: Prepared) -> DataFrame:
    """First and last frame in the zone per vehicle: (KEY, enter1, exit1, enter2, exit2)."""
    rows = (opened(zone_blocks(zones, prep), prep.chunks).selectExpr(*KEY, "role", f"filter(samples, s -> {_INSIDE}).frame as frames")
            .selectExpr(*KEY, "role", "array_min(frames) as enter", "array_max(frames) as exit"))
    return rows.groupBy(*KEY).agg(*[
        F.expr(f"{agg} filter (where role = '{role}') as {name}{i}") for i, role in enumerate(ROLES, start=1)
        for agg, name in (("min(enter)", "enter"), ("max(exit)", "exit"))])


def pet(prep: Prepared, threshold: float = CONFLICT_THRESHOLD, fps: float = FPS) -> DataFrame:
    """PET of every pair in ``prep.pairs``; positive when the ego passes first.

    ``pet`` is NULL with a ``reason`` where it is undefined. One row per pair:
    (KEY, pet, reason, first_passer, pet_frame1, pet_frame2, enter1, exit1, enter2, exit2,
    path_min_distance, zone1_x, zone1_y, zone2_x, zone2_y, min_distance,
    min_distance_frame, v1_mindist_x, v1_mindist_y, v2_mindist_x, v2_mindist_y)
    """
    return pet_cases(prep.pairs, store(encounters(prep)), prep, threshold, fps)


def pet_cases(pairs: DataFrame, met: DataFrame, prep: Prepared, threshold: float, fps: float) -> DataFrame:
    """``pet`` of the given pairs, from their (stored) encounters."""
    frames = zone_enter_exit(conflict_zones(met, threshold), prep)
    passed = """case when enter1 is null or enter2 is null then null when exit1 < enter2 then 1
        when exit2 < enter1 then 2 else 0 end as passed"""
    rows = (pairs.select(*KEY).join(met.select(*KEY, "nearest", "best"), KEY, "left")
            .join(frames, KEY, "left").selectExpr("*", passed))

    def case(first: str, second: str, overlap: str) -> str:
        return f"case passed when 1 then {first} when 2 then {second} when 0 then {overlap} end"

    seconds = case(f"(enter2 - exit1) / {float(fps)}D", f"-((enter1 - exit2) / {float(fps)}D)", "0D")
    return rows.selectExpr(
        *KEY, f"bround({seconds}, 3) as pet",
        "case when nearest is null then 'no_frame_overlap' when passed is null then 'no_conflict_zone_entry' end as reason",
        "cast(passed as bigint) as first_passer",
        case("exit1", "exit2", "greatest(enter1, enter2)") + " as pet_frame1",
        case("enter2", "enter1", "least(exit1, exit2)") + " as pet_frame2",
        *[f"case when passed is not null then {c} end as {c}" for c in ("enter1", "exit1", "enter2", "exit2")],
        "bround(sqrt(best.d2), 4) as path_min_distance", "best.ego_x as zone1_x", "best.ego_y as zone1_y",
        "best.target_x as zone2_x", "best.target_y as zone2_y", "bround(nearest.distance, 4) as min_distance",
        "nearest.frame as min_distance_frame", "nearest.ego_x as v1_mindist_x", "nearest.ego_y as v1_mindist_y",
        "nearest.target_x as v2_mindist_x", "nearest.target_y as v2_mindist_y")


def boundary_positions(pets: DataFrame, prep: Prepared) -> DataFrame:
    """Where each vehicle is at both PET boundary frames (its sample nearest in time):
    (KEY, v1_pet1_x, v1_pet1_y, v1_pet2_x, ..., v2_pet2_y)."""
    known = pets.where("pet is not null").select(*KEY, "pet_frame1", "pet_frame2").join(prep.pairs, KEY)
    names = [(v, p, role) for v, role in enumerate(ROLES, start=1) for p in (1, 2)]
    probes = ", ".join(f"struct('v{v}_pet{p}' as probe, {r} as track_id, {r}_lo as lo, {r}_hi as hi, {r}_cover as cover, "
                       f"pet_frame{p} as at)"
                       for v, p, r in names)
    near = nearest_sample(known.selectExpr(*KEY, f"inline(array({probes}))"), prep.chunks, ["probe"])
    return near.groupBy(*KEY).agg(*[F.expr(f"max(near.{c}) filter (where probe = 'v{v}_pet{p}') as v{v}_pet{p}_{c}")
                                    for v, p, _ in names for c in ("x", "y")])


def actor_anchor(pets: DataFrame) -> DataFrame:
    """Critical frame of the parameterized vehicle: (KEY, anchor, crit_frame).

    The PET boundary frame, else the frame of smallest same-time distance, else none.
    """
    return pets.selectExpr(*KEY, """case when pet is not null then 'pet' when min_distance_frame is not null then 'min_dist'
        else 'none' end as anchor""", "coalesce(pet_frame1, min_distance_frame) as crit_frame")


def actor_position(pets: DataFrame, prep: Prepared, actor_is: int = 2) -> DataFrame:
    """``actor_anchor`` with the position of vehicle ``actor_is`` there: + (crit_x, crit_y)."""
    if actor_is not in (1, 2):
        raise ValueError(f"actor_is must be 1 or 2, not {actor_is!r}")
    role = ROLES[actor_is - 1]
    at = actor_anchor(pets)
    windows = role_view(prep.pairs, role).join(at.selectExpr(*KEY, "crit_frame as at"), KEY)
    near = nearest_sample(windows, prep.chunks)
    return at.join(near, KEY, "left").selectExpr(*KEY, "anchor", "crit_frame", "near.x as crit_x", "near.y as crit_y")
