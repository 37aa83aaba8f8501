"""Conflict anchor: a frame of the target track, found by one of three methods.

Every method returns (KEY, anchor_kind, anchor_frame) and has no row for a pair
without an anchor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..schema import CONFLICT_THRESHOLD, FPS, KEY
from ..staging import store
from .blocks import role_view
from .closest import closest_pair, crossing_frame
from .lookup import nearest_sample
from .pairs import Prepared
from .pet import PAIR, actor_anchor, pet, pet_cases
from .simultaneous import min_simultaneous


def pet_anchor(prep: Prepared, threshold: float = CONFLICT_THRESHOLD, fps: float = FPS) -> DataFrame:
    """Target frame nearest to the PET boundary frame, or to the smallest same-time distance."""
    return _snapped(pet(prep, threshold, fps), prep)


def _snapped(pets: DataFrame, prep: Prepared) -> DataFrame:
    crit = actor_anchor(pets).selectExpr(*KEY, "anchor as anchor_kind", "crit_frame as at")
    near = nearest_sample(role_view(prep.pairs, "target").join(crit, KEY), prep.chunks, ["anchor_kind"])
    return near.selectExpr(*KEY, "anchor_kind", "near.frame as anchor_frame")


def cross_anchor(prep: Prepared) -> DataFrame:
    """Target sample closest to the ego path at any time."""
    return crossing_frame(prep).selectExpr(*KEY, "'cross' as anchor_kind", "best.target_frame as anchor_frame")


def min_dist_anchor(prep: Prepared) -> DataFrame:
    """Frame of the smallest same-time distance."""
    return min_simultaneous(prep).selectExpr(*KEY, "'min_dist' as anchor_kind", "nearest.frame as anchor_frame")


def given_anchor(prep: Prepared) -> DataFrame:
    """Anchor frames named in the scenario list; these pairs skip the search."""
    return prep.pairs.where("anchor_frame is not null").selectExpr(*KEY, "'given' as anchor_kind", "anchor_frame")


def find_anchor(prep: Prepared, threshold: float = CONFLICT_THRESHOLD, fps: float = FPS) -> DataFrame:
    """Dispatch on the pairs' ``anchor`` column.

    Each pair is only searched the way its method asks for, but the methods share the two
    expensive passes: same-time distances (pet, min_dist) and closest pairs (pet, cross).
    """
    search = prep.pairs.where("anchor_frame is null")
    timed = store(min_simultaneous(Prepared(search.where("anchor in ('pet', 'min_dist')"), prep.chunks), [*PAIR, "anchor"]))
    cross = search.where("anchor = 'cross'").select(*KEY, *PAIR, "anchor")
    paths = timed.where("anchor = 'pet'").unionByName(cross, allowMissingColumns=True)
    closest = store(closest_pair(Prepared(paths, prep.chunks), [*PAIR, "anchor", "nearest"], "anchor = 'cross'"))
    pets = pet_cases(search.where("anchor = 'pet'"), closest.where("anchor = 'pet'"), prep, threshold, fps)
    return reduce(DataFrame.unionByName, (
        given_anchor(prep), _snapped(pets, prep),
        closest.where("anchor = 'cross'").selectExpr(*KEY, "'cross' as anchor_kind", "best.target_frame as anchor_frame"),
        timed.where("anchor = 'min_dist'").selectExpr(*KEY, "'min_dist' as anchor_kind", "nearest.frame as anchor_frame")))
