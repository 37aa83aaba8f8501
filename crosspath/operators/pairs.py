"""Interactions joined to both of their tracks: window samples, counts, status gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, SAMPLE_FIELDS
from ..staging import store
from . import blocks as B


@dataclass(frozen=True)
class Prepared:
    """The two relations the interaction operators work on.

    chunks: tracks as blocks (``blocks.chunk_tracks``).
    pairs:  one row per interaction whose two windows hold at least ``MIN_SAMPLES``
            samples each, with per-role sample count, frame range and first sample.
    """

    pairs: DataFrame
    chunks: DataFrame


MIN_SAMPLES = 2


def windowed_chunks(
    tracks: DataFrame, scenarios: DataFrame, fields: list[str] = SAMPLE_FIELDS, carry: list[str] = (),
    roles: tuple[str, ...] = B.ROLES,
) -> tuple[DataFrame, DataFrame]:
    """The roles' windows that hold samples, and the track blocks they touch.

    windows: (KEY, carry, role, track_id, n, lo, hi, cover), narrowed to the frames there are. cover
    says which blocks exist (runs) and which of them are stored in copies (hot).
    The scan drops what no interaction names, windows meet the catalogue, and only then samples
    of the pages they touch are shuffled, once.
    """
    used = B.in_use(tracks, scenarios, roles)
    seen = store(B.seen_pages(B.role_windows(scenarios, carry, roles), B.catalogue(used)))
    touched = seen.groupBy(*B.TRACK, "page").count()
    needed, (busiest,) = B.bitmap(touched, [*B.TRACK, "page"], "max(count)")
    paged = used.selectExpr("*", f"{B.page_of(B.block_of('frame'))} as page").where(needed).drop("page")
    crowded = B.crowded_blocks(seen) if (busiest or 0) > B.HOT else None
    windows = seen.groupBy(*KEY, *carry, "role", "track_id").agg(*map(F.expr, (
        "sum(n) as n", "min(first) as lo", "max(last) as hi", "sort_array(flatten(collect_list(runs))) as runs")))
    if crowded is None:
        windows = windows.withColumn("hot", F.expr(B._NO_RUNS))
    else:
        windows = windows.join(B.hot_runs(crowded), B.TRACK, "left")
    windows = windows.selectExpr(*KEY, *carry, "role", "track_id", "n", "lo", "hi", "struct(runs, hot) as cover")
    return windows, B.chunk_tracks(paged, crowded, fields)


def window_samples(scenarios: DataFrame, tracks: DataFrame) -> DataFrame:
    """Long table of the samples inside each interaction's frame window, per role.

    Window bounds are inclusive; a frame appears once per (interaction, role).
    """
    return B.attach(*windowed_chunks(tracks, scenarios)).selectExpr(*KEY, "role", "track_id", "inline(samples)")


def summarize(windows: DataFrame, chunks: DataFrame, carry: list[str]) -> DataFrame:
    """One row per interaction that passes the two-sample gate: counts, frame ranges, first samples.

    Counts come from the catalogue; only the block of each role's first frame is opened.
    """
    names = ("n", "lo", "hi", "cover")
    aggs = [F.expr(f"any_value({c}) filter (where role = '{r}') as {r}_{c}") for r in B.ROLES for c in names]
    rows = windows.groupBy(*KEY, *carry).agg(*aggs).where(f"ego_n >= {MIN_SAMPLES} and target_n >= {MIN_SAMPLES}")
    for r in B.ROLES:
        first = chunks.selectExpr("recording_id", f"track_id as {r}", "block", "salt", "samples")
        rows = (rows.selectExpr("*", f"{B.block_of(f'{r}_lo')} as block").selectExpr("*", f"{B.salt_of('block', f'{r}_cover')} as salt")
                .join(first, ["recording_id", r, "block", "salt"])
                .selectExpr(*[c for c in rows.columns], f"get(filter(samples, s -> s.frame = {r}_lo), 0) as {r}_first"))
    return rows


def prepare(tracks: DataFrame, scenarios: DataFrame, fields: list[str] = SAMPLE_FIELDS,
            keep: list[str] = ()) -> Prepared:
    """Chunk the tracks in use and summarize the interactions, each stored once.

    Interactions that fail the two-sample gate are left out, so no later (and more
    expensive) join sees them; ``plans.extract`` adds them back as ``no_track``.
    ``keep`` names scenario columns to carry along on the pairs.
    """
    carry = ["ego", "target", *keep]
    windows, chunks = windowed_chunks(tracks, scenarios, fields, carry)
    return Prepared(store(summarize(windows, chunks, carry)), chunks)
