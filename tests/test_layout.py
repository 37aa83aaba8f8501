"""Block layout: one exchange of samples, gaps of billions of frames, the catalogue, search by rounds."""

import numpy as np
import pytest

from crosspath.operators import blocks, circle, closest, lookup, pairs, pet
from crosspath.schema import KEY

from .helpers import scenarios, straight, tracks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_exchanged_once(spark, monkeypatch):
    plans, original = [], blocks.stage_bucketed
    monkeypatch.setattr(blocks, "stage_bucketed", lambda df, keys: plans.append(plan(df)) or original(df, keys))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tr = tracks(spark, straight(1, (0.0, 0.0), (1.0, 0.0), range(200), 0), straight(2, (20.0, -20.0), (0.0, 1.0), range(200), 90),
                    straight(3, (0.0, 0.0), (1.0, 0.0), range(200), 0))
        prep = pairs.prepare(tr, scenarios(spark, [("a", "x", 1, 2, 0, 150, None)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    final = plans[0].split("== Initial Plan ==")[0]
    assert final.count("Exchange ") == 1 and "hashpartitioning(recording_id" in final and "Join" not in final and "salt" in final
    assert {r.track_id for r in prep.chunks.select("track_id").distinct().collect()} == {1, 2}


def test_gaps_of_billions_of_frames(spark):
    far = 6 * 10 ** 10
    one = [("r", 1, f, float(f % 97), 0.0, 0.0, 1.0, 4.0, 2.0) for f in (0, 3, far, far + 40)]
    two = [("r", 2, f, 50.0, 1.0, 90.0, 1.0, 4.0, 2.0) for f in (1, far + 39, far + 40)]
    rows = [("all", "x", 1, 2, -5, 2 * far, None), ("late", "x", 1, 2, far, far + 50, None), ("none", "x", 1, 2, 5, far - 1, None)]
    prep = pairs.prepare(tracks(spark, one, two), scenarios(spark, rows))
    got = {r.scenario_id: r for r in prep.pairs.collect()}
    assert set(got) == {"all", "late"} and got["all"].ego_n == 4 and got["all"].target_n == 3
    assert (got["all"].ego_lo, got["all"].ego_hi, got["late"].ego_lo, got["late"].target_lo) == (0, far + 40, far, far + 39)
    assert got["all"].ego_first.frame == 0 and got["late"].target_first.frame == far + 39
    d2 = {(e[2], t[2]): (e[3] - t[3]) ** 2 + (e[4] - t[4]) ** 2 for e in one for t in two}
    best = closest.closest_pair(prep).where("scenario_id = 'all'").first().best
    assert (best.ego_frame, best.target_frame) == min(d2, key=lambda k: (d2[k], k)) and best.d2 == pytest.approx(min(d2.values()))
    probes = blocks.role_view(prep.pairs, "target").where("scenario_id = 'all'")
    for at, near in ((far // 2, 1), (far // 2 + 30, far + 39), (-9, 1), (far * 3, far + 40)):
        assert lookup.nearest_sample(probes.selectExpr("*", f"{at}L as at"), prep.chunks).first().near.frame == near


def test_windows_against_plain_python(spark):
    """Random tracks with holes, windows at any place: counts, ends, runs and samples."""
    rng = np.random.default_rng(6)
    parts, frames = [], {}
    for k in range(1, 7):
        frames[k] = sorted({int(f) for f in rng.choice((0, 400_000, 3_000_000_000), 1) + np.cumsum(rng.choice([1, 1, 1, 2, 40, 20_000], 400))})
        parts.append([("r", k, f, float(i), float(k), 0.0, 1.0, 4.0, 2.0) for i, f in enumerate(frames[k])])
    rows = []
    for n in range(60):
        a, b = rng.choice(np.arange(1, 7), 2)
        lo = int(rng.choice(frames[a])) + int(rng.integers(-30, 30))
        rows.append((str(n), "x", int(a), int(b), lo, lo + int(rng.choice([0, 5, 300, 10 ** 6, 4 * 10 ** 9])), None))
    tr, sc = tracks(spark, *parts), scenarios(spark, rows)
    want = {(n, role, f) for n, _, a, b, lo, hi, _ in rows for role, k in (("ego", a), ("target", b)) for f in frames[k] if lo <= f <= hi}
    assert {(r.scenario_id, r.role, r.frame) for r in pairs.window_samples(sc, tr).select("scenario_id", "role", "frame").collect()} == want
    got = {r.scenario_id: r for r in pairs.prepare(tr, sc).pairs.collect()}
    for n, *_ in rows:
        e, t = (sorted(f for m, role, f in want if m == n and role == r) for r in ("ego", "target"))
        assert (n in got) == (min(len(e), len(t)) >= 2)
        if n in got:
            r = got[n]
            assert (r.ego_n, r.ego_lo, r.ego_hi, r.target_n, r.target_lo, r.target_hi) == (len(e), e[0], e[-1], len(t), t[0], t[-1])
            assert r.ego_first.frame == e[0]
            covered = {b for run in r.ego_cover.runs for b in range(run["from"], run["to"] + 1)}
            assert covered == {f // blocks.BLOCK for f in e}


def test_nearest_opens_at_most_three_blocks(spark):
    n = 3200
    tr = tracks(spark, straight(1, (0.0, 0.0), (1.0, 0.0), range(n), 0), straight(2, (0.0, 9.0), (1.0, 0.0), range(n), 0))
    prep = pairs.prepare(tr, scenarios(spark, [("a", "x", 1, 2, 0, n, None)]))
    probes = blocks.role_view(prep.pairs, "ego").selectExpr("*", "1000L as at", "62L as mid")
    assert sorted(probes.selectExpr(f"explode({lookup._AROUND}) as b").toPandas().b) == [61, 62, 63]
    assert lookup.nearest_sample(probes.drop("mid"), prep.chunks).first().near.frame == 1000


def test_closest_pair_by_rounds(spark):
    """Long tracks: several levels, no window function, and few node pairs of all."""
    rng = np.random.default_rng(2)
    n = 40_000
    walks = [np.cumsum(rng.normal(0, 1, (n, 2)), axis=0) + at for at in ((0, 0), (300, 0))]
    parts = [[("r", k, f, float(w[f, 0]), float(w[f, 1]), 0.0, 1.0, 4.0, 2.0) for f in range(n)] for k, w in enumerate(walks, 1)]
    prep = pairs.prepare(tracks(spark, *parts), scenarios(spark, [("a", "x", 1, 2, 5, n, None)]))
    found = closest.closest_pair(prep)
    assert "Window" not in plan(found)
    best = found.first().best
    e, t = (w[5:] for w in walks)
    least = min((((e - p) ** 2).sum(1).min(), 0) for p in t)[0]
    assert best.d2 == pytest.approx(least) and len(KEY) == 3
    assert closest.candidate_blocks(prep).count() < 0.02 * (n / 16) ** 2


def test_circle_and_zone_open_only_blocks_at_their_border(spark):
    """A long straight track: of hundreds of blocks only those near the circle's or the zone's border are opened."""
    n = 6400
    tr = tracks(spark, straight(1, (-3200.0, 0.0), (1.0, 0.0), range(n), 0), straight(2, (3200.0, -3200.0), (0.0, 1.0), range(n), 90))
    prep = pairs.prepare(tr, scenarios(spark, [("a", "x", 2, 1, 0, n, None)]))
    at = prep.pairs.selectExpr("*", "3000L as anchor_frame", "500D as radius")
    located = circle.sample_at(at, prep.chunks, "anchor_frame", "at")
    assert circle.crossing_blocks(located, prep.chunks).count() <= 6
    got = circle.circle_crossings(at, prep.chunks).first()
    assert got.q_in.x == pytest.approx(-700) and got.q_out.x == pytest.approx(300) and (got.q_in.frame, got.q_out.frame) == (2500, 3500)
    zones = prep.pairs.selectExpr(*KEY, "'target' as role", "target as track_id", "target_lo as lo", "target_hi as hi", "target_cover as cover",
                                  "0D as zone_x", "0D as zone_y", "2D as radius", "4D as length", "2D as width")
    assert pet.zone_blocks(zones, prep).count() <= 2
    got = pet.zone_enter_exit(zones, prep).first()
    assert (got.enter2, got.exit2) == (3196, 3204) and got.enter1 is None
