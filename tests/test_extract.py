"""Hand-computed interactions, status ladder, and the NumPy restatement."""

import numpy as np
import pandas as pd
import pytest

from checks import fixture, registry
from checks import reference_numpy as ref
from crosspath.operators import blocks, closest, pairs, pet
from crosspath.plans.extract import extract_params, status_counts
from crosspath.sources.scenarios import class_settings

from .helpers import CONFIG, scenarios, straight, tracks

SF = "/root/testdata/sf0.001"
EAST, NORTH = (1.0, 0.0), (0.0, 1.0)


def crossing(spark, delay):
    """Ego eastward and target northward through the origin; target ``delay`` frames later."""
    return tracks(spark, straight(1, (-30.0, 0.0), EAST, range(61), 0),
                  straight(2, (0.0, -30.0), NORTH, range(delay, delay + 61), 90))


def one(spark, tr, row):
    return extract_params(tr, scenarios(spark, [row]), CONFIG).toPandas().iloc[0]


@pytest.mark.parametrize("delay", [20, 0])
def test_perpendicular_pet(spark, delay):
    prep = pairs.prepare(crossing(spark, delay), scenarios(spark, [("a", "x", 1, 2, 0, 100, None), ("b", "x", 2, 1, 0, 100, None)]))
    got = pet.pet(prep, 2.0, 10.0).toPandas().set_index("scenario_id")
    # Footprint 4 m, zone radius 2 m: each is in its zone from 4 frames before to 4 after.
    assert got.loc["a", ["enter1", "exit1", "enter2", "exit2"]].tolist() == [26, 34, 26 + delay, 34 + delay]
    expected = max(delay - 8, 0) / 10
    assert got.loc["a", "pet"] == pytest.approx(expected) and got.loc["b", "pet"] == pytest.approx(-expected)
    assert got.loc["a", "first_passer"] == (1 if delay else 0) and got.loc["b", "first_passer"] == (2 if delay else 0)


def test_geometry_of_a_straight_target(spark):
    got = one(spark, crossing(spark, 20), ("a", "cross", 1, 2, 0, 100, None))
    assert (got.status, got.anchor_kind, got.anchor_frame) == ("ok", "cross", 50)
    assert [got.qm_y, got.qc_y, got.qp_y] == pytest.approx([-10, 0, 10])
    assert [got.theta1_deg, got.theta2_deg, got.end_speed_kmh] == pytest.approx([0, 0, 36])
    assert [got.t_in_frame, got.t_out_frame] == pytest.approx([40, 60])


def test_parallel_tracks_fall_back_to_min_distance(spark):
    tr = tracks(spark, straight(1, (-30.0, 0.0), EAST, range(61), 0), straight(2, (-30.0, 5.0), EAST, range(61), 0))
    got = one(spark, tr, ("a", "x", 1, 2, 0, 100, None))
    assert got.anchor_method == "pet" and got.anchor_kind == "min_dist" and got.anchor_frame == 0


def test_statuses(spark):
    far = straight(3, (500.0, 500.0), EAST, range(1, 121, 2), 0)
    even = straight(4, (0.0, 0.0), EAST, range(0, 120, 2), 0)
    tr = crossing(spark, 20).union(tracks(spark, far, even, straight(5, (0.0, 0.0), EAST, [7], 0)))
    rows = [("ok", "cross", 1, 2, 0, 100, None), ("no_track", "x", 1, 5, 0, 100, None), ("no_track2", "x", 1, 2, 500, 600, None),
            ("no_anchor", "x", 3, 4, 0, 200, None), ("no_anchor_sample", "x", 1, 2, 0, 100, 5),
            ("both_unavailable", "cross", 1, 2, 45, 55, None), ("q_in_unavailable", "cross", 1, 2, 45, 100, None),
            ("q_out_unavailable", "cross", 1, 2, 0, 55, None), ("degenerate_geometry", "tiny", 1, 2, 0, 100, None),
            ("given", "x", 1, 2, 0, 100, 50), ("weight", "heavy", 1, 2, 0, 100, 50)]
    got = extract_params(tr, scenarios(spark, rows), CONFIG).toPandas().set_index("scenario_id")
    assert len(got) == len(rows)
    for name in got.index:
        expected = {"no_track2": "no_track", "given": "ok", "weight": "ok"}.get(name, name)
        assert got.loc[name, "status"] == expected, name
    assert got.loc["given", "anchor_method"] == "given" and got.loc["no_anchor_sample", "anchor_frame"] == 5
    assert got.loc["weight", "middle_cp_weight"] == 8.0 and np.isnan(got.loc["given", "middle_cp_weight"])
    assert np.isnan(got.loc["q_in_unavailable", "qm_x"]) and got.loc["q_in_unavailable", "qp_y"] == pytest.approx(10)
    counts = status_counts(spark.createDataFrame(got[["status"]])).toPandas().set_index("status").n
    assert counts["ok"] == 3 and counts["no_track"] == 2


def test_start_heading(spark):
    """q_in half a meter after the track start: the incoming direction is the start heading."""
    got = one(spark, tracks(spark, straight(1, (-30.0, 0.0), EAST, range(61), 0),
                            straight(2, (0.0, -10.5), NORTH, range(30, 60), 90)), ("a", "cross", 1, 2, 0, 100, None))
    assert got.status == "ok" and got.u1_source == "start_heading" and got.u1_y == pytest.approx(1.0)


def test_repeated_frames_and_broken_samples(spark):
    copies = [("r", 2, 50, 99.0, 99.0, 90.0, 1.0, 4.0, 2.0)] * 50 + [("r", 2, 49, float("nan"), 0.0, 90.0, 1.0, 4.0, 2.0)]
    got = one(spark, crossing(spark, 20).union(tracks(spark, copies)), ("a", "cross", 1, 2, 0, 100, None))
    assert got.anchor_frame == 50 and got.qc_y == pytest.approx(0)


def test_unknown_method_is_rejected(spark):
    with pytest.raises(ValueError, match="no known anchor method"):
        class_settings(spark, {"classes": {"a": {"anchor": "nearest"}}})


def test_matches_numpy(spark):
    got = registry.params(spark, SF).toPandas().set_index(["recording_id", "scenario_id"])
    all_tracks = registry.tracks(spark, SF).toPandas()
    for _, row in registry.scenarios(spark, SF).toPandas().iterrows():
        for name, value in ref.extract(row, all_tracks, fixture.CONFIG).items():
            mine = got.loc[(row.recording_id, row.scenario_id), name]
            assert mine == value or mine == pytest.approx(value, abs=1e-6), (row.scenario_id, name)


def test_chords_have_length_l(spark):
    ok = registry.ok_params(spark, SF).toPandas()
    assert np.allclose(ok.L1, ok.L_m) and np.allclose(ok.L2, ok.L_m)


def test_long_and_crowded_track(spark, monkeypatch):
    """One ego track with far more samples than the rest, used by every interaction."""
    monkeypatch.setattr(blocks, "HOT", 3)
    rng = np.random.default_rng(1)
    n = 6000
    walk = np.cumsum(rng.normal(0, 1, (n, 2)), axis=0)
    hot = [("r", 1, f, float(walk[f, 0]), float(walk[f, 1]), 0.0, 1.0, 4.0, 2.0) for f in range(n)]
    others, rows = [], []
    for k in range(2, 10):
        at = rng.integers(0, n - 400)
        path = walk[at] + np.cumsum(rng.normal(0, 2, (300, 2)), axis=0) + rng.normal(0, 20, 2)
        others.append([("r", k, int(at + f), float(path[f, 0]), float(path[f, 1]), 0.0, 1.0, 4.0, 2.0) for f in range(300)])
        rows.append((str(k), "x", 1, k, 0, n, None))
    tr = tracks(spark, hot, *others)
    prep = pairs.prepare(tr, scenarios(spark, rows))
    assert prep.chunks.where("salt > 0").count() > 0
    got = closest.closest_pair(prep).select("scenario_id", "best.*").toPandas().set_index("scenario_id")
    e = pd.DataFrame(hot)[[2, 3, 4]].to_numpy()
    for part in others:
        t = pd.DataFrame(part)[[2, 3, 4]].to_numpy()
        d2 = ((e[:, None, 1:] - t[None, :, 1:]) ** 2).sum(-1)
        i, j = np.unravel_index(d2.argmin(), d2.shape)
        g = got.loc[str(part[0][1])]
        assert (g.ego_frame, g.target_frame) == (e[i, 0], t[j, 0]) and g.d2 == pytest.approx(d2[i, j])
    # Far fewer block pairs survive than there are.
    assert closest.candidate_blocks(prep).count() < 0.1 * len(others) * (n / 16) * (300 / 16)


def test_crowding_does_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HOT", 1)
    salted = extract_params(registry.tracks(spark, SF), registry.scenarios(spark, SF), fixture.CONFIG).toPandas()
    plain = registry.params(spark, SF).toPandas()
    key = ["recording_id", "scenario_id"]
    pd.testing.assert_frame_equal(salted.sort_values(key).reset_index(drop=True), plain.sort_values(key).reset_index(drop=True))


def test_parked_vehicles(spark):
    """Thousands of equal distances: the first frames win and few block pairs are opened."""
    n = 2000
    tr = tracks(spark, straight(1, (0.0, 0.0), (0.0, 0.0), range(n), 0), straight(2, (3.0, 4.0), (0.0, 0.0), range(7, n), 0))
    prep = pairs.prepare(tr, scenarios(spark, [("a", "x", 1, 2, 0, n, None), ("b", "x", 2, 1, 5, n, None)]))
    got = closest.closest_pair(prep).select("scenario_id", "best.*").toPandas().set_index("scenario_id")
    assert got.loc["a", ["d2", "ego_frame", "target_frame"]].tolist() == [25, 0, 7]
    assert got.loc["b", ["d2", "ego_frame", "target_frame"]].tolist() == [25, 7, 5]
    assert closest.crossing_frame(prep).selectExpr("best.target_frame as f").toPandas().f.tolist() in ([7, 5], [5, 7])
    assert closest.candidate_blocks(prep).count() < 100
