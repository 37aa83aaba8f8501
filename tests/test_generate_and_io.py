"""Control points, replay, run logs, file sources and sinks."""

import glob
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from checks import registry
from crosspath.operators.theta import arc_resample, theta_to_cps
from crosspath.plans import generate
from crosspath.plans.extract import extract_params
from crosspath.sources import runlog
from crosspath.sources.runlog import read_run_lines, tidy_run_log
from crosspath.sources.scenarios import check_scenarios, read_scenarios, with_class_settings, class_settings
from crosspath.sources.tables import read_table, write_table
from crosspath.sources.tracks import read_tracks
from crosspath.operators.blocks import role_view
from crosspath.operators.pairs import prepare

from .helpers import CONFIG, scenarios, straight, tracks

SF = "/root/testdata/sf0.001"


def test_angles_and_points_round_trip(spark):
    got = theta_to_cps(registry.ok_params(spark, SF)).toPandas()
    for p, q in (("p1", "qm"), ("p2", "qc"), ("p3", "qp")):
        assert np.allclose(got[[f"{p}_x", f"{p}_y"]], got[[f"{q}_x", f"{q}_y"]], atol=1e-9)


def test_control_points(spark):
    params = registry.params(spark, SF)
    got = generate.control_points(params).toPandas()
    assert len(got) == 3 * registry.ok_params(spark, SF).count() and sorted(got.point.unique()) == [1, 2, 3]
    assert set(got.weight[got.role != "q_c"]) == {5.0}
    with pytest.raises(ValueError, match="base_xosc"):
        generate.control_points(params.drop("base_xosc"))


def test_limit_and_names(spark):
    params = registry.params(spark, SF)
    assert generate.variants(params, 3).count() == 3
    assert generate.variants(params, 0).count() == generate.variants(params).count()
    named = spark.createDataFrame([("", "s1"), (None, "s2"), ("x", "s3")], "sample_id string, scenario_id string")
    assert [r[0] for r in named.select(generate.variant_name(named)).collect()] == ["s1", "s2", "x"]


def test_replay_and_end_time(spark):
    tr = tracks(spark, straight(1, (0.0, 0.0), (1.0, 0.0), range(5, 25), 90), straight(2, (0.0, 0.0), (1.0, 0.0), range(5), 0))
    sc = scenarios(spark, [("a", "x", 1, 2, 10, 20, None)])
    got = generate.ego_replay(sc, tr, 10.0).toPandas().sort_values("time_s")
    assert got.time_s.tolist() == [i / 10 for i in range(11)] and got.x.tolist() == list(range(5, 16))
    assert got.heading_rad.iloc[0] == 1.5708
    assert generate.run_end_time(sc, 10.0).first().t_end_s == 2.0


def test_resample_gaps_and_still_tracks(spark):
    corner = straight(1, (0.0, 0.0), (1.0, 0.0), range(0, 10), 0) + straight(1, (9.0, 3.0), (0.0, 1.0), range(100, 140), 90)
    still = straight(2, (5.0, 5.0), (0.0, 0.0), range(0, 140), 0)
    prep = prepare(tracks(spark, corner, still), scenarios(spark, [("a", "x", 2, 1, 0, 200, None), ("b", "x", 1, 2, 0, 200, None)]))
    got = arc_resample(role_view(prep.pairs, "target"), prep.chunks).toPandas().sort_values(["scenario_id", "i"])
    xy = np.array([r[3:5] for r in corner])
    s = np.r_[0, np.cumsum(np.hypot(*np.diff(xy, axis=0).T))]
    g = np.linspace(0, s[-1], 200)
    a, b = (got[got.scenario_id == k] for k in "ab")
    assert a.i.tolist() == b.i.tolist() == list(range(200))
    assert np.allclose(a.x, np.interp(g, s, xy[:, 0])) and np.allclose(a.y, np.interp(g, s, xy[:, 1]))
    assert (b.x == 5).all() and (b.y == 5).all()


LOG = """simulator log
version 1.0, built today
Index [-] , TimeStamp [s] , #1 Entity_Name [-] , #1 World_Position_X [m] , #1 World_Position_Y [m] , #1 World_Heading_Angle [rad] , #1 Current_Speed [m/s] , #2 Entity_Name [-] , #2 World_Position_X [m] , #2 World_Position_Y [m] , #2 World_Heading_Angle [rad] , #2 Current_Speed [m/s] ,
0, 0.0,  Ego , 1.0, 2.0, 0.0, 5.0, Agent1, 10.0, 20.0, 3.141592653589793, 6.0,
1, 0.1,  Ego , 1.5, 2.0, 0.0, 5.0, Agent1, 9.5, 20.0, 3.141592653589793, 6.0,

2, 0.2,  other , 2.0, 2.0, 0.0, 5.0, Agent1, 9.0, 20.0, 3.141592653589793, 6.0,
"""


def test_run_log(spark, tmp_path):
    for name in ("v1", "v2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.csv").write_text(LOG)
    got = tidy_run_log(read_run_lines(spark, str(tmp_path / "*" / "run.csv")), 100, 10.0).toPandas()
    assert len(got) == 12 and got.file.nunique() == 2
    one = got[got.file.str.contains("v1")].sort_values(["entity", "time_s"])
    assert one.entity.tolist() == ["Agent1"] * 3 + ["Ego"] * 3
    assert one.frame.tolist() == pytest.approx([100, 101, 102] * 2) and one.x.tolist() == [10, 9.5, 9, 1, 1.5, 2]
    assert one.heading_deg.tolist() == pytest.approx([180] * 3 + [0] * 3) and set(one.speed_mps) == {5.0, 6.0}


RAW = pd.DataFrame({"frame": [1, 2, 1], "trackId": [7, 7, 8], "xCenter": [0.5, 1.5, 3.0], "yCenter": [0.0, 1.0, 2.0],
                    "heading": [0.0, 10.0, 20.0], "lonVelocity": [9.0, 9.0, 9.0], "xVelocity": [3.0, 0.0, 1.0],
                    "yVelocity": [4.0, 0.0, 0.0], "length": [4.0] * 3, "width": [2.0] * 3})


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_read_tracks(spark, tmp_path, fmt):
    for rec in ("00", "01"):
        path = tmp_path / f"{rec}_tracks.{fmt}"
        RAW.to_parquet(path) if fmt == "parquet" else RAW.to_csv(path, index=False)
    got = read_tracks(spark, str(tmp_path), fmt, [7], r"(\d+)_tracks")
    rows = got.orderBy("recording_id", "frame").collect()
    assert [r.recording_id for r in rows] == ["00", "00", "01", "01"] and rows[0].speed == 5.0
    assert got.columns == ["recording_id", "track_id", "frame", "x", "y", "heading", "speed", "length", "width"]
    ids = spark.createDataFrame([(8,)], "track_id bigint")
    assert read_tracks(spark, str(tmp_path), fmt, ids, r"(\d+)_tracks").count() == 2
    if fmt == "parquet":
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "lonVelocity" not in plan and "PushedFilters: [EqualTo(trackId,7)]" in plan.replace("IsNotNull(trackId), ", "")


def test_scenario_list(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("scenario_id,class,ego,target,min_frame,max_frame,note,anchor_frame\n007,x,1,2,0,9,hello,\n8,y,3,4,0,9,,5.0\n")
    got = read_scenarios(spark, str(path)).orderBy("input_ordinal").collect()
    assert [r.scenario_id for r in got] == ["007", "8"] and got[0].note == "hello"
    assert got[0].anchor_frame is None and got[1].anchor_frame == 5 and got[0].base_xosc is None
    with pytest.raises(ValueError, match=r"missing columns \['class', 'target'\]"):
        check_scenarios(spark.createDataFrame([("a", 1, 2, 3)], "scenario_id string, ego int, min_frame int, max_frame int"))
    path.write_text("scenario_id,class,ego,target,min_frame,max_frame\n1,x,one,2,0,9\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_scenarios(spark, str(path)).collect()


def test_class_settings_overlay(spark):
    df = spark.createDataFrame([("cross",), ("heavy",), ("unknown",)], "class string")
    got = with_class_settings(df, class_settings(spark, CONFIG), CONFIG["default"]).toPandas().set_index("class")
    assert got.loc["cross", ["anchor", "L_m"]].tolist() == ["cross", 10.0] and got.loc["heavy", "middle_cp_weight"] == 8.0
    assert got.loc["unknown", ["anchor", "L_m"]].tolist() == ["pet", 10.0]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_stage_tables_are_lossless(spark, tmp_path, fmt):
    params = registry.params(spark, SF)
    write_table(params, str(tmp_path / "p"), fmt)
    back = read_table(spark, str(tmp_path / "p"), fmt, params.schema)
    key = ["recording_id", "scenario_id"]
    a, b = (df.select(params.columns).toPandas().sort_values(key).reset_index(drop=True) for df in (params, back))
    pd.testing.assert_frame_equal(a, b, check_exact=True)


def test_no_row_is_lost_without_tracks(spark):
    sc = scenarios(spark, [("a", "x", 1, 2, 0, 9, None)])
    got = extract_params(tracks(spark, straight(9, (0.0, 0.0), (1.0, 0.0), range(3), 0)), sc, CONFIG).collect()
    assert [r.status for r in got] == ["no_track"]


def test_many_logs_are_written_and_listed_by_a_given_number_of_tasks(spark):
    """Small logs are few bytes and many files: neither one task writes all, nor has each folder a task that lists it."""
    sf, tasks = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = glob.glob(f"{registry.run_files(spark, sf).removeprefix('file:')}/run=*/part-*")
    assert 1 < len({os.path.basename(f).split("-")[1] for f in written}) <= tasks < len(written)
    folder = tempfile.mkdtemp(dir="/tmp")
    spark.range(60).selectExpr("id as run", "'x' as line").repartition(1).write.partitionBy("run").text(f"{folder}/runs")
    before, sc = spark.conf.get(runlog.LISTING_TASKS), spark.sparkContext
    sc.setJobGroup("listing", "listing")
    lines = runlog.read_run_lines(spark, f"{folder}/runs")
    sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("listing") for s in track.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * sc.defaultParallelism and spark.conf.get(runlog.LISTING_TASKS) == before
    assert lines.select("file").distinct().count() == 60


def test_runs_are_written_and_read_a_bounded_number_at_a_time(spark, tmp_path, monkeypatch):
    """Neither a job nor a listing has all logs at once, and every line of every log comes back in its place."""
    lines = spark.range(60).selectExpr("concat('run ', id % 20, ' [a]') as run", "id div 20 as ord", "concat(id % 20, ' line ', id div 20) as line")
    monkeypatch.setattr(registry, "PACK", 6)
    monkeypatch.setattr(runlog, "BATCH", 3)
    folders = registry.write_runs(spark, lines, f"file://{tmp_path}/runs")
    held = [len(os.listdir(d)) for d in glob.glob(folders.removeprefix("file://"))]
    assert len(held) == 4 and max(held) < 40 and len(glob.glob(f"{tmp_path}/runs/pack=*/run=*")) == 20
    asked, read = [], runlog._read_text
    monkeypatch.setattr(runlog, "_read_text", lambda s, paths: asked.append(len(paths)) or read(s, paths))
    got = read_run_lines(spark, folders).collect()
    assert sum(asked) == 20 and max(asked) == 3
    logs = {}
    for r in sorted(got, key=lambda r: (r.file, r.ord.split, r.ord.row)):
        logs.setdefault(r.file, []).append(r.line)
    assert sorted(logs.values()) == sorted([f"{k} line {j}" for j in range(3)] for k in range(20))
    asked.clear()
    assert read_run_lines(spark, [f"{d}" for d in glob.glob(f"{tmp_path}/runs/pack=0")]).count() + read_run_lines(
        spark, [d for d in glob.glob(f"{tmp_path}/runs/pack=[1-9]")]).count() == 60
    (tmp_path / "empty").mkdir()
    assert read_run_lines(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_run_lines(spark, str(tmp_path / "missing"))
