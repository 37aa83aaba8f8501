"""No silent loss: stable list order, missing settings and values, empty draws."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from crosspath.operators import kde, sampling
from crosspath.plans.extract import extract_params
from crosspath.plans.generate import control_points
from crosspath.sources import runlog
from crosspath.sources.runlog import tidy_run_log
from crosspath.sources.scenarios import check_scenarios, class_settings, read_scenarios, with_class_settings
from crosspath.operators.blocks import block_of

from .helpers import CONFIG, scenarios, straight, tracks


def test_a_shuffled_list_without_ordinals_loses_nothing(spark):
    n = 400
    walk = tracks(spark, straight(1, (0.0, 0.0), (1.0, 0.0), range(40), 0), straight(2, (20.0, -20.0), (0.0, 1.0), range(40), 90),
                  straight(3, (0.0, 9.0), (0.0, 0.0), range(40), 0))
    rows = spark.range(n).selectExpr("'r' as recording_id", "cast(id as string) as scenario_id", "'cross' as class", "1 as ego", "2 as target",
                                     "0 as min_frame", "39 as max_frame", "repeat(cast(id as string), 500) as wide")
    got = extract_params(walk, check_scenarios(rows.repartition(7, "wide")), CONFIG).groupBy("status").count().collect()
    assert [(r["status"], r["count"]) for r in got] == [("ok", n)]


def test_list_files_are_numbered_by_name_and_row(spark, tmp_path):
    for name, first in (("b", 100), ("a", 0)):
        (tmp_path / f"{name}.csv").write_text("scenario_id,class,ego,target,min_frame,max_frame\n" + "".join(f"{first + i},x,1,2,0,9\n" for i in range(50)))
    got = [int(r.scenario_id) for r in read_scenarios(spark, str(tmp_path)).orderBy("input_ordinal").collect()]
    assert got == [*range(50), *range(100, 150)]


def test_missing_settings_and_files_fail(spark):
    with pytest.raises(ValueError, match="sets 'L'"):
        class_settings(spark, {"default": {"anchor": "pet"}, "classes": {"a": {}}})
    settings = class_settings(spark, {"default": {"anchor": "pet"}, "classes": {"a": {"L": 3.0}}})
    df = spark.createDataFrame([("a",), ("unlisted",)], "class string")
    with pytest.raises(Exception, match="sets no 'L', needed by class unlisted"):
        with_class_settings(df, settings, {"anchor": "pet"}).collect()
    assert with_class_settings(df.where("class = 'a'"), settings, {"anchor": "pet"}).first().L_m == 3.0
    walk = tracks(spark, straight(1, (0.0, 0.0), (1.0, 0.0), range(40), 0), straight(2, (20.0, -20.0), (0.0, 1.0), range(40), 90))
    params = extract_params(walk, scenarios(spark, [("s1", "cross", 1, 2, 0, 39, None)]), CONFIG)
    assert params.first().status == "ok"
    with pytest.raises(Exception, match="no base_xosc for scenario s1"):
        control_points(params).collect()


def test_draw_counts(spark):
    model = spark.createDataFrame([("a", 5)], "class string, n bigint")
    assert sampling.draw_numbers(model, 0).count() == 0
    assert sorted(r.draw for r in sampling.draw_numbers(model, 1001).collect()) == list(range(1, 1002))
    with pytest.raises(ValueError):
        sampling.draw_numbers(model, -1)


def test_incomplete_vectors_take_no_part(spark):
    rows = [("a", float(i % 7), float(i % 5), float(i), i) for i in range(40)]
    schema = "class string, theta1_deg double, theta2_deg double, end_speed_kmh double, input_ordinal bigint"
    ids = {"recording_id": F.lit("r"), "scenario_id": F.col("input_ordinal").cast("string")}
    full = spark.createDataFrame(rows, schema).withColumns(ids)
    holes = spark.createDataFrame([*rows, ("a", 1.0, None, 2.0, 40), ("a", float("nan"), 1.0, 2.0, 41), ("b", None, 1.0, 1.0, 42), ("b", 1.0, None, 1.0, 43)],
                                  schema).withColumns(ids)
    got, want = kde.fit_kde(holes).where("class = 'a'").first(), kde.fit_kde(full).first()
    assert got.n == want.n == 40 and list(got[2:]) == pytest.approx(list(want[2:]), rel=1e-9)
    report = {r["class"]: (r.n, r.missing_values, r.reason) for r in kde.class_report(holes).collect()}
    assert report == {"a": (40, 2, None), "b": (0, 2, "missing_values")}
    assert kde.kernel_index(holes).count() == 40


def test_wide_run_log(spark):
    labels = ["Entity_Name [-]", "World_Position_X [m]", "World_Position_Y [m]", "World_Heading_Angle [rad]", "Current_Speed [m/s]"]
    head = ", ".join(["Index [-]", "TimeStamp [s]"] + [f"#{n} {x}" for n in (1, 2, 3) for x in labels])
    lines = [("f", 0, "version"), ("f", 1, head), ("f", 2, "0, 0.5, a, 1, 2, 0, 3, b, 4, 5, 0, 6, c, 7, 8, 0, ")]
    got = tidy_run_log(spark.createDataFrame(lines, "file string, ord bigint, line string"), 10, 10.0).orderBy("entity").collect()
    assert [(r.entity, r.x, r.y, r.speed_mps, r.frame) for r in got] == [("a", 1.0, 2.0, 3.0, 15.0), ("b", 4.0, 5.0, 6.0, 15.0), ("c", 7.0, 8.0, None, 15.0)]


def test_block_numbers_are_exact(spark):
    frames = [-17, -16, -1, 0, 15, 16, 2 ** 62 + 31]
    got = spark.createDataFrame([(f,) for f in frames], "frame bigint").selectExpr(f"{block_of('frame')} as b").collect()
    assert [r.b for r in got] == [f // 16 for f in frames]


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from crosspath.operators import kde
rows = spark.range(20).selectExpr("'a' as class", "cast(id as double) as theta1_deg", "id % 3 * 1D as theta2_deg", "id % 5 * 1D as end_speed_kmh")
print("bandwidth", kde.fit_kde(rows).first().h)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "bandwidth" in done.stdout, done.stderr[-2000:]


def test_one_run_log_over_many_stretches(spark, monkeypatch):
    """A log with a late header, an early blank stretch after it and a second header-like line, cut into stretches of 4 lines."""
    monkeypatch.setattr(runlog, "CHUNK", 4)
    head = "Index [-], TimeStamp [s], #1 Entity_Name [-], #1 World_Position_X [m], #2 Entity_Name [-], #2 World_Position_X [m]"
    body = [f"{i}, {i / 10}, {'a' if i == 0 else 'x'}, {i}, b, {-i}" for i in range(50)]
    text = ["0, 0, not, 1, yet, 2"] * 6 + [head, "", " ", "", "", "", ""] + body + ["Index of nothing"]
    lines = [("f", i, line) for i, line in enumerate(text)] + [("no header", i, "0, 1") for i in range(9)] + [("bare", 0, head)]
    for order in ("ord", "named_struct('split', ord div 10 * 100, 'row', (9 - ord div 10) * 1000 + ord % 10)"):
        rows = spark.createDataFrame(lines, "file string, ord bigint, line string").selectExpr("file", f"{order} as ord", "line", "5 as start").repartition(3)
        got = tidy_run_log(rows, F.col("start"), 10.0)
        assert "Window" not in got._jdf.queryExecution().toString()
        kept = sorted((r.entity, r.x) for r in got.where("time_s is not null").collect())
        assert kept == sorted([("a", float(i)) for i in range(50)] + [("b", float(-i)) for i in range(50)])
        assert {r.frame - r.time_s * 10 for r in got.where("time_s is not null").collect()} == {5.0}
        assert got.where("time_s is null").count() == 2 and {r.file for r in got.collect()} == {"f"}
