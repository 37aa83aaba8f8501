"""Row limits over several buckets, rejected samples, copies of crowded blocks, stored tables."""

from crosspath import staging
from crosspath.operators import blocks, pairs
from crosspath.plans import generate

from .helpers import scenarios, straight, tracks


def test_limit_over_buckets_equals_sorted_rows(spark, monkeypatch):
    monkeypatch.setattr(generate, "ORDINALS", 4)
    rows = [(f"r{i % 3}", f"s{i}", i // 3 * 3 if i % 7 else None, "ok" if i % 5 else "no_track") for i in range(60)]
    params = spark.createDataFrame(rows, "recording_id string, scenario_id string, input_ordinal bigint, status string").repartition(3)
    wanted = sorted((r for r in rows if r[3] == "ok"), key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]))
    for limit in (1, 5, 17, 1000):
        assert sorted(map(str, generate.variants(params, limit).collect())) == sorted(
            map(str, params.where("status = 'ok'").orderBy("input_ordinal", "recording_id", "scenario_id").limit(limit).collect()))
        assert {r.scenario_id for r in generate.variants(params, limit).collect()} == {r[1] for r in wanted[:limit]}
    assert generate.variants(params.limit(0), 3).count() == 0


def test_rejected_samples_are_counted(spark):
    bad = [("r", 1, None, 0.0, 0.0, 0.0, 1.0, 4.0, 2.0), ("r", 1, 9, None, 0.0, 0.0, 1.0, 4.0, 2.0), ("r", 1, 10, 0.0, float("nan"), 0.0, 1.0, 4.0, 2.0)]
    got = blocks.rejected_samples(tracks(spark, straight(1, (0.0, 0.0), (1.0, 0.0), range(5), 0), bad, straight(2, (0.0, 0.0), (1.0, 0.0), range(3), 0)))
    assert sorted(map(tuple, got.collect())) == [("r", 1, 8, 3), ("r", 2, 3, 0)]


def test_only_crowded_blocks_are_copied(spark, monkeypatch):
    """Two crowded blocks at the ends of a track: nothing between them is copied."""
    monkeypatch.setattr(blocks, "HOT", 2)
    n = 1600
    tr = tracks(spark, straight(1, (0.0, 0.0), (1.0, 0.0), range(n), 0), straight(2, (5.0, 0.0), (1.0, 0.0), range(n), 0))
    rows = [(f"a{k}", "x", 1, 2, 0, 15, None) for k in range(5)] + [(f"b{k}", "x", 1, 2, n - 16, n - 1, None) for k in range(5)]
    prep = pairs.prepare(tr, scenarios(spark, [*rows, ("all", "x", 1, 2, 0, n - 1, None)]))
    copies = {r["block"]: r["count"] for r in prep.chunks.where("track_id = 1").groupBy("block").count().collect()}
    assert copies == {b: 3 if b in (0, n // 16 - 1) else 1 for b in range(n // 16)}
    assert prep.pairs.count() == 11 and prep.pairs.where("scenario_id = 'all'").first()["ego_n"] == n


def test_stored_tables_are_dropped(spark):
    staging.stage_bucketed(spark.range(5), ["id"])
    staging.drop_tables(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("crosspath_")]
