"""Kernel density fit, counter-based draws, sample table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import registry
from crosspath.functions.random import normal, uniform
from crosspath.operators import kde, sampling
from crosspath.plans.sample import classes_in_order, sample_params, usable_params
from crosspath.schema import PARAMETERS

SF = "/root/testdata/sf0.001"


def params(spark, groups, status="ok"):
    rows = [("r", f"s{i}", name, status, i, *map(float, v)) for i, (name, v) in enumerate(
        (name, v) for name, values in groups.items() for v in values)]
    return spark.createDataFrame(rows, "recording_id string, scenario_id string, class string, status string, "
                                       "input_ordinal bigint, theta1_deg double, theta2_deg double, end_speed_kmh double")


def loo(v, h):
    d2 = ((v[:, None] - v[None]) ** 2).sum(-1)
    k = np.exp(-d2 / (2 * h * h))
    np.fill_diagonal(k, 0)
    return np.log(np.maximum(k.sum(1) / ((len(v) - 1) * (2 * np.pi) ** 1.5 * h ** 3), 1e-300)).sum()


def best_bandwidth(v):
    """Dense scan around the best point of a wide grid."""
    h0 = (v.std(0) > 1e-12).mean() * (4 / (5 * len(v))) ** (1 / 7)
    lo, hi = np.log(h0 / 20), np.log(h0 * 20)
    step = (hi - lo) / 59
    center = lo + step * np.argmax([loo(v, np.exp(lo + step * k)) for k in range(60)])
    for _ in range(6):
        grid = np.linspace(max(center - step, lo), min(center + step, hi), 41)
        center, step = grid[np.argmax([loo(v, np.exp(g)) for g in grid])], (grid[1] - grid[0])
    return np.exp(center)


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    a = rng.normal([10, -20, 30], [5, 8, 6], (60, 3))
    return {"a": a, "copies": np.repeat(rng.normal(0, 3, (9, 3)), [1, 5, 1, 1, 3, 1, 1, 1, 1], axis=0),
            "one": [[1, 2, 3]], "flat": [[1, 2, 3]] * 4, "plane": np.c_[rng.normal(0, 1, (12, 2)), np.full(12, 7.0)]}


def test_bandwidth_and_skipped_classes(spark, groups, monkeypatch):
    monkeypatch.setattr(kde, "TILE", 16)
    monkeypatch.setattr(kde, "RUN", 2)
    df = params(spark, groups)
    report = kde.class_report(df).toPandas().set_index("class")
    assert report.loc["one", "reason"] == "needs_two_rows" and report.loc["flat", "reason"] == "zero_variance"
    model = kde.fit_kde(df).toPandas().set_index("class")
    assert sorted(model.index) == ["a", "copies", "plane"]
    for name in ("a", "plane"):
        v = np.asarray(groups[name], float)
        sd = np.where(v.std(0) < 1e-12, 1, v.std(0))
        assert model.loc[name, "h"] == pytest.approx(best_bandwidth((v - v.mean(0)) / sd), rel=1e-6)


def test_copies_count_in_the_likelihood(spark, groups):
    df = params(spark, {"copies": groups["copies"]})
    moments = kde.usable_moments(df)
    z = kde.standardize(df, moments)
    got = kde.loo_likelihood(kde._tiles(z, 3), kde.initial_grid(moments)).toPandas()
    v = z.select("z1", "z2", "z3").toPandas().to_numpy()
    for _, row in got.iterrows():
        assert row.ll == pytest.approx(loo(v, row.h), rel=1e-9)


def test_pairs_of_groups_are_spread_over_tasks(spark, groups, monkeypatch, tmp_path):
    """Few bytes are much work here: pairs must not be put into one task by their size."""
    original = kde._pair_sums

    def noted(dims):
        run, folder = original(dims), str(tmp_path)

        def noting(pdf):
            from pyspark import TaskContext
            open(f"{folder}/{TaskContext.get().partitionId()}", "w").close()
            return run(pdf)

        return noting

    monkeypatch.setattr(kde, "_pair_sums", noted)
    monkeypatch.setattr(kde, "TILE", 4)
    monkeypatch.setattr(kde, "RUN", 1)
    df = params(spark, {"a": groups["a"]})
    moments = kde.usable_moments(df)
    kde.loo_likelihood(kde._tiles(kde.standardize(df, moments), 3), kde.initial_grid(moments)).count()
    assert len(list(tmp_path.iterdir())) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tiles_do_not_change_the_density(spark, groups, monkeypatch):
    df = params(spark, {"a": groups["a"]})
    z = kde.standardize(df, kde.usable_moments(df))
    band = kde.usable_moments(df).select("class", "n", F.lit(0.5).alias("h"))
    whole = kde.loo_density(z, band).toPandas().sort_values("input_ordinal").density.to_numpy()
    monkeypatch.setattr(kde, "TILE", 7)
    monkeypatch.setattr(kde, "RUN", 2)
    tiled = kde.loo_density(z, band).toPandas().sort_values("input_ordinal").density.to_numpy()
    assert np.allclose(whole, tiled)


def test_random_numbers(spark):
    draws = spark.range(1, 20001)
    got = draws.select(uniform(1, F.col("id"), "0").alias("u"), normal(1, F.col("id"), "1").alias("z")).toPandas()
    assert 0 < got.u.min() and got.u.max() < 1 and abs(got.u.mean() - 0.5) < 0.01
    assert abs(got.z.mean()) < 0.03 and abs(got.z.std() - 1) < 0.02


def test_draws_have_the_right_moments_and_do_not_depend_on_layout(spark, groups):
    df = params(spark, {"a": groups["a"]})
    model = kde.fit_kde(df)
    h = model.first().h
    got = sampling.dependent_samples(df, model, 20000, 7).select("draw", "kernel", *PARAMETERS)
    other = sampling.dependent_samples(df.repartition(7), model.repartition(3), 20000, 7).select("draw", "kernel", *PARAMETERS)
    a, b = (x.toPandas().sort_values("draw").reset_index(drop=True) for x in (got, other))
    pd.testing.assert_frame_equal(a, b)
    v, s = np.asarray(groups["a"]), a[PARAMETERS].to_numpy()
    assert sorted(a.draw) == list(range(1, 20001)) and set(a.kernel) == set(range(60))
    assert np.allclose(s.mean(0), v.mean(0), atol=0.3)
    assert np.allclose(np.cov(s.T, bias=True), np.cov(v.T, bias=True) + h * h * np.diag(v.var(0)), rtol=0.1, atol=2)
    around = sampling.conditional_samples(df, model, 3, 5000, 7).toPandas()
    assert np.allclose(around[PARAMETERS].mean(), v[3], atol=0.5)


def test_kernel_index_over_buckets(spark, groups):
    df = params(spark, groups)
    got = kde.kernel_index(df, bucket=7).toPandas().sort_values("input_ordinal")
    assert (got.kernel == got.groupby("class").cumcount()).all()


def test_sample_table(spark, groups):
    df = params(spark, {"b": [[0, 0, 0.1], [1, 2, 0.2], [3, 1, 0.1]], **groups}).union(params(spark, {"bad": groups["a"]}, "no_track"))
    assert classes_in_order(df).orderBy("first_seen").first()["class"] == "b"
    got = sample_params(df, 30, 11, ["a", "b", "one", "bad"]).toPandas()
    assert set(got["class"]) == {"a", "b"} and len(got) == 60 and list(got.columns)[0] == "sample_id"
    assert "b__seed11__draw000030" in set(got.sample_id) and (got.end_speed_kmh >= 0).all() and (got.end_speed_kmh == 0).any()
    assert got.center_theta1_deg.isin(df.toPandas().theta1_deg).all()
    with pytest.raises(ValueError, match="no class"):
        sample_params(usable_params(df, ["one", "flat"]))


def test_far_tiles_are_skipped_and_pairs_evaluated_once(spark, monkeypatch):
    """Two clusters far apart: the sums stay those of all pairs, and no pair of groups is evaluated twice or across the gap."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, (120, 3)), rng.normal(900, 1, (120, 3))])
    df = params(spark, {"a": v.tolist()})
    moments = kde.usable_moments(df)
    z = kde.standardize(df, moments)
    monkeypatch.setattr(kde, "TILE", 16)
    monkeypatch.setattr(kde, "RUN", 2)
    grid = moments.select("class", "n", F.array(F.lit(0.001), F.lit(0.01)).alias("hs"))
    asked, original = [], kde._pair_sums
    monkeypatch.setattr(kde, "_pair_sums", lambda dims: asked.append(dims) or original(dims))
    got = {r.h: r.ll for r in kde.loo_likelihood(kde._tiles(z, 3), grid).collect()}
    points = z.select("z1", "z2", "z3").toPandas().to_numpy()
    for h in (0.001, 0.01):
        assert got[h] == pytest.approx(loo(points, h), rel=1e-9)
    tiles = kde._tiles(z, 3)
    groups = tiles.groupBy("grp").agg(F.min(F.col("low")[0]).alias("low"), F.max(F.col("high")[0]).alias("high")).collect()
    assert asked and len(groups) >= 8 and sum(g.high - g.low > 1 for g in groups) <= 1      # groups are compact: at most one spans the gap


def test_copies_of_centers_do_not_change_the_draws(spark, groups, monkeypatch):
    df = params(spark, {"b": [[0, 0, 0.1], [1, 2, 0.2]], "a": groups["a"]})
    model = kde.fit_kde(df)
    columns = ["class", "draw", "kernel", *PARAMETERS, "input_ordinal"]
    plain = sampling.dependent_samples(df, model, 1500, 3).select(columns).toPandas().sort_values(["class", "draw"]).reset_index(drop=True)
    monkeypatch.setattr(sampling, "SHARE", 100)
    split = sampling.dependent_samples(df, model, 1500, 3)
    pd.testing.assert_frame_equal(plain, split.select(columns).toPandas().sort_values(["class", "draw"]).reset_index(drop=True))
    assert split.columns == sampling.dependent_samples(df, model, 50, 3).columns


def pair_frame(tiles, n, hs, same):
    """What a task gets for a pair of groups of one tile each, or for a group with itself."""
    return pd.DataFrame([{"class": "a", "tile": i, "grp": i, "a": 0, "b": 0 if same else 1, "n": n, "hs": hs, "points": np.c_[x, w].ravel(),
                          "low": x.min(0), "high": x.max(0), "near": kde._nearest(x, w)} for i, (x, w) in enumerate(tiles)])


@pytest.mark.parametrize("hs", [0.01 * 2 ** (np.arange(71) / 8), 1 / np.sqrt(np.linspace(400, 200, 16)), np.array([2.0, 0.03, 0.4])])
def test_kernels_by_products_are_those_of_exp(monkeypatch, hs):
    """Sums equal those of plain kernels, also of vectors far from all others; few exponentials are taken, and none where no sum can feel it."""
    rng = np.random.default_rng(8)
    x, y = (rng.normal(0, 1, (300, 3))[np.argsort(rng.normal(0, 1, 300))] for _ in range(2))
    x, y = x[np.argsort(x[:, 0])], y[np.argsort(y[:, 0])]
    x[7], y[5] = (9, 9, 9), (9.5, 9, 9)
    w, v = rng.integers(1, 4, (2, 300)).astype(float)
    w[7] = v[5] = 1
    taken, original = [], np.exp
    monkeypatch.setattr(np, "exp", lambda a, *rest, **named: taken.append(np.size(a)) or original(a, *rest, **named))
    got = kde._pair_sums(3)(pair_frame([(x, w), (y, v)], 1200, hs, False))["sums"].to_list()
    count = sum(taken)
    itself = kde._pair_sums(3)(pair_frame([(x, w)], 1200, hs, True))["sums"][0]
    monkeypatch.undo()
    d2, own = ((x[:, None] - y[None]) ** 2).sum(-1), ((x[:, None] - x[None]) ** 2).sum(-1)
    others = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(own, np.inf)
    np.fill_diagonal(others, np.inf)
    for k, h in enumerate(hs):
        kernel, inside = np.exp(-d2 / (2 * h * h)), np.exp(-own / (2 * h * h)) @ w + (w - 1)
        whole_x, whole_y = inside + kernel @ v, np.exp(-others / (2 * h * h)) @ v + (v - 1) + w @ kernel
        for part, want, whole in ((got[0], kernel @ v, whole_x), (got[1], w @ kernel, whole_y), (itself, inside, whole_x)):
            assert (np.abs(part.reshape(len(hs), -1)[k] - want) <= 1e-11 * whole + 1e-290).all()
    assert count < (0.3 if len(hs) > 3 else 1) * len(hs) * d2.size


def test_search_takes_bandwidths_whose_kernels_are_squares(spark, groups):
    moments = kde.usable_moments(params(spark, {"a": groups["a"]}))
    grid, size = kde.search_grid(moments)
    hs = np.array(grid.first().hs)
    plain = np.array(kde.initial_grid(moments).first().hs)
    assert len(hs) == size and hs[0] == pytest.approx(plain[0]) and hs[-1] >= plain[-1] * (1 - 1e-12) and (np.diff(np.log(hs)) < np.diff(np.log(plain)).max()).all()
    assert sum(not s for s in kde._from_before(0.5 / hs[::-1] ** 2)) <= 3 * kde.CHAINS
    bracket = spark.createDataFrame([("a", 60, -2.0, -1.8)], "class string, n bigint, lo double, hi double")
    fine = np.array(kde._even_grid(bracket, kde.REFINE).first().hs)
    assert kde._evenly(0.5 / fine[::-1] ** 2) and np.log(fine[[0, -1]]) == pytest.approx([-2.0, -1.8])
