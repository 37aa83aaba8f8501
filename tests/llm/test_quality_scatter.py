"""The estimated scatter decides, not the floors; labels tell what it costs."""

import math
import random

import numpy as np
import pandas as pd

from crosspath.llm import quality

from .helpers import documents

SF = "/root/testdata/sf0.01"


def test_odd_word_lengths_and_repeated_lines_go(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prose = lambda longer=0: [word(rng.randrange(3, 8) + longer) for _ in range(150)]
    clean = [(i, " ".join(prose())) for i in range(300)]
    longer = [(1000 + i, " ".join(prose(2))) for i in range(10)]                      # 0.3 in the logarithm
    lines = [(2000 + i, " ".join(prose()) + "\nRead more" * 8) for i in range(10)]
    got = {r.doc_id: r for r in quality.verdicts(documents(spark, clean + longer + lines)).collect()}
    assert not any(got[i].base_failed for i, _ in longer + lines)
    assert not any(got[i].kept for i, _ in longer + lines)
    assert sum(got[i].kept for i, _ in clean) >= 0.99 * len(clean)


def test_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = quality.verdicts(spark.read.parquet(f"{SF}/documents.parquet")).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    print("quality 1 kept", sum(good), len(good), "quality 0 kept", sum(bad), len(bad))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.05 * len(bad)


def naive_scatter(x, floors, share=quality.SHARE):
    """The same search with exact ranks, all rows in memory."""
    n, p = x.shape
    factor = share / quality.chi_square(p + 2, quality.chi_square_quantile(p, share))
    median = np.median(x, 0)
    mad = 1.4826 * np.median(np.abs(x - median), 0)

    def step(center, inverse):
        d = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
        near = x[np.argsort(d, kind="stable")[:round(share * n)]]
        cov = np.cov(near.T, bias=True) * factor
        np.fill_diagonal(cov, np.maximum(np.sqrt(np.clip(np.diag(cov), 0, None)), floors) ** 2 * (1 + 1e-9))
        return np.linalg.slogdet(cov)[1], near.mean(0), np.linalg.inv(cov)

    found = []
    for center, spread in ((median, mad), (np.quantile(x, 0.25, 0), mad), (x.mean(0), x.std(0))):
        state = (0.0, center, np.diag(np.maximum(spread, floors) ** -2.0))
        for _ in range(quality.TRIALS):
            state = step(*state[1:])
        found.append(state)
    best = min(found, key=lambda s: s[0])
    while (after := step(*best[1:]))[0] < best[0] - quality.FALL:
        best = after
    return best


def test_a_start_in_clustered_outliers_is_left(spark):
    """A third of the rows in a tight far cluster draws means and medians; several groups, one of them without scatter."""
    rng = np.random.default_rng(9)
    rows = []
    for g, at in (("a", 0.0), ("b", 5.0)):
        rows += [(g, *map(float, r)) for r in rng.multivariate_normal([at, 1.0, 2.0], [[1, 0.5, 0], [0.5, 1, 0.2], [0, 0.2, 0.5]], 2000)]
        rows += [(g, *map(float, r)) for r in rng.normal(12, 0.3, (600, 3))]
    rows += [("c", 1.0, 1.0, 1.0)] * 80
    data = spark.createDataFrame(rows, "grp string, x double, y double, z double")
    floors = [1e-3] * 3
    got = {r.grp: r for r in quality.robust_scatter(data, ["x", "y", "z"], floors).collect()}
    for g in "ab":
        x = np.array([r[1:] for r in rows if r[0] == g])
        _, center, inverse = naive_scatter(x, floors)
        assert np.allclose(got[g].center, center, atol=0.05) and np.allclose(np.array(got[g].inverse).reshape(3, 3), inverse, rtol=0.15, atol=0.05)
        assert abs(center[1] - 1) < 0.2
    assert got["c"].center == [1.0, 1.0, 1.0]


def test_verdicts_equal_those_of_exact_ranks(spark):
    """``kept`` of every document against the search in memory, group by group."""
    rows = quality.verdicts(spark.read.parquet(f"{SF}/documents.parquet")).where("not base_failed and grp is not null").collect()
    groups, vectors = {}, {}
    for r in rows:
        n, chars = max(r.n_words, 1), max(r.word_chars, 1)
        vectors[r.doc_id] = (math.log(chars / n), (r.n_symbols / chars) ** 0.5, (r.n_dup_lines / n) ** 0.5, (r.n_repeat_words / n) ** 0.5, (r.n_capitals / chars) ** 0.5)
        groups.setdefault(r.grp, []).append(r)
    spread = np.std(list(vectors.values()), axis=0)
    floors = [max(f, quality.RELATIVE * s, quality.LEAST) for f, s in zip(quality.FLOORS.values(), spread)]
    bound = quality._scaled_bounds(5, quality.TAIL)
    differ = 0
    for members in groups.values():
        x = np.array([vectors[r.doc_id] for r in members])
        _, center, inverse = naive_scatter(x, floors)
        d = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
        limit = next(bound([pd.DataFrame({"grp": ["g"], "q": [np.quantile(d, [0.5, 0.75])]})])).bound[0]
        differ += sum(r.kept != (v <= limit) for r, v in zip(members, d))
    assert len(groups) >= 3 and differ <= 0.01 * len(rows)
