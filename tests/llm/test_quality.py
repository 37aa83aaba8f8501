import random
import re

import numpy as np
from pyspark.sql import functions as F

from crosspath.llm import quality

from .helpers import PROSE, SF, awkward, documents


def naive_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def compare(docs, rows):
    got = quality.verdicts(docs).collect()
    want = sorted((str(r[0]), *naive_counts(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    return got


def test_counts_of_whole_table_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    compare(docs, [(r.doc_id, r.text) for r in docs.collect()])
    compare(documents(spark), awkward())
    assert quality.verdicts(documents(spark, [])).count() == 0


def test_repeated_windows_by_doubling():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        assert quality.text_counts(" ".join(words).encode())[4] == naive_counts(" ".join(words))[4]


def test_chi_square():
    assert abs(quality.chi_square_quantile(2, 0.95) - 5.991465) < 1e-5 and abs(quality.chi_square(5, 4.351460) - 0.5) < 1e-6


def test_estimates_resist_a_third_of_outliers_and_match_numpy(spark):
    rng = np.random.default_rng(5)
    good = rng.multivariate_normal([1.0, 2.0], [[0.5, 0.3], [0.3, 0.4]], 3000)
    bad = rng.normal(40, 0.1, (900, 2))
    data = spark.createDataFrame([("g", float(x), float(y)) for x, y in np.vstack([good, bad])], "grp string, x double, y double")
    row = quality.robust_scatter(data, ["x", "y"], [1e-6, 1e-6], share=0.75, steps=8).first()
    # all rows in memory: the same steps with exact ranks instead of bins
    allof, h = np.vstack([good, bad]), int(0.75 * 3900)
    mean, cov = np.median(allof, 0), np.diag((1.4826 * np.median(np.abs(allof - np.median(allof, 0)), 0)) ** 2)
    factor = 0.75 / quality.chi_square(4, quality.chi_square_quantile(2, 0.75))
    for _ in range(8):
        d = np.einsum("ij,jk,ik->i", allof - mean, np.linalg.inv(cov), allof - mean)
        near = allof[np.argsort(d)[:h]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) * factor
    assert np.allclose(row.center, mean, atol=0.02)
    assert np.allclose(np.array(row.inverse).reshape(2, 2), np.linalg.inv(cov), rtol=0.1)


def test_outliers_go_clean_documents_stay(spark):
    rng = random.Random(1)
    vocabulary = PROSE.lower().split()
    clean = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 90)))) for i in range(200)]
    junk = [(1000 + i, " ".join(rng.choice(vocabulary) + "***" for _ in range(50))) for i in range(20)]
    docs = documents(spark, clean + junk)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in clean if not naive_counts(dict(clean)[i])[-1]}
    assert quality.verdicts(docs).where(F.col("kept")).count() == kept.count()
