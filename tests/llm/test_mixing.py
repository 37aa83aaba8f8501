"""Raking goes on until the margins fit, and tells what it cannot fit."""

import pytest
from pyspark.sql import functions as F

from crosspath.llm import mixing

from .helpers import SF, documents

SCHEMA = "source string, lang string, topic string, tokens bigint"


def targets(spark, **margins):
    return {m: spark.createDataFrame(list(margins[m].items()), "value string, target double") for m in mixing.MARGINS}


def test_slow_convergence_is_waited_for(spark):
    """Nearly separate cells: eight rounds leave a margin far off, raking until the tolerance does not."""
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 100)], SCHEMA)
    wanted = targets(spark, source={"a": 60.0, "b": 142.0}, lang={"x": 150.0, "y": 52.0}, topic={"t": 202.0})
    few = mixing.margins_left(mixing.rake(cells, wanted, rounds=2), wanted).agg({"left": "max"}).first()[0]
    full = mixing.margins_left(mixing.rake(cells, wanted), wanted).collect()
    assert few > 1e-3 and max(r.left for r in full) < 1e-8 and len(full) == 5


def test_contradicting_targets_end_and_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 100), (None, None, "t", 5)], SCHEMA)
    wanted = targets(spark, source={"a": 150.0, "b": 50.0, None: 5.0}, lang={"x": 50.0, "y": 150.0}, topic={"t": 205.0})
    left = {(r.margin, r.value): r for r in mixing.margins_left(mixing.rake(cells, wanted), wanted).collect()}
    assert max(r.left for r in left.values() if r.left is not None) > 0.1
    assert left["lang", None].target == 0 and left["lang", None].left is None
    docs = documents(spark, [(k, "one two three", "x" if k % 2 else "y", "a" if k % 2 else "b", None, None, None, None, None, None) for k in range(20)])
    bad = targets(spark, source={"a": 45.0, "b": 15.0}, lang={"x": 15.0, "y": 45.0}, topic={"prose": 60.0})
    with pytest.raises(ValueError, match="contradict"):
        mixing.mixed(docs, bad, at_most=0.05)
    assert mixing.mixed(docs, bad).count() == 20


def test_default_targets_are_met(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert mixing.mixed(docs, at_most=1e-3).count() == docs.count()


def test_a_stray_label_takes_no_more_than_its_own_share(spark):
    """One added one-word document of a new language and source: the budget still holds, and it is kept whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    stray = spark.createDataFrame([(10 ** 9, "word", "xx", "nowhere")], docs.schema)
    for rows in (docs, docs.unionByName(stray)):
        got = mixing.mixed(rows, keep=0.6).toPandas()
        assert (got.n_tokens * got.probability).sum() == pytest.approx(0.6 * got.n_tokens.sum(), rel=1e-9)
        assert got.probability.max() == 1 and (got.epochs >= got.probability).all()
        assert (got.n_tokens * got.epochs / got.weight)[got.weight > 0].std() < 1e-6      # reading documents so often meets the targets
    assert got.set_index("lang").loc["xx", "kept"]
    with pytest.raises(ValueError, match="keep"):
        mixing.mixed(docs, keep=1.5)


def test_scale_against_bisection(spark):
    rows = [("s", str(k), "t", 10 * k + 1, float(w)) for k, w in enumerate([900, 1, 0, 40, 40, 7, 300, 2])]
    raked = spark.createDataFrame(rows, SCHEMA + ", weight double")
    for keep in (0.01, 0.5, 0.8):
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(1, mid * w / n) for *_, n, w in rows) < keep * sum(r[3] for r in rows) else (low, mid)
        assert mixing.scale(raked, keep) == pytest.approx(low, rel=1e-9)
    factor = mixing.scale(raked, 1.0)                       # one cell has no weight, all others are kept whole
    assert all(w == 0 or factor * w / n > 1 - 1e-9 for *_, n, w in rows)
    assert mixing.scale(raked.limit(0)) == 0


def test_topic_of_a_column(spark):
    docs = documents(spark, [(k, "one two three", "x", "a", None, None, None, None, None, None) for k in range(4)])
    assert {r.topic for r in mixing.mixed(docs, about=(F.col("doc_id") % 2).cast("string")).collect()} == {"0", "1"}
