"""Hard negatives against plain Python and DuckDB; Strassen products against integer ones."""

import math

import duckdb
import numpy as np
import pytest

from crosspath.llm import hardnegatives
from crosspath.llm.queries import SQL, op11_hard_negatives

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int, rid string, q int, kind string, cell int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def naive(rows):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i is None, i or 0, label, [math.floor(256 * float(x)) for x in v]))
    kept.sort(key=lambda r: r[:3])
    out = []
    name = lambda k: None if kept[k][0] else kept[k][1]
    for a, (null, i, label, q) in enumerate(kept):
        if null or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r[3])), k) for k, r in enumerate(kept))
        for minus, p in [s for s in scored if s[1] != a and kept[s[1]][2] == label][:5]:
            fit = [(s, k) for s, k in scored if kept[k][2] != label and 30 * -minus <= 100 * -s <= 90 * -minus]
            out += [(i, name(p), n, name(k), -minus, -s) for n, (s, k) in enumerate(fit[:10], 1)]
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(want, key=key)


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, None, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 3, 5), (64, 64, 64), (37, 64, 129), (100, 33, 1), (256, 64, 1024)])
def test_strassen_equals_integer_product(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-2 ** 20, 2 ** 20, (m, k)), rng.integers(-2 ** 20, 2 ** 20, (k, n))
    for leaf in (1, 4, 16):
        assert (hardnegatives.strassen(a, b, leaf) == a @ b).all()


def test_whole_table_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = naive(rows)
    assert len(want) > 100
    same(op11_hard_negatives(spark, SF).collect(), want)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(con.sql(f"select {', '.join(COLUMNS)} from ({SQL['op11_hard_negatives']})").fetchall()) == sorted(want)


def test_ties_small_tiles_and_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 256], int(rng.integers(0, 3))) for i in range(1500)]
    want = naive(rows)
    for name, value in (("GROUP", 4), ("CELL", 100), ("ROWS", 3), ("COLUMNS", 17), ("LEAF", 2)):
        monkeypatch.setattr(hardnegatives, name, value)
    same(hardnegatives.hard_negatives(table(spark, rows)).collect(), want)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    vector = lambda n=4: [float(x) for x in rng.normal(0.2, 0.5, n)]
    rows = [(k, vector(), k % 3) for k in range(0, 240, 4)]
    twin = vector()
    rows += [(300, twin, 1), (300, twin, 1), (300, vector(), 2), (None, vector(), 1), (None, vector(), 0), (400, None, 1), (500, vector(), None),
             (600, [1.0, None], 1), (700, [float("nan")], 1), (800, [float("inf"), 1.0], 1), (900, [], 1), (901, vector(9), 1), (902, vector(1), 2),
             (-100, vector(), 2), (2 ** 40 * 100, vector(), 0)]
    same(hardnegatives.hard_negatives(table(spark, rows)).collect(), naive(rows))
    assert hardnegatives.hard_negatives(table(spark, [])).count() == 0
    with pytest.raises(Exception, match="too long"):
        hardnegatives.hard_negatives(table(spark, [(100, [1e30], 1)])).count()
