"""Block naming against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from crosspath.llm import exactdedup
from crosspath.llm.queries import op13_exact_dedup

from .helpers import LONG, SF, awkward, documents


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def naive(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        out.append((i, max(ids, default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()))
    return out


def check(got, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(naive(rows), key=key)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(n == 1 for n in kept.values())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op13_exact_dedup(spark, SF).collect(), rows)


@pytest.mark.parametrize("size", [37, 1024])
def test_awkward_rows(spark, size):
    rows = awkward()
    check(exactdedup.duplicates(documents(spark, rows), size).collect(), [r[:2] for r in rows])
    assert exactdedup.duplicates(documents(spark, []), size).count() == 0


def test_texts_that_differ_in_one_place(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abAB é") for _ in range(300))
    rows = []
    for k in range(300):
        at, text = rng.randrange(300), list(base[:rng.choice((290, 299, 300))])
        if k % 2 and at < len(text):
            text[at] = rng.choice("abAB")
        rows.append((k, "".join(text)))
    rows += [(1000 + k, "same") for k in range(3000)] + [(5000 + k, LONG[:5000]) for k in range(200)]     # hot texts
    check(exactdedup.duplicates(documents(spark, rows).repartition(7), 16).collect(), rows)


def test_one_row_of_a_group_stays(spark):
    docs = documents(spark)
    kept = exactdedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(list)
    for r in awkward():
        groups[lower(r[1])].append(r[0])
    assert {lower(r.text): r.doc_id for r in kept.collect()} == {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
