import hashlib
import re

import pytest

from crosspath.llm import decontaminate

from .helpers import SF, documents


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def naive(docs, items, width=10):
    grams = {}
    for i, text in items:
        w = words(text)
        for at in range(max(1, len(w) - width + 1)) if w else []:
            grams.setdefault(tuple(w[at:at + width]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for at in range(len(w) - size + 1):
                if (g := tuple(w[at:at + size])) in grams:
                    hit |= set(range(at, at + size))
                    ids |= grams[g]
        listed = ",".join(sorted(str(x) for x in ids if x is not None))
        out.append((i, len(w), len(hit), len([x for x in ids if x is not None]), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, ITEM!"), (3, None), (4, ""), (5, "short item"), (None, "nameless thing"), (1, "Short item")]
DOCS = [(1, "so ONE two three-four five six seven eight nine ten, eleven and short item short item"), (2, "one two three four five six seven eight nine x ten"),
        (3, None), (4, ""), (5, "short"), (6, "nameless thing"), (7, "é short item é"), (7, "é short item é"), (None, "short item")]


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_cases_match_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    got = decontaminate.contamination(documents(spark, DOCS), benchmark(spark, ITEMS)).drop("spans").collect()
    assert sorted((tuple(r) for r in got), key=str) == naive(DOCS, ITEMS)


def test_whole_table_matches_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.contamination(docs, items).drop("spans").collect()
    want = naive([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in got), key=str) == want and any(r[-1] for r in want)


def test_awkward_and_empty_tables(spark):
    assert decontaminate.contamination(documents(spark), benchmark(spark, ITEMS)).count() == 13
    assert decontaminate.contamination(documents(spark, []), benchmark(spark, ITEMS)).count() == 0
    none = decontaminate.contamination(documents(spark, DOCS), benchmark(spark, [])).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none)


def test_documents_or_spans_go(spark):
    docs, items = documents(spark, DOCS), benchmark(spark, ITEMS)
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, remove="spans").collect() if r.doc_id}
    assert cut[1] == "so  and " and cut[2] == DOCS[1][1] and cut[3] is None and cut[4] == "" and cut[7] == "é  é"
