import random

import xxhash

from crosspath.llm import simhash

from .helpers import SF, awkward, documents


def naive_fingerprint(text):
    words = []
    word = ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(fps, bits):
    """fps -> root of each by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in root:
        for y in root:
            if x < y and bin((x ^ y) & (2 ** 64 - 1)).count("1") <= bits:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {f: find(f) for f in root}


def naive_components(rows, bits=3):
    fps = [naive_fingerprint(t) for _, t in rows]
    root = naive_groups(fps, bits)
    low = {}
    for (i, _), f in zip(rows, fps):
        ids = [x for x in (low.get(root[f]), i) if x is not None]
        low[root[f]] = min(ids, default=None)
    return sorted(((i, f"{f:016x}", low[root[f]]) for (i, _), f in zip(rows, fps)), key=str)


def test_awkward_rows_match_brute_force(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == naive_components([r[:2] for r in awkward()])


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == naive_components([(r.doc_id, r.text) for r in docs.collect()])


def test_small_nodes_and_dense_groups_find_the_same_groups(spark):
    rng = random.Random(7)
    centers = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2 ** 64 - 1) for c in centers for _ in range(60)}
    fps |= {centers[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}        # one bucket of many leaves
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), size=4, fanout=2).collect()
    want = naive_groups(signed, 3)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert want[a] == want[b]
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in root} == want


def test_gray_rank_orders_the_reflected_code(spark):
    code = spark.range(1000).selectExpr("id", "id ^ shiftright(id, 1) as code")
    assert code.where(simhash.gray_rank(code["code"]) != code["id"]).count() == 0


def test_one_row_of_each_group_stays(spark):
    kept = simhash.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    components = naive_components([r[:2] for r in awkward()])
    groups = {naive_groups([naive_fingerprint(t) for _, t in (r[:2] for r in awkward())], 3)[int(f, 16)] for _, f, _ in components}
    assert kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in components}
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
