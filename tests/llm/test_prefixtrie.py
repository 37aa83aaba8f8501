"""The prefix trie against plain Python and DuckDB."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from crosspath.llm import prefixtrie
from crosspath.llm.queries import SQL, op12_prefix_trie

from .helpers import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, i int, v1 string, end string"


def naive(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, cs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(cs) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), children[path], leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(got, want):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(want, key=key)


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 7, None, "e") for r in rows], SCHEMA)


def test_whole_table_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = naive(rows)
    check(op12_prefix_trie(spark, SF).collect(), want)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df = con.sql(SQL["op12_prefix_trie"]).df()
    rows = [{k: None if v is None or v != v else int(v) if k != "ends_sha256" else v for k, v in r.items()} for r in df.to_dict("records")]
    check(rows, want)


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in range(400):                                 # few texts, so that prefixes meet; copies of whole conversations
        for turn in range(rng.randrange(1, 12)):
            rows.append((c, turn, rng.choice(["user", None, ""]), rng.choice(["a", "b", None, "é\n"])))
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(200) for t in range(11)]
    rows += [(2000, None, "user", "z"), (2000, None, "user", "y"), (2000, 3, "b", "x"), (2000, 3, "a", "x"), (2000, 3, "a", "x")]
    rows += [(None, 1, "user", "no conversation"), (4_000_000_001, 0, "user", "x" * 100_000), (4_000_000_001, 9, None, None)]
    rows += [(3000 + k, t, "user", str(t % 7)) for k in (0, 1, 2) for t in range(9000)]                     # longer than a piece
    rng.shuffle(rows)
    small = [r for r in rows if r[0] is None or not 3000 <= r[0] < 3003]
    check(prefixtrie.trie(table(spark, small)).collect(), naive(small))
    check(prefixtrie.trie(table(spark, small).where("conv_id < 300"), family=5, heads=9).collect(), naive([r for r in small if r[0] is not None and r[0] < 300]))
    assert prefixtrie.trie(table(spark, [])).count() == 0
    long = [r for r in rows if r[0] is not None and 3000 <= r[0] < 3003]
    got = {(r.depth, r.conv_id): r for r in prefixtrie.trie(table(spark, long)).collect()}
    h = [zlib.crc32(str(c).encode()) % 9 for c in (3000, 3001, 3002)]
    assert got[(0, 3000)].n_convs == 3 and got[(9000, 3000)].n_convs == 3 and len(got) == 9001 and h
    assert got[(0, 3000)].saved_tokens == 2 * 9000 and got[(8999, 3000)].saved_tokens == 4 and got[(4096, 3000)].n_leaves == 1


def test_products_compose():
    base, turns = prefixtrie.base_of(0), [(1, -5), (2 ** 62, 7), (-9, 0)]
    batch = prefixtrie._batch([(4, *t, 0) for t in turns], ["conv_id", "t1", "t2", "bytes"])

    class Context:
        get = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})())

    old, prefixtrie.TaskContext = prefixtrie.TaskContext, Context
    try:
        rows = [r for out in prefixtrie._scan(base)([batch.slice(0, 2), batch.slice(2)]) for r in out.to_pylist()]
    finally:
        prefixtrie.TaskContext = old
    values = [prefixtrie._join(r["v1"], r["v2"]) for r in rows if not r["end"]]
    t = [prefixtrie._turn(*x) for x in turns]
    assert values == [t[0], (t[0] * base + t[1]) % prefixtrie.MODULUS, ((t[0] * base + t[1]) * base + t[2]) % prefixtrie.MODULUS]
    assert rows[-1]["end"] == 1 and rows[-1]["i"] == 3
