"""Line dedup, sharding, mixing, pages, language, chat: SQL or brute force, and awkward rows."""

import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, oracle
from crosspath.llm import chat, langid, linededup, mixing, pages, queries, sharding

from .helpers import SF, awkward, documents


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF).toPandas(), oracle(SF, queries.SQL[name])) is None


def cleaned(spark, rows):
    return {r.row.doc_id: (r.n_lines, r.n_removed, r.clean_text) for r in linededup.deduplicated(documents(spark, rows)).collect()}


def test_later_windows_go(spark):
    got = cleaned(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc\nd\ne"), (4, "q\nq\nq\nq\nq"), (5, "a\n\nb\n \nc"), (6, "a\nb"), (7, None), (8, "")])
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (5, 3, "x\ny"), 3: (5, 4, "e"), 4: (5, 2, "q\nq\nq"), 5: (5, 3, "\n "), 6: (2, 0, "a\nb"), 7: (0, 0, None), 8: (1, 0, "")}
    assert linededup.deduplicated(documents(spark)).count() == len(awkward())
    assert linededup.deduplicated(documents(spark, [])).count() == 0


def test_long_texts_cost_in_proportion(spark):
    """Two texts of 39,999 lines, every second window repeated: the places are cut out, not searched for line by line."""
    lines = [f"line {i}" for i in range(39_999)]
    other = "\n".join(x if i // 3 % 2 else x + "!" for i, x in enumerate(lines))
    start = time.time()
    got = cleaned(spark, [(1, "\n".join(lines)), (2, other)])
    assert time.time() - start < 20
    assert got[1] == (39_999, 0, "\n".join(lines))
    kept = "\n".join(x + "!" for i, x in enumerate(lines) if i // 3 % 2 == 0)
    assert got[2] == (39_999, 39_999 - kept.count("\n") - 1, kept)


def check_shards(rows, want, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in want)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_hold_all_rows_and_near_equal_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sharding.sharded(docs, shards=6).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 6)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
    check_shards(sharding.sharded(documents(spark)).collect(), [r[:2] for r in awkward()], 24)
    assert sharding.sharded(documents(spark, [])).count() == 0


def test_a_mass_of_repeated_rows_is_listed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_PIECE", 3)
    rows = [(1, "same")] * 10 + [(2, "same")] * 3 + [(3, None)] * 4 + [(4, "one")]
    check_shards(sharding.sharded(documents(spark, rows), shards=2).collect(), rows, 2)


def test_the_map_is_edited_slot_by_slot(spark, tmp_path):
    rng = random.Random(2)
    sizes = {s: rng.randrange(100, 1000) for s in range(sharding.SLOTS)}
    first = sharding.plan(sizes, 4)
    grown = sharding.rebalance(first, sizes, 5)
    before, after = {s: k for _, s, k in first}, {s: k for _, s, k in grown}
    moved = {s for s in before if before[s] != after[s]}
    load = Counter()
    for s, k in after.items():
        load[k] += sizes[s]
    assert set(after) == set(before) and {after[s] for s in moved} == {4} and {v for v, _, _ in grown} == {1}
    assert max(load.values()) <= 1.02 * sum(sizes.values()) / 5 and len(moved) < 0.25 * len(before)
    shrunk = {s: k for _, s, k in sharding.rebalance(grown, sizes, 4)}
    assert set(shrunk.values()) == {0, 1, 2, 3}
    sharding.write_map(spark, str(tmp_path), first)
    sharding.write_map(spark, str(tmp_path), grown)
    assert sharding.read_map(spark, str(tmp_path), 0) == first and sharding.read_map(spark, str(tmp_path), 1) == grown
    assert {r.map_version for r in sharding.sharded(documents(spark), 5, current=grown).collect()} == {1}


def test_margins_meet_their_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mixed(docs).select(*mixing.MARGINS, "n_tokens", "weight", "probability").toPandas()
    total = rows.n_tokens.sum()
    assert rows.weight.sum() == pytest.approx(total)
    for m in mixing.MARGINS:
        wanted = rows.groupby(m).n_tokens.sum() ** mixing.TEMPER
        got = rows.groupby(m).weight.sum()
        assert (got / total - wanted / wanted.sum()).abs().max() < 1e-4
    assert rows.probability.max() == pytest.approx(1) and rows.probability.min() > 0
    kept = mixing.mix(documents(spark))
    assert kept.columns == documents(spark).columns and mixing.mixed(documents(spark)).count() == len(awkward())
    assert mixing.mixed(documents(spark, [])).count() == 0


class Article(HTMLParser):
    """Blocks of the article element, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "h2", "h3") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] if tag in ("p", "h1", "h2", "h3", "article") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_pages_equal_their_articles(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.main_text(table).collect()}
    for r in table.collect():
        article = Article()
        article.feed(r.html)
        text = "\n\n".join(b for b in (re.sub(r"\s+", " ", b).strip() for b in article.blocks) if b)
        assert got[r.page_id] == (text, len(text))


BODY = "Words of the real article that go on for a while, with sense &amp; detail. " * 6
NOISY = f"""<html><body class=no-menu><header>Site</header><div class="cookie-notice">We use cookies</div><div class="wrap"><div class="content-12">
<h2>Title</h2><div>First {BODY}</div><p>Second<br>part {BODY}<ul><li>one<li>two</ul><aside>See also</aside><form>Name <input></form>
<div id="comments"><p>Nice {BODY}</p></div></div><div class="sidebar">Links {BODY}</div></div><script>if (a < b) "</p>"</script><footer>End</footer></body>"""


def test_noise_and_broken_markup(spark):
    text = pages.extract(NOISY, None)
    assert text.split("\n\n")[0] == "Title" and "First Words" in text and "Second part Words" in text and "one\n\ntwo" in text and "sense & detail" in text
    assert not re.search("Site|cookies|See also|Name|Nice|Links|End|if", text)
    rows = [(1, "http://h/1", NOISY), (2, "http://h/2", NOISY.replace("content-12", "content-7")), (3, None, NOISY), (4, "http://h/4", None), (5, "x", ""),
            (None, "http://h/6", "<p>lone <b>text</p> < more"), (7, "http://h/7", "<!-- never closed"), (8, "http://h/8", "<a href='x\">" * 2000),
            (9, "http://h/9", "<div>" * 3000 + "deep"), (1, "http://h/1", NOISY)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, path string")).collect()}
    assert got[1] == got[2] == got[3] == text and got[4] == got[5] == got[7] == "" and got[None] == "lone text\n\n< more" and got[9] == "deep"
    assert pages.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_language_of_held_out_documents_and_weak_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.where("doc_id % 4 = 0")
    languages, model = langid.train(docs.where("doc_id % 4 <> 0"))
    got = langid.identify(langid.from_documents(held), languages, model).join(held.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert sum(r.lang == r.true for r in got) > 0.97 * len(got)
    page = "<html lang='{}-XX'><body>{}</body></html>"
    rows = [(i, f"http://{'a' if i < 60 else 'b'}.site.org/x/{i}", page.format("fr", docs.where("lang = 'fr'").first().text)) for i in range(60)]
    rows += [(100, "http://a.site.org/none", "<html><body></body></html>"), (101, "http://a.site.org/tie", None), (102, None, None), (103, None, page.format("fr", ""))]
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "page_id bigint, url string, html string, scores double").drop("scores")
    found = {r.page_id: (r.lang, r.probability) for r in langid.identify(langid.from_pages(table), languages, model).collect()}
    assert len(found) == 64 and all(found[i][0] == "fr" for i in (*range(60), 100, 101, 103)) and found[100][1] > 0.9
    assert langid.identify(langid.from_pages(table.limit(0)), languages, model).count() == 0
    assert {r.lang for r in langid.identify(langid.from_documents(documents(spark)), [], model).collect()} == {None}
    assert langid.identify(langid.from_documents(documents(spark)), languages, model).count() == len(awkward())


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 70, "ann", "late"), (1, None, None, "?"), (2, 0, "system", "x"), (None, 0, "eve", "y"),
            (1, 1, "ann", "hi")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    full = {}
    for r in sorted(chat.perspectives(table).collect(), key=lambda r: (str(r.conv_id), r.participant, r.part is None, r.part or 0)):
        text, masks = full.get((r.conv_id, r.participant), ("", []))
        assert r.char_start == len(text) and r.char_end == len(text) + len(r.text)
        full[r.conv_id, r.participant] = (text + r.text, masks + [(m.start, m.end) for m in r.masks])
    assert set(full) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "eve")}
    text, masks = full[1, "ann"]
    assert [text[a:b] for a, b in masks] == ["hi<|im_end|>\n", "hi<|im_end|>\n", "late<|im_end|>\n"]
    assert text.startswith("<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi") and "<|im_start|>user name=bob\n<|im_end|>" in text
    assert text.endswith("<|im_start|>user name=unknown\n?<|im_end|>\n")
    assert chat.perspectives(table.limit(0)).count() == 0


def test_offsets_of_a_long_conversation_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(chat, "PARTS", 3)
    rows = [("long", t, "ab"[t % 2], f"turn {t}") for t in range(40)] + [("long", None, "a", "late"), (None, 1, "b", "x")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string"), width=4).collect()
    for conv, person in {(r.conv_id, r.participant) for r in got}:
        at = 0
        for r in sorted((r for r in got if (r.conv_id, r.participant) == (conv, person)), key=lambda r: (r.part is None, r.part or 0)):
            assert (r.char_start, r.char_end) == (at, at + len(r.text))
            at = r.char_end
