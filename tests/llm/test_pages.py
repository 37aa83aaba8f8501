"""What counts as noise, and pages of very deep or broken markup."""

import random
import time
import tracemalloc

import pytest

from crosspath.llm import pages

TEXT = "Words of the real article that go on for a while, with some sense in them. " * 5


@pytest.mark.parametrize("wrapper", [
    '<div class="content no-sidebar"><article><p>{}</p></article></div>', '<div id="with-menu"><article><p>{}</p></article></div>',
    '<div class="social-science-article"><p>{}</p></div>', '<div class="has-sidebar"><p>{}</p></div>', '<div class="menu"><main><p>{}</p></main></div>',
    '<section class="sponsored"><div><p>{}</p></div></section>', '<div class="comments widget"><article><div><p>{}</p></div></article></div>'])
def test_the_article_is_never_dropped(wrapper):
    assert pages.extract(f"<html><body><nav>Menu</nav>{wrapper.format(TEXT)}<footer>End</footer></body></html>", None) == TEXT.strip()


@pytest.mark.parametrize("name", ["sidebar", "site-header", "navLinks", "cookie-banner", "ad_slot-3", "comment-list", "related post", "share-buttons", "SidebarLeft"])
def test_noise_by_name_goes(name):
    html = f"<body><article><p>{TEXT}</p><div class='{name}'>Away with it</div></article><div id='{name}'>{TEXT}</div></body>"
    assert pages.extract(html, None) == TEXT.strip()


@pytest.mark.parametrize("html", ["<div>" * 100_000 + TEXT, "<div class=c><p>x" * 50_000, "<b>" * 20_000 + "</i></p></div>" * 20_000 + TEXT,
                                  "<div><b>" * 30_000 + "</b>" * 30_000 + TEXT, ("<div>" + TEXT) * 3_000 + "</div>" * 3_000])
def test_deep_pages_cost_what_their_length_does(html):
    start = time.time()
    tracemalloc.start()
    text = pages.extract(html, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text and peak < 400e6 and time.time() - start < 60
    assert len(pages.candidates(html)) <= html.count("<div")


def test_scores_are_those_of_a_plain_walk():
    """Scores summed from the leaves up equal a walk over all ancestors of every text."""
    rng = random.Random(1)
    for _ in range(200):
        html = "".join(rng.choice(["<div class=a>", "<section>", "</div>", "<p>", "<article>", "</article>", "<a href=x>", "</a>", "<td>", "</section>", "<b>",
                                   "</b>", "<nav>", "</nav>", "short text ", TEXT, "<div class=sidebar>"]) for _ in range(rng.randrange(40)))
        elements, parts = pages.parse(html)
        want = {}
        for e, text in parts:
            size = 0 if e.dropped else pages._size(text)
            signed, worth = (-size if e.link else size), 1.0
            if size and e.tag in pages.CONTAINERS and size < 300:
                want[e.depth, e.path] = want.get((e.depth, e.path), 0) + 0.7 * signed
                e = e.parent
            while size and e.parent is not None:
                if e.tag in pages.CONTAINERS:
                    want[e.depth, e.path] = want.get((e.depth, e.path), 0) + worth * signed
                    worth *= 0.9
                e = e.parent
        factor = {(e.depth, e.path): 2 if e.tag in ("article", "main") else 1 for e in elements if e.tag in pages.CONTAINERS}
        want = {k: v * factor[k] for k, v in want.items() if v > 1e-9}
        got = pages._scores(elements, parts)
        assert {k for k, v in got.items() if v > 1e-9} == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
        assert all(e.dropped >= e.parent.dropped for e in elements[1:])
