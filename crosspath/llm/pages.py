"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold outside boilerplate and links.
The scores are votes for the container's generalised path (tags with classes, numbers left
out); Spark adds them up per host. Each page is then extracted again from the elements on
its host's winning path, from its own best container if it has none.

A path is known by a 64-bit hash that its last step extends, so time and memory grow with the page, however
deep its tags are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, with_python

# Elements of HTML by what they do, and words in class names and ids of what is not main text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style template noscript iframe object svg canvas nav header footer aside form button select textarea dialog head title "
                    "menu audio video noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                   "h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
                  "footer gdpr header masthead menu nav navbar navigation newsletter notice pagination popup promo related reply replies share sharing "
                  "sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split())
# Words that may stand beside a noise word in a name without making it another thing.
NEUTRAL = frozenset("area bar block bottom box button buttons container floating form global icons inner item items left link links list main mobile outer page "
                    "panel post primary right secondary section site slot sticky top unit wrap wrapper".split())
# Start tags that end an open element: the closed one -> those that close it.
CLOSES = {"p": BLOCKS - {"option", "html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
          "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
          "p": {"table", "td", "th", "li", "blockquote", "div", "section", "article", "main", "body"}}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "path", "depth", "parent", "dropped", "soft", "link", "number")

    def __init__(self, tag: str, path: int, depth: int, parent, dropped: bool, soft: bool, link: bool, number: int):
        self.tag, self.path, self.depth, self.parent = tag, path, depth, parent
        self.dropped, self.soft, self.link, self.number = dropped, soft, link, number


def _certain(tag: str, attributes: dict[str, str]) -> bool:
    """Elements that are never main text by what they are."""
    return tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES


def _noisy(tag: str, attributes: dict[str, str]) -> bool:
    """Elements whose class or id names what is not main text: a name all of whose words are noise, or neutral beside noise.

    "site-header" is one, "no-sidebar", "with-menu" and "social-science" are not.
    """
    if tag in ("html", "body", "article", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & NOISE and words <= NOISE | NEUTRAL:
            return True
    return False


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("#", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def _extended(path: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step, path & (1 << 64) - 1) - (1 << 63)


def parse(html: str) -> tuple[list[_Element], list[tuple[_Element, str | None]]]:
    """All elements, parents first, and the parts of the page in order: (element, text), or (element, None) where a
    block begins or ends. ``dropped`` holds for an element and all in it."""
    at = _Element("", 0, 0, None, False, False, False, 0)
    elements, parts = [at], []
    opened: Counter = Counter()
    position, lower = 0, None

    def up_to(parent: _Element) -> _Element:
        nonlocal at
        while at is not parent:
            opened[at.tag] -= 1
            at = at.parent
        return at

    while True:
        m = _TOKEN.search(html, position)
        text = html[position:m.start() if m else len(html)]
        if text:
            parts.append((at, unescape(text)))
        if not m:
            _settle(elements, parts)
            return elements, parts
        position = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:                                            # an end tag closes its element and what is open in it
            if tag in BLOCKS:
                parts.append((at, None))
            if opened[tag] > 0:
                found = at
                while found.tag != tag and (tag in BLOCKS or found.tag not in BLOCKS):     # an inline one closes no block
                    found = found.parent
                if found.tag == tag:
                    up_to(found.parent)
            continue
        while (closed := _closing(at, tag)) is not None:
            up_to(closed.parent)
        attributes: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(m[3]):
            attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        if tag in BLOCKS:
            parts.append((at, None))
        if tag == "br":
            parts.append((at, " "))
        if tag in VOID:
            continue
        path, depth = (_extended(at.path, _step(tag, attributes)), at.depth + 1) if tag in BLOCKS else (at.path, at.depth)
        element = _Element(tag, path, depth, at, at.dropped or _certain(tag, attributes), _noisy(tag, attributes), at.link or tag == "a", len(elements))
        elements.append(element)
        if tag in RAW:
            lower = lower if lower is not None else html.lower()
            end = lower.find(f"</{tag}", position)
            end = len(html) if end < 0 else end
            if end > position:
                parts.append((element, unescape(html[position:end]) if tag in ("textarea", "title") else html[position:end]))
            close = html.find(">", end)
            position = len(html) if close < 0 else close + 1
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "path", "math"):
            opened[tag] += 1
            at = element


def _size(text: str | None) -> int:
    return 0 if text is None else len(_SPACE.sub(" ", text).strip())


def _settle(elements: list[_Element], parts: list[tuple[_Element, str | None]]) -> None:
    """Drops what its name calls noise, unless it holds the article: an article or main element, or, on a page
    that has none, most of the text outside links."""
    if not any(e.soft for e in elements):
        return
    held, holds = [0] * len(elements), [e.tag in ("article", "main") and not e.dropped for e in elements]
    for e, text in parts:
        if not (e.dropped or e.link):
            held[e.number] += _size(text)
    for e in reversed(elements[1:]):
        held[e.parent.number] += held[e.number]
        holds[e.parent.number] |= holds[e.number]
    for e in elements[1:]:
        kept = holds[e.number] or not holds[0] and 5 * held[e.number] > 4 * held[0]
        e.dropped = e.dropped or e.parent.dropped or e.soft and not kept


def _closing(at: _Element, tag: str):
    """The open element that a start tag ends implicitly, looking through inline elements."""
    while at.parent is not None:
        if at.tag in CLOSES and tag in CLOSES[at.tag]:
            return at
        if at.tag in BLOCKS and (tag not in LIMITS or at.tag in LIMITS[tag] or at.tag not in CLOSES):
            return None
        at = at.parent
    return None


def _scores(elements: list[_Element], parts: list[tuple[_Element, str | None]]) -> dict[tuple[int, int], float]:
    """Score of every container path (depth, path) of a page.

    A container's score is the text outside links it holds, less what is in links, with each
    level up worth a little less, so the closest element around the article wins. Short text
    right in a container makes it a paragraph and counts less for it. An article or main
    element counts double.
    """
    held = [0.0] * len(elements)
    totals: dict[tuple[int, int], float] = {}
    factor: dict[tuple[int, int], int] = {}
    for e, text in parts:
        size = 0 if e.dropped else _size(text)
        signed = -size if e.link else size
        if size and e.tag in CONTAINERS and size < 300:
            totals[e.depth, e.path] = totals.get((e.depth, e.path), 0.0) + 0.7 * signed
            e = e.parent
        held[e.number] += signed
    for e in reversed(elements[1:]):
        mine = held[e.number]
        if e.tag in CONTAINERS:
            factor[e.depth, e.path] = 2 if e.tag in ("article", "main") else 1
            totals[e.depth, e.path] = totals.get((e.depth, e.path), 0.0) + mine
            mine *= 0.9
        held[e.parent.number] += mine
    return {p: s * factor.get(p, 1) for p, s in totals.items() if s > 0}


def candidates(html: str | None) -> list[tuple[int, int, float]]:
    """(depth, path, score) per container path of the page; the scores of a page add up to 1."""
    scored = _scores(*parse(html or ""))
    whole = sum(scored.values())
    return sorted((d, p, round(s / whole, 6)) for (d, p), s in scored.items()) if whole else []


def extract(html: str | None, path: int | None) -> str:
    """Blocks of text of all elements on ``path`` (else on the page's own best path), joined by blank lines."""
    elements, parts = parse(html or "")
    if path is None or all(e.path != path for e in elements):
        scored = _scores(elements, parts)
        path = max(scored, key=lambda p: (scored[p], p), default=(0, 0))[1]     # no container: the whole page
    inside = [False] * len(elements)
    for e in elements:
        inside[e.number] = e.path == path or e.parent is not None and inside[e.parent.number]
    blocks, current = [], []
    for element, text in parts:
        if text is None:
            blocks.append("".join(current))
            current = []
        elif not element.dropped and inside[element.number]:
            current.append(text)
    blocks.append("".join(current))
    cleaned = (_SPACE.sub(" ", b).strip() for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def host(url: Column) -> Column:
    """Host of an address, lower case, without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, depth, path, votes, pages): the summed scores of every path of a host."""
    found = with_python(pages.select(host(F.col("url")).alias("host"), "html"), "html", {"found": T.ArrayType(T.StructType([
        T.StructField("depth", T.LongType()), T.StructField("path", T.LongType()), T.StructField("score", T.DoubleType())]))},
                        lambda texts: [[[{"depth": d, "path": p, "score": s} for d, p, s in candidates(t)] for t in texts]])
    return (found.select("host", F.inline("found")).groupBy("host", "depth", "path")
            .agg(F.round(F.sum("score"), 3).alias("votes"), F.count("*").alias("pages")))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html, ...).

    Null and empty html give an empty text. Pages without a host (or a null url) use their
    own best container. Ties go to the deeper path, then to that of the larger hash. Repeated
    rows get equal results. An empty table gives an empty result. Pages are read whole.
    """
    summed = votes(pages).where("host is not null")
    winners = stored(summed.groupBy("host").agg(F.max(F.struct("votes", "depth", "path")).alias("best")).select(F.col("host").alias("its_host"), "best.path"))
    known = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(winners, F.col("host") == F.col("its_host"), "left")
    both = known.select("page_id", "url", F.struct("html", "path").alias("page"))
    made = _extracted(both)
    return made.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def _extracted(pages: DataFrame) -> DataFrame:
    return with_python(pages, "page", {"text": T.StringType()},
                       lambda rows: [[extract(r["html"], r["path"]) for r in rows]])
