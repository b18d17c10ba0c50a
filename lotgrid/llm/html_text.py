"""Main text of web pages by tag-path ratios.

A page is cut into text blocks.  For each root-to-leaf tag path the text length and the
punctuation of its blocks are summed and divided by the number of its leaves; both ratios
are smoothed over the blocks in page order and fused, and blocks whose path is above a
threshold are content.  The innermost section that holds the content gives the article:
headings and short lines in it stay, link lists and marked boilerplate do not.
"""

from __future__ import annotations

import html as html_lib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lotgrid.llm.common import map_texts

# Production parameters.
THRESHOLD = 0.35  # share of the mean fused ratio, weighted by text, that a content path needs
CONTAINER_SHARE = 0.9  # share of the content's text that the chosen section has to hold
LINK_SHARE = 0.6  # a block with more of its text in links is a menu entry

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
# Elements whose content is never text of the page.
HIDDEN = frozenset("script style head noscript template svg math iframe object canvas audio video title textarea select option button datalist".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
# Elements around text that is not the article's.
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre td th tr tbody thead tfoot table figure figcaption address summary".split())
CLOSES_P = LEAVES | ASIDE | frozenset("div section article main details hr center".split())
# Names of sections that are not the article, as words of class, id and role.
NOISE = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist
    cookie cookies consent copyright disqus discussion footer header login masthead menu menus modal nav navbar navigation newsletter notice notices
    pager pagination popup popups promo promos promotion related recommended replies reply search share sharing sidebar sidebars signup social sponsor
    sponsored subscribe toolbar widget widgets contentinfo complementary dialog alert""".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，！？、]")

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRS = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")


def _is_noise(attrs: str) -> bool:
    for m in ATTRS.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id", "role") and not NOISE.isdisjoint(WORDS.findall(value)):
            return True
    return False


class _Page:
    """Text blocks of a page: ``(text, path, element, marked, link share)``; paths are numbered."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, bool, float]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.parent, self.tag = [-1], ["#"]
        # name, element, marked as boilerplate, hidden, path, link
        self.stack: list[tuple[str, int, bool, bool, int, bool]] = [("#", 0, False, False, 0, False)]
        self.parts: list[tuple[str, bool]] = []
        self.owner = self.stack[0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            self._text(source[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            if m["name2"] and not m[0].endswith(">"):
                break  # the page ends inside a tag
            name = name.lower()
            if m["close"] or m["close2"]:
                self._close(name)
                continue
            attrs = m["attrs"] if m["name"] else m["attrs2"]
            self._open(name, attrs)
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else end
        self._flush()

    def _text(self, text: str) -> None:
        if not text or self.stack[-1][3]:
            return
        if not self.parts:
            self.owner = self.stack[-1]
        self.parts.append((text, self.stack[-1][5]))

    def _flush(self) -> None:
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        text = " ".join(html_lib.unescape("".join(t for t, _ in parts)).split())
        if not text:
            return
        linked = sum(len(" ".join(html_lib.unescape(t).split())) for t, a in parts if a)
        _, element, marked, _, path, _ = self.owner
        self.blocks.append((text, path, element, marked, min(1.0, linked / len(text))))

    def _open(self, name: str, attrs: str) -> None:
        if name in VOID:
            if name == "br":
                self._text("\n")
            elif name == "hr":
                self._flush()
            return
        if name not in INLINE:
            self._flush()
            if name in CLOSES_P:
                self._pop_to("p", stop=("div", "section", "article", "td", "th", "li", "body", "button"))
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
                for s in same:
                    self._pop_to(s, stop=("ul", "ol", "dl", "table", "select"))
        top = self.stack[-1]
        if name in INLINE:
            element, path = top[1], top[4]
        else:
            element, path = len(self.parent), self.paths.setdefault((top[4], name), len(self.paths) + 1)
            self.parent.append(top[1])
            self.tag.append(name)
        # Whole-page elements are not judged by their class names.
        noisy = name in ASIDE or (name not in ("html", "body", "article", "main") and bool(attrs) and _is_noise(attrs))
        self.stack.append((name, element, top[2] or noisy, top[3] or name in HIDDEN, path, top[5] or name == "a"))

    def _pop_to(self, name: str, stop: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return
            if self.stack[k][0] in stop:
                return

    def _close(self, name: str) -> None:
        if name in VOID:
            return
        if name not in INLINE:
            self._flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                return
            if name in INLINE and self.stack[k][0] not in INLINE:
                return


def path_ratios(blocks: list[tuple[str, int, int, bool, float]]) -> list[float]:
    """Fused ratio of each block's path, after smoothing over the blocks in page order."""
    size: dict[int, list[float]] = {}
    for text, path, _, _, link in blocks:
        s = size.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += len(text) * (1.0 - link)
        s[1] += len(PUNCTUATION.findall(text)) * (1.0 - link)
        s[2] += 1.0
    length = [size[b[1]][0] / size[b[1]][2] for b in blocks]
    points = [size[b[1]][1] / size[b[1]][2] for b in blocks]

    def smooth(v: list[float]) -> list[float]:
        # Neighbours only raise a block towards theirs within its own surroundings.
        return [0.25 * (v[i - 1] if i else x) + 0.5 * x + 0.25 * (v[i + 1] if i + 1 < len(v) else x) for i, x in enumerate(v)]

    return [math.sqrt(a * (1.0 + b)) for a, b in zip(smooth(length), smooth(points), strict=True)]


def extract(source: str | None, threshold: float = THRESHOLD) -> str:
    """Article text of one page; the empty text for a null or empty page or one without text."""
    if not source:
        return ""
    page = _Page(source)
    blocks = [b for b in page.blocks if not b[3]]
    if not blocks:
        return ""
    fused = path_ratios(blocks)
    weight = [len(b[0]) * (1.0 - b[4]) for b in blocks]
    total = sum(weight)
    if not total:
        return ""
    level = threshold * sum(f * w for f, w in zip(fused, weight, strict=True)) / total
    content = [f >= level and b[4] <= LINK_SHARE for f, b in zip(fused, blocks, strict=True)]
    # Text of content blocks below each element; elements are numbered in page order.
    held = [0.0] * len(page.parent)
    for b, c, w in zip(blocks, content, weight, strict=True):
        if c:
            held[b[2]] += w
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    section = 0
    for e in range(1, len(held)):
        if page.parent[e] == section and page.tag[e] not in LEAVES and held[e] >= CONTAINER_SHARE * held[0] > 0:
            section = e
    inside = [False] * len(page.parent)
    for e in range(len(inside)):
        inside[e] = e == section or (e > 0 and inside[page.parent[e]])
    whole = page.tag[section] in ("article", "main")
    kept = [b[0] for b, c in zip(blocks, content, strict=True) if inside[b[2]] and b[4] <= LINK_SHARE and (c or whole or page.tag[b[2]] in LEAVES)]
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Pages are read independently of each other, so nothing is shuffled.  A null html is an
    empty page; page_id and url are passed on, null or repeated.
    """

    def run(sources: list[str | None]) -> tuple[None, dict[str, list]]:
        text = [extract(h, threshold) for h in sources]
        return None, {"text": text, "n_chars": [len(t) for t in text]}

    made = {"text": ("string", pa.string()), "n_chars": ("long", pa.int64())}
    return map_texts(pages, ["page_id", "url"], "html", made, run)
