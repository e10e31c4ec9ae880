"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing and clustering.

Events of the standard library's parser are turned into lines: the text between
two block tags.  A line's ratio is its characters outside links for each tag, and 0
in elements that are never content.  Ratios are smoothed by a Gaussian and
split in two clusters; lines of the higher one are content.

The region comes from the content lines: from the root on, an element is left for
the child that holds all of its content, as long as neither a heading nor
an article begins there; of several articles the one with the most content is taken.
All lines of the region are kept but those

* in elements that HTML or a plain name (class, id or role) sets aside as
  menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
  comments of readers, and
* in elements whose name only hints at it (`HINTS`, one part of a longer name)
  if none of their lines is prose, by the same smoothed ratios.

A page without content lines (all ratios 0) has no text.  Work is linear in the page, however deep
its elements: each element is summed up once.

Defined cases: a null or empty page, or one without content, gives an empty
text; unclosed and wrongly nested tags end with the next enclosing end tag; a tag cut off
at the end of the page is no text; pages of any length are read whole; repeated rows are rows like others.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, REACH = 1.0, 2

# fixed values: element, attribute and role names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("head title script style noscript template nav aside footer form button select textarea option input iframe object svg canvas audio video dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

#: Parts of names (class or id) that hint at it; content in such an element is kept.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond reply replies footer header masthead share sharing social related recommended newsletter subscribe subscription popup modal overlay paywall pagination pager login signup widget toolbar".split())
#: A name that has only hints and these parts says plainly what the element is.
GENERIC = frozenset("main site page top bottom left right side bar box block area container wrapper section list item items slot links link buttons button form text posts articles stories inner outer cookie".split())
#: So does one with these, but for the header of an article.
OWNERS = frozenset("article post entry blog user users reader readers".split())

KEPT, HINTED, GONE, HIDDEN = range(4)
#: What an open element of the first kind is ended by, up to the next container.
ENDS = {"p": ("p",), "li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTAINERS = ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote", "figure", "details")

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)


def _by_name(attrs: dict[str, str | None]) -> int:
    """KEPT, HINTED or GONE, by the attributes of an element."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES or _NONE.search(attrs.get("style") or ""):
        return GONE
    found = KEPT
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = _PART.findall(_CAMEL.sub("-", name).lower())
        hints = HINTS.intersection(parts)
        if hints:
            owned = not OWNERS.isdisjoint(parts)
            if HINTS.union(GENERIC, OWNERS).issuperset(parts) and not (owned and hints == {"header"}):
                return GONE
            found = HINTED
    return found


class Page(HTMLParser):
    """Lines of a page (text, link characters, tags, element) and its elements (tag, parent, own mark)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.tag, self.parent, self.mark, self.main = ["html"], [0], [KEPT], [False]
        self.gone = [KEPT]  # the strongest of GONE and HIDDEN from the root on
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # depths in the stack of the open elements of a tag
        self.text: list[str] = []
        self.links = self.tags = 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, min(self.links, len(text)), max(1, self.tags), self.stack[-1]))
            self.tags = 0
        self.text, self.links = [], 0

    def _cut(self, depth: int) -> None:
        """End the open elements from a depth on."""
        while len(self.stack) > depth:
            self.open[self.tag[self.stack.pop()]].pop()

    def _depth(self, tags: tuple[str, ...]) -> int:
        return max((at[-1] for t in tags if (at := self.open.get(t))), default=0)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if tag in ENDS and (depth := self._depth(ENDS[tag])) > self._depth(CONTAINERS):
            self._cut(depth)
        attrs, above = dict(attrs), self.gone[self.stack[-1]]
        within = bool(self.open.get("article") or self.open.get("main"))
        if tag in ("article", "main"):
            above = KEPT if not any(self.open.get(t) for t in ("dialog", "template", "noscript")) else above
        if tag in DROPPED or (tag == "header" and not within):
            mark = GONE
        else:
            mark = KEPT if tag in ("html", "body", "article", "main") or tag in HEADINGS else _by_name(attrs)
        if mark == GONE and tag not in BLOCK:
            mark = HIDDEN
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tag))
        self.parent.append(self.stack[-2])
        self.tag.append(tag)
        self.mark.append(mark)
        self.main.append(tag in ("article", "main") or attrs.get("role") == "main")
        self.gone.append(max(above, mark if mark >= GONE else KEPT))

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._flush()
        if at := self.open.get(tag):
            self._cut(at[-1])

    def handle_data(self, data):
        if self.gone[self.stack[-1]] < HIDDEN:
            self.text.append(data)
            if self.open.get("a"):
                self.links += len(data)

    def end(self) -> None:
        self.close()
        self._flush()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means over REACH lines on either side; beyond the ends the last ratio goes on."""
    reach = np.arange(-REACH, REACH + 1)
    weights = np.exp(-(reach**2) / (2 * sigma * sigma))
    padded = np.pad(ratios, REACH, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Midpoint of the means of two clusters of the values (2-means from the extremes)."""
    lo, hi = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (lo + hi) / 2
        low, high = values[values < middle], values[values >= middle]
        new = (float(low.mean()) if len(low) else lo, float(high.mean()) if len(high) else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def content(ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are content, and which are prose at least.

    Content: ratios above 0 whose smoothed ratio is in the higher cluster of those.  Prose: the same with the logarithms of
    the smoothed ratios and 0, as a line of links has it; short paragraphs are prose beside long ones.
    """
    smoothed = smooth(ratios)
    some = (ratios > 0) & (smoothed > 0)
    if not some.any():
        return some, some
    logs = np.log1p(smoothed)
    prose = some & (logs >= threshold(np.append(logs, 0.0)))
    return some & (smoothed >= min(threshold(smoothed[some]), float(smoothed[some].max()))), prose


def _region(page: Page, weight: np.ndarray) -> int:
    """The element of the main text, by the content characters of all elements."""
    articles = [e for e in range(len(weight)) if page.main[e] and page.tag[e] == "article" and weight[e] > 0] or [e for e in range(len(weight)) if page.main[e] and weight[e] > 0]
    if articles:
        return max(articles, key=lambda e: (weight[e], -e))
    children: dict[int, list[int]] = {}
    headed = set()
    for e in range(1, len(weight)):
        if page.gone[e] < GONE:
            if page.tag[e] in HEADINGS:
                headed.add(page.parent[e])
            elif weight[e] > 0:
                children.setdefault(page.parent[e], []).append(e)
    at = 0
    while at not in headed and len(inner := children.get(at, [])) == 1 and weight[inner[0]] == weight[at] and page.tag[inner[0]] not in ("p", "li", "td", "th", "dd", "dt"):
        at = inner[0]
    return at


def main_text(html: str | None) -> str:
    if not html:
        return ""
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"<[a-zA-Z/!?]", html[cut:]):
        html = html[:cut]
    page = Page()
    page.feed(html)
    page.end()
    if not page.lines:
        return ""
    at = [element for *_, element in page.lines]
    on, prose = content(np.array([0.0 if page.gone[e] else (len(text) - linked) / tags for text, linked, tags, e in page.lines]))
    if not on.any():
        return ""
    weight, said = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for (text, *_, e), yes, some in zip(page.lines, on.tolist(), prose.tolist(), strict=True):
        weight[e] += len(text) if yes else 0
        said[e] += some
    for e in range(len(weight) - 1, 0, -1):  # a parent stands before its children
        weight[page.parent[e]] += weight[e]
        said[page.parent[e]] += said[e]
    region = _region(page, weight)
    kept = [False] * len(weight)
    for e in range(len(weight)):
        inside = e == region or (e > 0 and kept[page.parent[e]])
        kept[e] = inside and page.gone[e] < GONE and not (page.mark[e] == HINTED and not said[e])
    return " ".join(text for (text, *_), e in zip(page.lines, at, strict=True) if kept[e])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches):
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInPandas(run, f"{schema}, text string, n_chars long")
