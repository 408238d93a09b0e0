"""Main text of web pages by text-to-tag ratios.

The standard library's parser is fed in chunks; its events are cut into lines at block elements. Each line has a
ratio of text length to tags, the ratios are smoothed with a Gaussian, and lines over the threshold form clusters. The clusters
choose the region: if half their text or more lies in article and main elements, those elements with a fair share of it,
whole (so that their short lines stay); otherwise the innermost container with four fifths of the clusters' text, or
what lies between the first and the last cluster, without lines of mostly links.

Structure corrects what ratios can't see: lines in navigation, headers, footers, asides, forms, scripts, hidden or
advertising elements are never text and count as lines of ratio 0. A class, id or role is a sign of those if a whole token of
it is one or is a compound of signs and plain qualifiers (site-footer, but not has-sidebar), or if a part of it names comments or adverts; an element with a sign is text all
the same if it holds the article or, on a page without an article elsewhere, most of the text.

An inline element never ends a line: what isn't text in a paragraph is left out of it. A comment that is never closed reaches to
the end of the page.

Nulls and empty pages give an empty text. Markup that isn't closed or well nested is closed where HTML's rules or
the next structural element imply it. A page takes time in proportion to its length, however deep it is nested. Repeated
pages give repeated rows, an empty table an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Elements, and words in class, id and role, that mark what isn't text.
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg object dialog menu canvas audio video".split())
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header cookie cookies consent notice notices"
    " popup modal overlay newsletter subscribe share sharing social related recommended comment comments disqus reply replies respond login search pagination pager widget toolbar complementary contentinfo hidden alert".split()
)
#: Words that may stand beside a sign in a compound without changing what it says.
PLAIN = frozenset("site page main top bottom left right primary secondary global sticky fixed mobile desktop list box bar block container wrapper wrap area section inner outer unit slot buttons button links link form posts items".split())
KNOWN = SIGNS | PLAIN
#: Words that are signs as any part of a token, and those that are as its last part; a token with one of NOT says what isn't there.
ANYWHERE = frozenset("comment comments discussion discussions disqus replies advert adverts advertisement advertising adsense adslot sponsor sponsored".split())
AT_END = frozenset("ad ads".split())
NOT = frozenset("no not without has hide disabled".split())
#: Signs that say nothing of a part of an article.
WITHIN = frozenset("header notice notices alert".split())
#: Signs of what may well be longer than the article.
TALK = frozenset("comment comments discussion discussions disqus reply replies respond".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
REGIONS = frozenset({"article", "main"})
CONTAINERS = frozenset({"div", "section", "td", "center", "dd"})
#: What the search for elements to close doesn't look beyond, and what an article that was never closed before ends.
BARRIERS = frozenset({"article", "main", "td", "th", "table", "button"})
LEFT_OPEN = ("nav", "aside", "header", "form", "menu", "head")
WIDTH = 1.0


@dataclass(slots=True)
class Element:
    tag: str
    bad: bool  # in boilerplate
    region: int  # number of the article or main around it, or -1
    container: int  # numbers of the innermost container and marked element, itself included; 0 for none
    mark: int
    outside: int  # the innermost mark outside the article around it; -1 without an article
    ends: bool  # whether its end ends a line
    soft: bool = False  # in boilerplate because of an inline element's signs, which a block inside it doesn't share


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    linked: int  # characters in links
    fit: bool  # whether it can be text
    region: int
    container: int
    mark: int
    outside: int


class Lines(HTMLParser):
    """lines; up: each container's parent; above: each marked element's parent, with its signs in marks. Parents have smaller numbers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Element] = []
        self.at: dict[str, list[int]] = {}  # places of the open elements by tag
        self.up, self.above, self.marks = [0], [0], [frozenset()]
        self.regions, self.text, self.tags, self.linked = 0, [], 0, 0
        self.top = Element("", False, -1, 0, 0, -1, False)

    def innermost(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=-1)

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                x = self.open[-1] if self.open else self.top
                self.lines.append(Line(text, self.tags, self.linked, not x.bad, x.region, x.container, x.mark, x.outside))
                self.tags = 0
            self.text, self.linked = [], 0

    def cut(self, depth: int) -> None:
        """Closes all elements from depth on; the line ends if one of them is a block."""
        if any(x.ends for x in self.open[depth:]):
            self.end_line()
        while len(self.open) > depth:
            self.at[self.open.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        inside = self.open[-1] if self.open else self.top
        if tag in BLOCKS and not (inside.bad and not inside.soft):
            self.end_line()
            wall = self.innermost(BARRIERS | HOLDS.get(tag, frozenset()))
            own = CLOSES.get(tag, frozenset())
            while (i := max(self.innermost(own), self.innermost(("p",)))) >= 0:  # what this element closes by itself
                if i < wall:
                    break
                again = self.open[i].tag == "p"
                self.cut(i)
                if not again:
                    break
        if tag in VOID:
            return
        if tag in REGIONS or tag == "footer":  # an element of navigation that was never closed ends here
            left = [i for t in LEFT_OPEN for i in self.at.get(t, ())[:1] if self.open[i].region == -1]
            if left:
                self.cut(min(left))
        x = self.open[-1] if self.open else self.top
        block = tag in BLOCKS or tag == "body"
        soft = x.soft and not block
        bad, region, mark, signs = x.bad and (soft or not x.soft), x.region, x.mark, None
        if tag == "body":
            bad = False
        elif tag in NEVER or (tag == "header" and region == -1):
            bad, soft = True, False
        elif not bad and tag not in ("html", "main") and attrs:
            bad = self.hidden(attrs)
            signs = self.signs(attrs)
            if tag == "article":  # only comments are articles in an article
                signs &= TALK
            if not bad and signs and (region == -1 or signs - WITHIN):
                if not block:
                    bad = soft = True
                else:
                    mark = len(self.marks)
                    self.marks.append(signs)
                    self.above.append(x.mark)
        outside = x.mark if tag in REGIONS and mark == x.mark else x.outside
        if tag in REGIONS and not bad and region == -1:
            region, self.regions = self.regions, self.regions + 1
        if mark != x.mark or (bad and not x.bad and block):
            self.end_line()
        container = x.container
        if tag in CONTAINERS:
            container = len(self.up)
            self.up.append(x.container)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(Element(tag, bad, region, container, mark, outside, block and not (x.bad and bad), soft))

    @staticmethod
    def signs(attrs: list[tuple[str, str | None]]) -> set[str]:
        """The signs of an element: whole tokens, or compounds of nothing but signs, qualifiers and numbers."""
        found: set[str] = set()
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                for token in value.lower().split():
                    parts = [p for p in re.split(r"[^a-z]+", token) if p]
                    if KNOWN.issuperset(parts):
                        found |= SIGNS.intersection(parts)
                    elif not NOT.intersection(parts):
                        found |= ANYWHERE.intersection(parts) | AT_END.intersection(parts[-1:])
        return found

    @staticmethod
    def hidden(attrs: list[tuple[str, str | None]]) -> bool:
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        i, wall = self.innermost((tag,)), self.innermost(REGIONS)
        if i < wall and tag not in REGIONS and tag not in ("body", "html"):
            return
        if i >= 0:
            self.cut(i)
        elif tag in BLOCKS and not (self.open and self.open[-1].bad):
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].bad:
            return
        self.text.append(data)
        if any(x.tag == "a" for x in self.open[-3:]):
            self.linked += len(data)

    def finish(self) -> list[Line]:
        if self.rawdata.startswith("<!--"):  # a comment that is never closed reaches to the end
            self.rawdata = ""
        self.close()
        self.end_line()
        self.judge()
        return self.lines

    def judge(self) -> None:
        """Lines in marked elements that neither hold the article nor most of the page's text can't be text."""
        lines = [x for x in self.lines if x.fit]
        own, inside, clear, beside = [0] * len(self.marks), [0] * len(self.marks), 0, 0
        for x in lines:
            n = len(x.text)
            own[x.mark] += n
            clear += n * (not x.mark)
            beside += n * (not x.mark and x.outside >= 0)  # text in unmarked articles
            inside[max(x.outside, 0)] += n
        total = sum(own)
        for m in range(len(self.marks) - 1, 0, -1):
            own[self.above[m]] += own[m]
            inside[self.above[m]] += inside[m]
        ok = [True] * len(self.marks)
        for m in range(1, len(self.marks)):
            lifted = bool(own[m]) and (not clear if self.marks[m] & TALK else (2 * own[m] > total and not beside) or (inside[m] > 0 and inside[m] >= beside))
            ok[m] = lifted and ok[self.above[m]]
        for x in lines:
            x.fit = ok[x.mark]


def smoothed(ratios: np.ndarray, width: float = WIDTH) -> np.ndarray:
    reach = int(np.ceil(3 * width))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), weights / weights.sum(), "valid")


def clusters(lines: list[Line]) -> np.ndarray:
    """Which lines lie in clusters of text: those whose smoothed ratio of text to tags reaches the threshold."""
    fit = np.array([x.fit for x in lines])
    smooth = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]) * fit)
    threshold = min(smooth.std() if len(lines) > 2 else 0.0, smooth.mean())
    plain = np.array([2 * x.linked <= len(x.text) or x.region >= 0 for x in lines])
    found = fit & plain & (smooth >= threshold) & (smooth > 0)
    return found if found.any() else fit


def main_text(html: str) -> str:
    parser = Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    lines = parser.finish()
    if not lines:
        return ""
    found = clusters(lines)
    fit, region, size = np.array([x.fit for x in lines]), np.array([x.region for x in lines]), np.array([len(x.text) for x in lines])
    weight = {r: int(size[found & (region == r)].sum()) for r in np.unique(region[found]).tolist() if r >= 0}
    total = int(size[found].sum())
    if weight and 2 * sum(weight.values()) >= total:
        most = max(weight.values())
        content = fit & np.isin(region, [r for r, n in weight.items() if 4 * n >= most])
    else:
        content = fit & np.array([2 * x.linked <= len(x.text) or x.region >= 0 for x in lines])
        # short lines between the clusters, or anywhere in the innermost container that holds them, are text too
        held = np.zeros(len(parser.up), np.int64)
        np.add.at(held, [x.container for x in lines], size * found)
        for c in range(len(held) - 1, 0, -1):
            held[parser.up[c]] += held[c]
        inner = max((c for c in np.flatnonzero(5 * held >= 4 * total).tolist()), default=0)
        if inner and total:
            within = np.zeros(len(held), bool)
            for c in range(inner, len(held)):
                within[c] = c == inner or within[parser.up[c]]
            content &= within[[x.container for x in lines]]
        elif total:
            at = np.flatnonzero(found)
            content &= (np.arange(len(lines)) >= at[0]) & (np.arange(len(lines)) <= at[-1])
    return "\n".join(x.text for x, c in zip(lines, content.tolist(), strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
