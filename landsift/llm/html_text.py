"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered by a threshold.

The standard library's parser streams its events; no tree is built. A line is the text of one
block. Its ratio is its characters outside links by its tags. The ratios of a page are
smoothed by a Gaussian kernel, and lines at or above the standard deviation of the smoothed
ratios are the content cluster. It selects regions, and these are given back whole, short
lines included: the outermost ``article`` elements that hold cluster lines, else ``main``,
else the innermost containers (``div``, ``section``, cells, ``body``). Elements that are
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments of
readers by tag, role or class stay outside every region, and so do menus of links.

Defined results: a null or empty html, or one without text, gives an empty text; a page
whose text stands in such elements alone gives the text of those told by class (not by tag);
page_id and url may be null or repeated; unclosed tags end with their container, an unclosed
comment or tag at the end is dropped; of further columns, whatever their names, none counts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.token_ids import slices

#: Names of HTML elements and usual class names.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("html body div section article main header footer aside nav form td th center fieldset".split())
BLOCKS = CONTAINERS | HEADINGS | set(
    "head title p ul ol li dl dt dd menu table caption thead tbody tfoot tr blockquote pre figure figcaption hr address "
    "details summary dialog template noscript script style".split()
)
#: Elements whose text is never read, and boilerplate that the page may count as lines.
SILENT = set("head title script style template noscript svg iframe object canvas audio video textarea select datalist".split())
ASIDE = set("nav footer aside form menu dialog button".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form note".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead copyright colophon "
    "sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay toast "
    "share sharing social related recommended newsletter subscribe subscription signup login search skip".split()
)
READERS = set("comment comments commentlist reply replies respond disqus discussion".split())
#: Class words that tell of what a wrapper holds or lacks, not of what it is.
WRAPPERS = set("no has with without layout".split())
#: Elements that end an open one of their own kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Gaussian kernel: standard deviation and reach in lines.
SIGMA, REACH = 1.0, 2
_KERNEL = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
_SPLIT = re.compile("(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")
_CUT_OFF = re.compile("<[a-zA-Z/!?]")


def _told(tag: str, attrs: list) -> str:
    """What an element is by tag, role and class: silent, aside, named, header or nothing."""
    if tag in SILENT:
        return "silent"
    given = dict(attrs)
    if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower():
        return "silent"
    if tag in ASIDE or (given.get("role") or "").lower() in ROLES:
        return "aside"
    if tag == "header":
        return "header"
    if tag not in ("html", "body", "main"):
        names = {x.lower() for c in ("class", "id") if given.get(c) for x in _SPLIT.split(given[c])}
        if names & READERS or (tag != "article" and names & NAMES and not names & WRAPPERS):
            return "named"
        if tag != "article" and "header" in names and not names & WRAPPERS:
            return "header"
    return ""


class Lines(HTMLParser):
    """The lines of one page: text, tags, characters in links, container, boilerplate, heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.containers: list[tuple] = [("", -1)]  # tag and container around it
        self._open: list[list] = []  # tag, what it is, its container, inner elements of its own kind (inline only)
        self._count: dict[str, int] = {}
        self._parts: list[str] = []
        self._tags = self._linked = 0
        self._link = self._heading = False
        self._why = {"silent": 0, "aside": 0, "named": 0, "header": 0}

    def updatepos(self, i, j):  # line numbers are not needed
        return j

    def parse_marked_section(self, i, report=1):  # the library raises on unknown ones
        k = self.rawdata.find(">", i)
        return k + 1 if k >= 0 else -1

    def _flush(self):
        text = " ".join("".join(self._parts).split())
        if text:
            why = "aside" if self._why["aside"] else "named" if self._why["named"] else ""
            if not why and self._why["header"] and not (self._heading and self._inside()):
                why = "aside"
            self.lines.append((text, self._tags, min(self._linked, len(text)), self._open[-1][2] if self._open else 0, why, self._heading))
            self._tags = 0
        self._parts, self._linked = [], 0

    def _inside(self):
        return self._count.get("article", 0) or self._count.get("main", 0)

    def _push(self, tag, what):
        where = self._open[-1][2] if self._open else 0
        if tag in CONTAINERS:
            self.containers.append((tag, where))
            where = len(self.containers) - 1
        self._open.append([tag, what, where, 0])
        self._count[tag] = self._count.get(tag, 0) + 1
        if what:
            self._why[what] += 1

    def _pop(self):
        tag, what = self._open.pop()[:2]
        self._count[tag] -= 1
        if what:
            self._why[what] -= 1

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._parts.append(" ")
            return
        what = _told(tag, attrs)
        if tag in BLOCKS:
            self._flush()
            self._link = False
            while self._open and (self._open[-1][0] not in BLOCKS or self._open[-1][0] == "p"):
                self._pop()
            ends = SIBLINGS.get(tag, ())
            if any(self._count.get(x, 0) for x in ends):
                depth = next((d for d, f in enumerate(reversed(self._open)) if f[0] in ends or f[0] in ("ul", "ol", "dl", "table")), None)
                if depth is not None and self._open[-1 - depth][0] in ends:
                    for _ in range(depth + 1):
                        self._pop()
            self._heading = tag in HEADINGS
            self._push(tag, what)
        elif what:  # an inline element that is boilerplate: a frame of its own
            self._flush()
            self._push(tag, what)
        elif self._open and self._open[-1][0] == tag:
            self._open[-1][3] += 1
        if tag == "a":
            self._link = True

    def handle_startendtag(self, tag, attrs):  # the slash counts for nothing in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag == "a":
            self._link = False
        top = self._open[-1] if self._open else None
        if tag not in BLOCKS and (not top or top[0] != tag):
            return
        if tag not in BLOCKS and top[3]:
            top[3] -= 1
            return
        if self._count.get(tag, 0):
            self._flush()
            while self._open[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag in BLOCKS:
            self._flush()
        self._heading = False

    def handle_data(self, data):
        if not self._why["silent"]:
            self._parts.append(data)
            if self._link:
                self._linked += len(data.strip())

    def read(self, html: str) -> list[tuple]:
        self.feed(html)
        if not _CUT_OFF.match(self.rawdata):  # else a tag or comment without an end
            self.close()
        self._flush()
        return self.lines


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means of neighbouring ratios; at the ends of those that are there."""
    n = len(ratios)
    weight = np.convolve(np.ones(n), _KERNEL)[REACH : REACH + n]
    return np.convolve(ratios, _KERNEL)[REACH : REACH + n] / weight


def _home(containers: list, where: int, tag: str) -> int:
    """The outermost container of a tag around a container, or 0."""
    found = 0
    while where > 0:
        if containers[where][0] == tag:
            found = where
        where = containers[where][1]
    return found


def main_text(html: str | None) -> str:
    """The blocks of the page's content regions, one per line."""
    page = Lines()
    lines, containers = page.read(html or ""), page.containers
    for open_to in ("", "named"):  # text told by class alone counts where there is no other
        shown = [k for k, x in enumerate(lines) if x[4] in ("", open_to)]
        if shown:
            break
    else:
        return ""
    ratios = np.array([(len(text) - linked) / max(1, tags) for text, tags, linked, *_ in lines])
    smooth = smoothed(ratios)
    level = smooth.std()
    cluster = {k for k in shown if smooth[k] >= level and 2 * lines[k][2] < len(lines[k][0])}
    inner = {w: {tag: _home(containers, w, tag) for tag in ("article", "main")} for w in {lines[k][3] for k in shown}}
    for tag in ("article", "main"):
        size: dict[int, int] = {}
        for k in shown:
            home = inner[lines[k][3]][tag]
            if home:
                size[home] = size.get(home, 0) + len(lines[k][0]) * (k in cluster)
        if size:
            most = max(size.values())
            picked = {home for home, n in size.items() if 4 * n >= most}
            return "\n".join(lines[k][0] for k in shown if inner[lines[k][3]][tag] in picked)
    chosen = {lines[k][3] for k in cluster if ratios[k] >= level}
    chosen |= {lines[k][3] for k in cluster if lines[k][5] and k + 1 in cluster and lines[k + 1][3] in chosen}

    def held(where: int) -> bool:
        if where in chosen:
            return True
        while where > 0 and containers[where][0] not in ("body", "html"):
            if where in chosen:
                return True
            where = containers[where][1]
        return False

    within = {w: held(w) for w in inner}
    linked: dict[int, list] = {}
    for k in shown:
        sums = linked.setdefault(lines[k][3], [0, 0])
        sums[0] += lines[k][2]
        sums[1] += len(lines[k][0])
    menus = {w for w, (a, b) in linked.items() if 2 * a > b and w not in chosen}
    kept = [k for k in shown if within[lines[k][3]] and lines[k][3] not in menus] or [k for k in shown if 2 * lines[k][2] < len(lines[k][0])]
    return "\n".join(lines[k][0] for k in kept or shown)


ROWS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Main text of every page, from its whole html, and how many code points it has."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "html"):
                texts = [main_text(h) for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [x.split()[0] for x in ROWS.split(", ")],
                )

    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col("`url`").alias("url"), F.col(f"`{html}`").alias("html"))
    return rows.mapInArrow(run, ROWS)
