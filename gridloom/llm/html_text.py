"""Operator 6: main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser sends its events to a collector that cuts the page into lines (one for each block
element's run of text) and counts each line's characters and tags. The ratios, smoothed by a Gaussian over the
lines, are clustered by a threshold into content and the rest. The innermost region of the page (article, main or
another sectioning element) that holds all content lines is selected; its lines are kept in page order, so that a short
paragraph inside an article is not lost, and paragraphs and headings outside it too. The clusters decide about lines
that may be either: outside an article those that are mostly links; within one lists of short links (other stories, share
lines).

Elements that by name, role or class are never part of an article (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are hidden. What only looks so is not: an article or main element within a
menu, header, footer, sidebar or form shows; on a page without one so does an element whose paragraphs and headings are
more than half of the page's text without links, unless it holds reader comments. A class or id counts as a whole
("share-buttons" marks, "share-prices" doesn't), never on a heading; within an article it hides adverts and reader
comments, and else only what has short lines or mostly links. What hides in the middle of a line leaves
that line whole.

Any text is a page: unfinished tags and comments end with the page, unknown declarations are comments, and the time is
in proportion to the length. A null or empty page gives an empty text. Pages are independent: repeated rows give
repeated results, an empty table an empty table, and other columns ride along (one named like an output column is
replaced).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField

from gridloom.llm.common import read_table, texts, with_columns

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Hidden whatever they hold.
NEVER = frozenset("head script style noscript template button select textarea input iframe object svg canvas menu dialog audio video title".split())
#: Hidden unless they hold most of the page; those in the first set don't hide an article in them either.
PARTS = frozenset("nav header footer form".split())
ASIDE = frozenset(["aside"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks whose text is kept outside the selected region too, unless most of it is links.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
REGIONS = ("article", "main", "section", "div", "body", "html")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class and id names that mark boilerplate: of reader comments, of adverts, of parts of a page beside which an article
#: stands or in which it may be wrapped, and of others.
MARKS = {
    "comments": "comment comments commentlist comment-list replies respond disqus",
    "adverts": "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions",
    "beside": "sidebar side menu nav navbar navigation footer header masthead banner toolbar widget widgets",
    "others": "cookie cookies consent gdpr notice newsletter subscribe popup modal breadcrumb breadcrumbs share sharing social related recommended login search pager pagination",
}
KINDS = {word: kind for kind, words in MARKS.items() for word in words.split()}
#: Words that change nothing beside a mark: "share-buttons" is one, "share-prices" isn't.
NEUTRAL = frozenset(
    "area bar block bottom box button buttons center col column container content form group icon icons inner item items left link links list "
    "main message outer page panel posts primary right row secondary section site slot stories text top unit wrap wrapper".split()
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^A-Za-z\d_-]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SHOWN, NAMED, WRAPS, FIRM, GONE = range(5)
#: In an article lists of links go if their lines are shorter on average and aren't content; and elements that only
#: their name marks if their lines are, or are mostly links.
SHORT = 50
#: Elements of an open paragraph: a block start closes it.
CLOSES_P = BLOCKS - frozenset("option legend caption summary tbody td tfoot th thead tr html body".split())
SPACE = re.compile(r"[\s\x00]+")
EMPTY_COMMENT = re.compile("<!---?>")


@dataclass
class Line:
    """A run of text between block borders."""

    text: str
    tags: int
    region: int
    veil: int  # the innermost hiding element that may turn out not to hide, or -1
    prose: bool  # a paragraph or heading
    linked: int  # characters in links
    main: bool  # in an article or main element
    links: int  # how many links it has
    named: int  # the innermost element in an article that only its name marks, or -1


@lru_cache(maxsize=4096)
def mark_of(name: str) -> str:
    """What a class or id name marks, as a whole: each of its words is a mark or neutral, and one is a mark."""
    whole = KINDS.get(name.lower())
    if whole:
        return whole
    if len(name) > 60:
        return ""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    if not all(p in KINDS or p in NEUTRAL for p in parts):
        return ""
    kinds = {KINDS[p] for p in parts if p in KINDS}
    return next((k for k in MARKS if k in kinds), "")


class Lines(HTMLParser):
    """Collects lines, from whole or cut pages. The page is fed at once."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # name, whether it hides for good, the veil and the named element outside it
        self.places: dict[str, list[int]] = {}  # where in ``open`` each name is
        self.blocks: list[int] = []  # where in ``open`` block elements are
        self.veil = -1
        self.veils: list[int] = []  # the veil outside each
        self.firm: list[bool] = []  # whether each, or one outside it, hides articles too
        self.region: list[int] = [0]
        self.regions: list[tuple[str, int]] = [("html", -1)]  # name, parent
        self.lines: list[Line] = []
        self.linked = self.links = 0
        self.named = -1
        self.names: list[int] = []  # the named element outside each
        self.hiding: list[int] = []  # where in ``open`` elements are that hide for good
        self.text: list[str] = []
        self.tags = 0

    # what isn't finished goes on to the end of the page

    def parse_starttag(self, i):
        end = super().parse_starttag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i):
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        quick = EMPTY_COMMENT.match(self.rawdata, i)
        if quick:
            return quick.end()
        end = self.rawdata.find("-->", i + 4)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i):
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_pi(self, i):
        return self.parse_html_declaration(i)

    def cut(self) -> None:
        if self.hiding:
            return  # a block that doesn't show doesn't end the line around it
        if self.text:
            line = SPACE.sub(" ", "".join(self.text)).strip()
            if line:
                block = self.open[self.blocks[-1]][0] if self.blocks else ""
                inside = bool(self.places.get("article") or self.places.get("main"))
                self.lines.append(Line(line, self.tags, self.region[-1], self.veil, block in PROSE, self.linked, inside, self.links, self.named))
                self.tags = 0
            self.text, self.linked, self.links = [], 0, 0

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        kind = SHOWN if tag in VOID else self.hides(tag, attrs, block)
        if block:
            # what hides in the middle of a line leaves the line whole
            if tag not in NEVER:
                self.cut()
            open_p = self.blocks and self.open[self.blocks[-1]][0] == "p"
            if tag in CLOSES_P and open_p and not (self.hiding and self.hiding[-1] > self.blocks[-1]):
                self.pop(self.blocks[-1])
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        self.links += tag == "a" and not self.hiding
        self.places.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        if kind == GONE:
            self.hiding.append(len(self.open))
        self.open.append((tag, kind == GONE, self.veil, self.named))
        if kind == NAMED:
            self.names.append(self.named)
            self.named = len(self.names) - 1
        elif kind in (WRAPS, FIRM):
            # whether an article in it shows depends on all veils around it
            self.veils.append(self.veil)
            self.veil = len(self.veils) - 1
            self.firm.append(kind == FIRM or self.veils[self.veil] >= 0 and self.firm[self.veils[self.veil]])
        elif tag in ("article", "main") and self.veil >= 0 and not self.firm[self.veil]:
            self.veil = -1
        if tag in REGIONS:
            self.regions.append((tag, self.region[-1]))
            self.region.append(len(self.regions) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def hides(self, tag, attrs, block: bool) -> int:
        """Whether an element hides, at the most: a part of a line that does hides for good."""
        if tag in NEVER:
            return GONE
        found = FIRM if tag in ASIDE else WRAPS if tag in PARTS and not (tag == "header" and self.places.get("article")) else SHOWN
        if tag in ("html", "body", "article", "main") or not attrs:
            return found
        inside = self.places.get("article") or self.places.get("main")
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return GONE
            if not value:
                continue
            if name == "style" and UNSEEN.search(value):
                return GONE
            if name == "role" and value.strip().lower() in ROLES:
                found = max(found, WRAPS if block else GONE)
            elif name in ("class", "id") and tag not in HEADINGS:
                for mark in map(mark_of, value.split()):
                    if mark == "comments":
                        return GONE
                    if mark and not block:
                        found = GONE if mark == "adverts" or not inside else found
                    elif mark:
                        found = max(found, FIRM if mark == "adverts" else NAMED if inside else WRAPS if mark == "beside" else FIRM)
        return found

    def pop(self, depth: int) -> None:
        while len(self.open) > depth:
            name, gone, self.veil, self.named = self.open.pop()
            if gone:
                self.hiding.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            if name in REGIONS:
                self.region.pop()

    def handle_endtag(self, tag):
        block = tag in BLOCKS
        if block and tag not in NEVER:
            self.cut()
        self.tags += 1
        places = self.places.get(tag)
        # an inline element doesn't end outside the block that it ends in, unless it hides that
        if places and (block or not self.blocks or places[-1] > self.blocks[-1] or self.open[places[-1]][1]):
            self.pop(places[-1])

    def handle_data(self, data):
        if not self.hiding:
            self.text.append(data)
            self.linked += len(data.strip()) if self.places.get("a") else 0

    def finish(self) -> list[Line]:
        """All lines that show."""
        self.close()
        self.cut()
        total = sum(len(x.text) - x.linked for x in self.lines)
        held = [0] * len(self.veils)
        for x in self.lines:
            if x.veil >= 0:
                held[x.veil] += len(x.text) - x.linked if x.prose else 0
        for k in range(len(held) - 1, -1, -1):
            if self.veils[k] >= 0:
                held[self.veils[k]] += held[k]
        shows: list[bool] = []
        if any(x.main and x.veil < 0 for x in self.lines):
            total = 2 * sum(held)  # there is an article, so nothing else comes in its place
        for k, outside in enumerate(self.veils):
            shows.append(2 * held[k] > total and (outside < 0 or shows[outside]))
        return [x for x in self.lines if x.veil < 0 or shows[x.veil]]


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    sums = np.convolve(values, kernel, "full")[reach : reach + len(values)]
    return sums / np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Two clusters of the smoothed ratios by an iterated threshold (midway between the clusters' means)."""
    smooth = smoothed(ratios)
    cut = smooth.mean()
    for _ in range(20):
        high, low = smooth[smooth >= cut], smooth[smooth < cut]
        if not len(low):
            break
        new = (high.mean() + low.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return smooth >= cut


def main_text(html: str) -> str:
    """The blocks of the selected region, joined by an empty line."""
    page = Lines()
    page.feed(html)
    lines = page.finish()
    if not lines:
        return ""
    content = content_lines(np.array([len(x.text) / max(1, x.tags) for x in lines], float)).tolist()
    parent = [up for _, up in page.regions]
    weight = [0] * len(parent)
    for x, is_content in zip(lines, content):
        weight[x.region] += len(x.text) if is_content else 0
    for k in range(len(parent) - 1, 0, -1):
        weight[parent[k]] += weight[k]
    # the innermost region that holds all content lines
    pick = max((k for k in range(len(weight)) if weight[k] == weight[0]), default=0)
    inside = [k == pick for k in range(len(weight))]
    for k in range(pick + 1, len(weight)):
        inside[k] = inside[parent[k]]
    goes = named_parts(lines, page.names)
    linky = [2 * x.linked >= len(x.text) for x in lines]
    lists = link_lists(lines, linky)

    def stays(k: int) -> bool:
        x = lines[k]
        if x.main:
            return not lists[k] and not (x.named >= 0 and goes[x.named])
        return (inside[x.region] or x.prose and not linky[k]) and (content[k] or not linky[k])

    return "\n\n".join(x.text for k, x in enumerate(lines) if stays(k))


def link_lists(lines: list[Line], linky: list[bool]) -> list[bool]:
    """Lines of articles in lists of links (of other stories, to share): several short links that the clusters tell from
    the text. Each list is one region here, as wide as the Gaussian, so that its own ratio counts."""
    runs: list[list[int]] = []
    for k in range(len(lines)):
        if k and linky[k] and linky[k - 1] and lines[k].main == lines[k - 1].main:
            runs[-1].append(k)
        else:
            runs.append([k])
    wide = 7
    several = [lines[own[0]].main and linky[own[0]] and sum(max(1, lines[k].links) for k in own) > 1 for own in runs]
    out = [False] * len(lines)
    if any(several):
        ratios = np.array([sum(len(lines[k].text) for k in own) / max(1, sum(lines[k].tags for k in own)) for own in runs], float)
        content = content_lines(np.repeat(ratios, wide))[wide // 2 :: wide].tolist()
        for own, doubt, is_content in zip(runs, several, content):
            if doubt and not is_content and sum(len(lines[k].text) for k in own) < SHORT * len(own):
                for k in own:
                    out[k] = True
    return out


def named_parts(lines: list[Line], names: list[int]) -> list[bool]:
    """Of the elements in articles that only a name marks: those whose lines are short or mostly links."""
    size, linked, count = [0] * len(names), [0] * len(names), [0] * len(names)
    for x in lines:
        if x.named >= 0:
            size[x.named] += len(x.text)
            linked[x.named] += x.linked
            count[x.named] += 1
    for k in range(len(names) - 1, -1, -1):
        if names[k] >= 0:
            size[names[k]] += size[k]
            linked[names[k]] += linked[k]
            count[names[k]] += count[k]
    goes = [2 * ln >= n or n < SHORT * c for n, ln, c in zip(size, linked, count)]
    for k, outside in enumerate(names):
        goes[k] |= outside >= 0 and goes[outside]
    return goes


def extract(df: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the main text of ``html`` and its number of code points."""

    def make():
        def run(batch):
            found = [main_text(h.decode("utf-8", "replace")) for h in texts(batch, html)]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return run

    return with_columns(df, [StructField(text, StringType()), StructField(n_chars, LongType())], make, drop)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop=("html",))


QUERIES = {"op6_html_text": op6_html_text}
ORACLE_SQL: dict[str, str] = {}
