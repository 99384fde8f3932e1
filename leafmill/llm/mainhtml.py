"""Main text of a page from the standard library's parser events: text-to-tag ratios, smoothed and clustered.

The page streams through html.parser. Each block (the text between two block-level tags) becomes a line with its characters,
the characters of them in links, and the number of tags met in it. A line's ratio of text to tags, r / (r + HALF), is weighted
by what stands around it: CHROME for lines of an element that names itself a menu, header, footer, sidebar, notice, advert,
form or comments by tag, role or class, ASIDE for lines outside the page's <article> and <main> elements where it has any, 1
for all others. The weighted ratios are smoothed with a Gaussian along the page, among lines of the same weight and the same
such element, and cut into two clusters by a threshold. Lines of the high cluster are content, whatever they are in.

The content lines select regions: the marked elements (<article>, <main>, role=main) that hold content, without any the
smallest container of all content characters. Lines of the low cluster are main text as well if they lie in a region and aren't of an
element that names itself otherwise: short paragraphs and headings around content. Lines of links are, too, in a marked element,
unless ratio and place make them a menu there (navigation()). Without a marked element such lines must lie between content
lines, in the core (the deepest container with REGION_SHARE of the content characters), or beside content in a container, and
lines of links stay as headings, or between two content lines of their container. An <article> that names itself a comment is
one.

No name is a veto on what is around content: an element that holds a marked one keeps its full weight, and on a page without
marked elements so does one that holds most content characters by ratio alone (DOUBT_CHARS at least; comments never). A
name is a class or id whose words are all of WORDS and HELPERS, so no-sidebar or social-history isn't one; ids of sections,
headings and paragraphs are anchors, and names for comments only. A page with no other lines than those of named elements is judged without names.

Character references are decoded, white space inside a block becomes one space, blocks are joined by two line feeds in page
order; nothing is cut. Null, empty or text-free html gives an empty text, and so do pages of menus, footers and forms alone.
The parser accepts any byte soup; unclosed and stray tags don't fail. Repeated rows give equal results; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import arrow_map, texts

SIGMA = 1.0
#: characters a tag at which a line's ratio counts a half
HALF = 40.0
#: weights of lines in elements that name themselves something else, and of lines outside marked elements
CHROME, ASIDE = 0.01, 0.05
REGION_SHARE = 0.6
#: a doubtful element of fewer characters is never most of a page: a notice on a page of a few words
DOUBT_CHARS = 140

# Element names of the HTML standard, by their part in this operator.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NOT_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button datalist".split())
#: what they hold is no main text by their meaning, unless they are around the article
OTHER = frozenset("nav footer aside form label dialog menu search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: their ids are anchors of an article's parts
ANCHORED = HEADINGS | {"section", "p"}
CONTAINER = frozenset("article main section div td body".split())
CLOSES_P = BLOCK - {"html", "body"}
#: start tag -> open elements that it ends, searched for up to the nearest list or table
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article main section div body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
WORDS = COMMENTS | frozenset(
    "nav navbar navigation menu submenu sidebar footer masthead ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager widget widgets toolbar skip hidden".split()
)
#: words that a name of one of WORDS may have besides
HELPERS = frozenset(
    "area bar block box body bottom button buttons col column container content form header heading icons inner item items left link links list main media outer panel post posts article articles "
    "page primary right secondary section site slot stories story text title to top unit wrap wrapper".split()
)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Line(NamedTuple):
    text: str
    tags: int
    path: tuple[int, ...]  # containers around it
    named: tuple[int, ...] = ()  # elements around it that name themselves something else
    links: int = 0  # its characters in links
    heading: bool = False


def hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(n == "hidden" or n == "aria-hidden" and v == "true" for n, v in attrs)


def name_of(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> str:
    """"tag" if tag or role say that the element is no main text, "comments" or "name" if a class or id does, else ""."""
    if tag in OTHER or tag == "header" and not in_article:
        return "tag"
    found = ""
    for n, v in attrs:
        if not v:
            continue
        if n == "role" and v.strip().lower() in ROLES:
            return "tag"
        if n in ("class", "id"):
            known = COMMENTS if n == "id" and tag in ANCHORED else WORDS
            for name in v.split():
                words = {w.lower() for w in _SPLIT.split(name) if w}
                if not known.isdisjoint(words) and words <= WORDS | HELPERS:
                    found = "comments" if found == "comments" or not COMMENTS.isdisjoint(words) else "name"
    return found


class Block(NamedTuple):
    """The text between two block-level tags, in pieces (text, named elements around it, in a link)."""

    pieces: list[tuple[str, tuple[int, ...], bool]]
    tags: int
    path: tuple[int, ...]
    heading: bool


class Lines(HTMLParser):
    """Parser events to blocks, and those to lines; text that is never shown makes none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, tuple[int, ...], tuple[int, ...]]] = []  # tag, not shown, containers and named elements around what is in it
        self.names: list[str] = []  # kind of each named element
        self.marked: dict[int, tuple[str, tuple[int, ...]]] = {}  # containers that are <article>, <main> or role=main: tag and named elements around
        self.containers = self.tags = 0
        self.pieces: list[tuple[str, tuple[int, ...], bool]] = []

    @property
    def out(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    @property
    def path(self) -> tuple[int, ...]:
        return self.open[-1][2] if self.open else ()

    @property
    def named(self) -> tuple[int, ...]:
        return self.open[-1][3] if self.open else ()

    def flush(self) -> None:
        if self.pieces:
            self.blocks.append(Block(self.pieces, self.tags, self.path, any(t in HEADINGS for t, *_ in self.open)))
            self.pieces = []
        self.tags = 0

    def add(self, data: str) -> None:
        self.pieces.append((data, self.named, any(t == "a" for t, *_ in reversed(self.open))))

    def lines(self, aside: set[int] | None = None) -> list[Line]:
        """A line for each block, and one of its own for what inline elements of `aside` (all, without it) hold in it."""
        out = []
        for pieces, tags, path, heading in self.blocks:
            parts: dict[tuple[int, ...], list[tuple[str, bool]]] = {}
            for data, named, link in pieces:
                parts.setdefault(named if aside is None else tuple(d for d in named if d in aside), []).append((data, link))
            for named, own in parts.items():
                if text := " ".join("".join([d for d, _ in own]).split()):
                    out.append(Line(text, tags, path, named, sum(len(d.strip()) for d, link in own if link), heading))
        return out

    def end_open(self, at: int) -> None:
        self.flush()
        del self.open[at:]

    def end_nearest(self, tags: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in tags:
                self.end_open(at)
                return
            if self.open[at][0] in FENCES:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self.end_nearest({"p"})
            if tag in ENDS:
                self.end_nearest(ENDS[tag])
        path, named, shut = self.path, self.named, self.out
        in_article = any(p in self.marked for p in path)
        kind = "" if tag in ("html", "body", "main") or tag in VOID else name_of(tag, attrs, in_article)
        kind = "" if tag == "article" and kind != "comments" else kind
        shut = shut or tag in NOT_TEXT or tag not in ("html", "body", "article", "main") and hidden(attrs)
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not shut:
                self.add("\n")
            return
        if kind and not shut:
            named = (*named, len(self.names))
            self.names.append(kind)
        if tag in CONTAINER:
            self.containers += 1
            path = (*path, self.containers)
            if not shut and kind != "comments" and (tag in ("article", "main") or any(n == "role" and v == "main" for n, v in attrs)):
                self.marked[self.containers] = (tag, named)
        self.open.append((tag, shut, path, named))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in NOT_TEXT:
            if tag == "br" and not self.out:
                self.add("\n")
            self.tags += 1
        else:  # <p/> and the like open an element in HTML
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if tag in BLOCK or self.open[at][1] != (at > 0 and self.open[at - 1][1]):
                    self.end_open(at)
                elif all(t not in BLOCK for t, *_ in self.open[at:]):  # an inline end tag: a block that is open inside it stays open
                    del self.open[at:]
                return
            if self.open[at][0] in ("td", "th", "article", "main") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "main", "body", "html", "section", "div"):
                return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.add(data)

    def finished(self) -> Lines:
        self.close()
        self.flush()
        return self


def ratio(line: Line) -> float:
    r = len(line.text) / max(1, line.tags)
    return r / (r + HALF)


def smoothed(ratios: list[float], groups: list, sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing along the page among lines of a group; where others stand the weights that are there count as all."""
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(reach + 1)]
    n, out = len(ratios), []
    for i in range(n):
        whole = held = 0.0
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            if groups[j] == groups[i]:
                w = weights[abs(i - j)]
                whole += w
                held += w * ratios[j]
        out.append(held / whole)
    return out


def high_cluster(values: list[float]) -> list[bool]:
    """Two clusters around a threshold: the mean of the two cluster means, repeated until it rests."""
    cut = sum(values) / len(values)
    for _ in range(20):
        high, low = [v for v in values if v >= cut], [v for v in values if v < cut]
        if not low:
            break
        new = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return [v >= cut for v in values]


def set_aside(page: Lines) -> tuple[set[int], set[int]]:
    """The named elements that count as what they name themselves, and the marked containers."""
    lines = page.lines()
    marked = {c: at for c, at in page.marked.items() if at[0] == "main" or not any(page.names[d] == "comments" for d in at[1])}
    with_text = {c for line in lines for c in line.path if c in marked}
    holding = {d for c in with_text for d in marked[c][1]}
    if not with_text:  # ratio alone says which elements hold most of the page
        content = high_cluster(smoothed([ratio(x) for x in lines], [0] * len(lines)))
        chars, total = [0] * len(page.names), 0
        for line, high in zip(lines, content, strict=True):
            if high:
                total += len(line.text)
                for d in line.named:
                    chars[d] += len(line.text)
        holding = {d for d, n in enumerate(chars) if n >= DOUBT_CHARS and 2 * n > total and page.names[d] == "name"}
    aside = set(range(len(page.names))) - holding
    if all(not aside.isdisjoint(line.named) for line in lines):  # nothing else: only tags and roles count
        aside = {d for d in aside if page.names[d] == "tag"}
    return aside, with_text


def linked(line: Line) -> bool:
    """Most of its characters are in links."""
    return 2 * line.links > len(line.text)


def navigation(lines: list[Line], content: list[bool], inside: list[bool]) -> list[bool]:
    """Which lines inside marked elements are menus by ratio and place: two or more low lines of links in a row without a heading
    before them, if they stand before all content there, or after it and have one word each or a container to themselves. Other
    lines of links, as a closing paragraph or a list of sources, are text."""
    out = [False] * len(lines)
    held = [i for i, (high, x) in enumerate(zip(content, inside, strict=True)) if high and x]
    places = {lines[i].path[-1:] for i in held}
    of_links = [x and not high and linked(line) and not line.heading for line, high, x in zip(lines, content, inside, strict=True)]
    i = 0
    while held and i < len(lines):
        j = i
        while j < len(lines) and of_links[j]:
            j += 1
        if j - i > 1 and not (i and inside[i - 1] and lines[i - 1].heading):
            apart = all(line.path[-1:] not in places for line in lines[i:j])
            menu = i < held[0] or i > held[-1] and (apart or all(" " not in line.text for line in lines[i:j]))
            out[i:j] = [menu] * (j - i)
        i = max(j, i + 1)
    return out


def article_lines(page: Lines) -> list[str]:
    """The texts of the lines that are the article."""
    if not page.lines():
        return []
    aside, marked = set_aside(page)
    lines = page.lines(aside)
    if all(line.named for line in lines):
        return []
    groups = [x.named[0] + 1 if x.named else (0 if not marked or not marked.isdisjoint(x.path) else -1) for x in lines]
    weight = lambda g: CHROME if g > 0 else ASIDE if g < 0 else 1.0
    content = high_cluster(smoothed([ratio(x) * weight(g) for x, g in zip(lines, groups, strict=True)], groups))
    held: dict[int, int] = {}  # content characters of each container
    beside: set[int] = set()  # containers with content of their own
    total = 0
    for line, high in zip(lines, content, strict=True):
        if high:
            total += len(line.text)
            beside.update(line.path[-1:])
            for p in line.path:
                held[p] = held.get(p, 0) + len(line.text)
    if not total:
        return []
    regions = marked & held.keys()
    whole = max((p for p, n in held.items() if n == total), default=None)
    core = max((p for p, n in held.items() if n >= REGION_SHARE * total), default=None)

    def in_region(path: tuple[int, ...], between: bool) -> bool:
        if regions:
            return not regions.isdisjoint(path)
        return (whole is None or whole in path) and (between or core is None or core in path or not path or path[-1] in beside)

    before, after = [None] * len(lines), [None] * len(lines)  # the container of the nearest content line before and after
    last = None
    for i, (line, high) in enumerate(zip(lines, content, strict=True)):
        before[i] = last
        last = line.path if high else last
    last = None
    for i in range(len(lines) - 1, -1, -1):
        after[i] = last
        last = lines[i].path if content[i] else last
    menus = navigation(lines, content, [g <= 0 and not regions.isdisjoint(x.path) for x, g in zip(lines, groups, strict=True)])
    return [
        line.text
        for line, high, g, a, b, menu in zip(lines, content, groups, before, after, menus, strict=True)
        if high or g <= 0 and in_region(line.path, None not in (a, b)) and (line.heading or not linked(line) or (not menu if regions else a == line.path == b))
    ]


def main_text(html: str) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finished()
    return "\n\n".join(article_lines(page))


def extract_pages(pages: DataFrame) -> DataFrame:
    def each(batch: pa.RecordBatch) -> dict:
        found = [main_text(h) for h in texts(batch, "html")]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())}

    return arrow_map(pages.selectExpr("cast(page_id as long) as page_id", "url", "html"), "page_id long, url string, text string, n_chars long", each)
