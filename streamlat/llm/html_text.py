"""Main text of web pages, by a minimum cut between content and boilerplate.

A page is read as a row of text blocks. Signs of a block (what it stands in, how much of it
is link, its length, its place, wording of notices) make the cost of either label, which become
its capacities to the two terminals. What no name or element tells apart is content unless the
page has a marked article elsewhere, so a page without any marks keeps its text. Neighbours in reading order and blocks of the same parent are joined by edges
that cost their weight if the labels differ. The minimum cut is the labelling of least
cost; blocks on the content side are the text.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlat.llm.support import text_slices

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
                 r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S)
NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of the language of pages: elements without content, elements whose content
# is no text of the page, and elements that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style template noscript iframe object svg math canvas audio video title "
             "textarea select datalist head".split())
RAW = set("script style title textarea iframe".split())  # run to the end of the page if never closed
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
             "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
             "menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
# What an opening element closes if it is open within the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"body", "html", "option", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd",
                   "summary", "legend"}

BAD_TAGS = set("nav footer aside form menu button dialog label".split())
GOOD_TAGS = set("article main".split())
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notification overlay pagination pager popup promo promoted "
    "promotion related recommend recommended replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
GOOD_NAMES = set("article content entry main post story text body prose".split())
# Words that also name sections of an article: together with further words, and within an article,
# they are a cost and no verdict.
DOUBTFUL_NAMES = set("discussion disclaimer navigation notice recommended related respond response search "
                     "share sharing social tags".split())

# Wording of what is no article, wherever it stands: who uses cookies and what is asked for; all of a
# block that only announces an advert; the end of a page.
COOKIES = re.compile(r"\b(?:we|sites?|website|partners) (?:and our partners )?(?:uses?|stores?|sets?)\b.{0,60}\bcookies\b", re.I)
ASKED = re.compile(r"\b(?:accept|agree|consent|preferences|settings|privacy|opt out|continu(?:e|ing)|experience)\b", re.I)
ADVERT = re.compile(r"(?:advertisement|advertising|sponsored|sponsored content|promoted)[.:]?", re.I)
RIGHTS = re.compile(r"(?:copyright )?(?:©|\(c\)) ?(?:copyright )?[12][0-9]{3}\b|.*\ball rights reserved\b", re.I)
ENDED = re.compile(r"[.!?…。！？।]")

# Costs, in hundredths.
IN_BAD, IN_GOOD, IN_DOUBT, LINKED, PLAIN = 900, 600, 400, 300, 100
WORDED = 1500  # more than an article and its length say for a block
NEXT, SIBLING = 120, 60


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    sign: int  # -1 in boilerplate, 1 in content, 0 unknown
    marked: bool = False  # within article or main
    doubt: bool = False  # within a doubtful name
    last: int | None = None  # its last block so far


@dataclass
class Block:
    text: str
    element: Element
    linked: float  # share of the characters that are in links
    sibling: int | None  # the block before it of the same parent


def below(tag: str, attributes: str, above: Element) -> Element:
    """An element in `above`: in boilerplate below any sign of it, else in content below a sign of that."""
    new = Element(tag, above, above.depth + 1, above.sign, above.marked, above.doubt)
    if above.sign < 0 or tag in ("html", "body"):
        return new
    if tag in BAD_TAGS or tag == "header" and above.sign == 0:
        new.sign = -1
        return new
    good = new.marked = tag in GOOD_TAGS
    new.marked |= above.marked
    if attributes:
        each = [{p.lower() for p in PARTS.findall(name)} for m in NAMES.finditer(attributes)
                for name in (m[1] or m[2] or m[3] or "").split()]
        names = set().union(*each)
        if names & BAD_NAMES and not (good and "comment" not in names and "comments" not in names):
            whole = any(n and n <= BAD_NAMES for n in each)
            if above.marked and not whole and names & BAD_NAMES <= DOUBTFUL_NAMES:
                new.doubt = True
            # comment-body and comment content are boilerplate, main-content has-sidebar is not.
            elif whole or not any(n & GOOD_NAMES and not n & BAD_NAMES for n in each):
                new.sign = -1
                return new
        good = good or bool(names & GOOD_NAMES)
    new.sign = max(above.sign, int(good))
    return new


class Reader:
    """Blocks of a page in their order."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open = Element("", None, 0, 0)
        self.parts: list[str] = []
        self.in_link, self.link_chars = 0, 0

    def read(self, page: str) -> list[Block]:
        at, unclosed = 0, set()
        while at < len(page):
            found = TAG.search(page, at)
            if found is None:
                self.text(page[at:])
                break
            self.text(page[at:found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self.end(tag)
                continue
            if tag in SILENT:
                self.border(tag)
                if found[3].rstrip().endswith("/"):
                    continue
                if tag in unclosed:
                    continue
                # Up to its end; one that never ends takes the rest if its content is raw text.
                close = re.compile(f"</{re.escape(tag)}\\b[^>]*>?" + ("|(?=<body\\b)" if tag == "head" else ""), re.I)
                end = close.search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    unclosed.add(tag)
                continue
            self.start(tag, found[3])
        self.flush()
        return self.blocks

    def text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self.parts.append(text)
            if self.in_link:
                self.link_chars += len("".join(text.split()))

    def border(self, tag: str) -> None:
        if tag in BLOCKS or tag in ("title", "head"):
            self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        linked, self.link_chars = self.link_chars, 0
        if not text:
            return
        element = self.open
        while element.parent is not None and element.tag not in BLOCKS:
            element = element.parent
        parent = element.parent or element
        self.blocks.append(Block(text, element, linked / max(1, len(text.replace(" ", ""))), parent.last))
        parent.last = len(self.blocks) - 1

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self.close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote"})
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        self.in_link += tag == "a"
        self.open = below(tag, attributes, self.open)

    def close(self, tags: set[str], within: set[str]) -> None:
        """Leave the innermost open element of `tags`, but none outside `within`."""
        element = self.open
        while element.parent is not None and element.tag not in tags:
            if element.tag in within:
                return
            element = element.parent
        if element.parent is not None:
            self.leave(element)

    def leave(self, element: Element) -> None:
        while self.open is not element.parent:
            self.in_link -= self.open.tag == "a"
            self.open = self.open.parent

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        element = self.open
        while element.parent is not None and element.tag != tag:
            # An inline element that ends does not end the block around it.
            if tag not in BLOCKS and element.tag in BLOCKS:
                return
            element = element.parent
        if element.parent is not None:
            self.leave(element)


def worded(block: Block) -> bool:
    """Whether the wording is that of a cookie notice, the label of an advert or a copyright line.

    The paragraphs of a marked article are its own whatever they say; a box within it may be a notice or an advert.
    """
    text, element = block.text, block.element
    if element.marked and not boxed(element):
        return False
    if "ookies" in text and COOKIES.search(text) and ASKED.search(text):
        return True
    return (len(text) < 30 and bool(ADVERT.fullmatch(text))
            or len(text) < 160 and not element.marked and bool(RIGHTS.match(text)))


def boxed(element: Element) -> bool:
    """Whether an element of a marked article is in a box of its own."""
    while element.tag not in GOOD_TAGS:
        if element.tag in ("div", "section"):
            return True
        element = element.parent
    return False


def has_anchor(blocks: list[Block]) -> bool:
    """Whether the page marks its article: by an element, or by names around most of its plain text."""
    named = unknown = 0
    for b in blocks:
        if b.element.sign > 0:
            if b.element.marked:
                return True
            named += len(b.text)
        elif b.element.sign == 0 and b.linked <= 0.5:
            unknown += len(b.text)
    return named > unknown


def evidence(blocks: list[Block]) -> list[int]:
    """Of each block: for content if positive, for boilerplate if negative."""
    anchored = has_anchor(blocks)
    # Above the first heading of an unmarked page stand its name and menus.
    top = next((i for i, b in enumerate(blocks) if b.element.tag == "h1" and b.element.sign >= 0), 0)
    out = []
    for i, b in enumerate(blocks):
        sign = b.element.sign
        value = min(3, len(b.text) // 80) * PLAIN - WORDED * worded(b)
        if sign > 0:
            value += IN_GOOD - PLAIN - b.element.doubt * (IN_DOUBT + LINKED * (b.linked > 0.5))
        else:
            value += -IN_BAD - PLAIN if sign < 0 else -PLAIN if anchored else PLAIN
            value -= LINKED * (b.linked > 0.5)
            if not anchored and i < top and not ENDED.search(b.text):
                value -= LINKED
        out.append(value)
    return out


def distance(a: Element, b: Element) -> int:
    """Steps from one element to the other in the tree, at most 20."""
    steps = 0
    while a is not b and steps < 20:
        steps += 1
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    edges = []
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1].element, blocks[i].element
        edges.append((i - 1, i, NEXT // max(1, distance(a, b) // 2)))
        if (s := blocks[i].sibling) is not None and s != i - 1:
            edges.append((s, i, SIBLING))
    return edges


def least_cut(values: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the content side. `values` are capacities to the terminals."""
    near: list[dict[int, int]] = [{} for _ in values]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    values, label = list(values), [None] * len(values)
    # A node whose own evidence is above all its edges has that label in every minimum cut;
    # its edges then count with the evidence of its neighbours.
    waiting = deque(range(len(values)))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(values[i]) > sum(near[i].values()):
            label[i] = values[i] > 0
            for j, w in near[i].items():
                values[j] += w if label[i] else -w
                del near[j][i]
                waiting.append(j)
            near[i] = {}
    rest = [i for i, known in enumerate(label) if known is None]
    if rest:
        side = _max_flow(rest, values, near)
        for i in rest:
            label[i] = i in side
    return label


def _max_flow(nodes: list[int], values: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow along shortest paths, in phases."""
    source, sink = -1, -2
    left = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if values[i] > 0:
            left[source][i], left[i][source] = values[i], 0
        elif values[i] < 0:
            left[i][sink], left[sink][i] = -values[i], 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, room in left[a].items():
                if room > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return set(level) - {source}
        after = {i: iter(list(left[i])) for i in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                steps = list(zip(path, path[1:]))
                push = min(left[x][y] for x, y in steps)
                for x, y in steps:
                    left[x][y] -= push
                    left[y][x] = left[y].get(x, 0) + push
                # Go on from the first edge that is full.
                full = next(k for k, (x, y) in enumerate(steps) if left[x][y] == 0)
                del path[full + 1:]
                continue
            for b in after[a]:
                if left[a][b] > 0 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()


def labelled_blocks(page: str) -> list[tuple[str, bool]]:
    """Text of each block, and whether it is content."""
    blocks = Reader().read(page)
    return list(zip((b.text for b in blocks), least_cut(evidence(blocks), edges_of(blocks))))


def main_text(page: str) -> str:
    return "\n".join(text for text, content in labelled_blocks(page) if content)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`.

    A missing or empty page, or one without content, has an empty text. Repeated rows come out
    each time; other columns are not read. A page is one row of one task, however long.
    """
    def run(batches):
        for batch in batches:
            for rows, found in text_slices(iter([batch]), "html"):
                texts = [main_text(p) for p in found]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
