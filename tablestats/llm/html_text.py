"""Main text of web pages by tree scoring.

Each page is parsed into a tree. Parts that are never article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are cut out by tag, role, class or id. A class or id cuts containers
only, never headings, paragraphs or code, nor words out of a running sentence: where
it is made of such words alone (``share-buttons``), or, where it only has one among
others (``related-work``), if the container is mostly links or has a few words
without a heading or paragraph. A container that holds nearly all text around it
stays, unless it is of reader comments or notices. An <article> with a word of these goes too,
unless it holds nearly all text, lies in no other <article> and is the page's only kind of
article; a lower heading with nothing but reader comments after it in its container
goes with them. <header> is cut wherever it stands, inside an article as well, with the
headings it holds. Every block of running text then
passes points to the containers around it: one, one per comma, and one per 100 characters
up to three; all of it to the innermost, half to the next, and so on
(lists, quotes and tables are parts of a text, not containers). A
container's points are discounted by its link density. The best container is the
article, or the <article> or <main> around it with those siblings that score at least a
fifth of it or are paragraphs with few links. Without these two, whatever stands beside
the best container and is not mostly links is kept with it, of any tag and length, and
text directly in the container around as well; a container around it without other
text counts as the best one.

Inside the article every block is kept in page order: character references
decoded, white space turned into one space, trimmed; blocks are joined by one
line break. Nothing else is dropped or capped.

Edge cases: a null or empty page, and one without running text, gives an empty
text (its url is kept); broken markup (unclosed tags, cut references, stray
ends) is read the way browsers do in outline, but for two things: a quote that is never
closed ends with its tag, and a menu, header, footer or the like that is never closed ends where the
next larger container starts; ties between containers go to the
first; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablestats.llm.common import column, small_batches

# HTML's own element names (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr".split())
#: Elements whose content is never article text.
CUT_TAGS = frozenset("nav header footer aside form button select option dialog menu head fieldset".split()) | RAW
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class or id words of parts that are not article text.
CUT_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets footer foot header masthead topbar
    comment comments reply replies respond disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations toolbar""".split())
#: A class that says what a container has or lacks, not what it is.
ABOUT_WORDS = frozenset("has have with without no".split())
#: Words that say nothing more where they stand beside a cut word.
BESIDE_WORDS = frozenset("area list section wrapper wrap container box block inner body item items button buttons bar link links icon icons panel top bottom left right site main".split())
#: Reader comments and notices may hold more text than the article.
LONG_WORDS = frozenset("comment comments reply replies respond disqus notice notices cookie cookies consent gdpr popup modal".split())
#: Those of reader comments.
REPLY_WORDS = frozenset("comment comments reply replies respond disqus".split())
#: What reader comments are about.
TOLD_WORDS = frozenset("post article entry page user reader".split())
#: Never cut for their class.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())
#: A container with a cut word among others goes with fewer characters, or a larger share of links.
SHORT, LINKED = 100, 0.5
#: A container with more of the text around it than this stays.
BULK = 0.8
#: Whole-page containers, never cut for their class.
KEEP_TAGS = frozenset("html body main".split())
#: What ends a cut element that is never closed.
ENDS_CUT = frozenset("article main section div header footer aside".split())
LOWER_HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Parts of running text, lists, quotes and tables: never an article by themselves, their points go to the container around.
PARTS = frozenset("p li ul ol dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption address hr details summary".split())
#: An open element that a start tag ends (HTML's optional end tags; fixed values).
P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl div article section body main td th".split())

# Quotes open a value right after an equals sign only.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|"[^>]*+|'[^>]*+|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/][^\s=/]*+)(?:\s*+=\s*+(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'][^\s]*+)))?""")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style)\b", re.I)
_WORDS = re.compile(r"[A-Za-z]+|[^A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """A container; ``box``: itself or the nearest around it that is no part of running text; ``around``: the nearest article, main or page around it."""

    __slots__ = ("tag", "parent", "box", "around", "in_article", "cut", "doubt", "points", "chars", "link_chars", "told", "at", "end")

    def __init__(self, tag: str, parent: Node | None, cut: bool, at: int, doubt: int = 0):
        self.tag, self.parent, self.cut, self.doubt, self.at, self.end = tag, parent, cut, doubt, at, 0
        self.box = parent.box if parent and tag in PARTS else self
        self.around = parent and (parent if parent.parent is None or parent.tag in ("article", "main") else parent.around)
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        self.told = False
        self.points, self.chars, self.link_chars = 0.0, 0, 0


class Block:
    """Running text between two block borders."""

    __slots__ = ("node", "parts", "link_chars", "doubted", "at")

    def __init__(self, node: Node, at: int):
        self.node, self.parts, self.link_chars, self.at = node, [], 0, at
        self.doubted = 0  # parts inside inline elements with a cut word


#: What a class or id says: nothing, a cut word among others, cut words alone, notices, reader comments.
NONE, SOME, ALONE, LONG, REPLIES = range(5)


def _doubt(names: str) -> int:
    most = NONE
    for word in names.split():
        parts = set(re.split(r"[^a-z]+", word)) - {""}
        cut = parts & CUT_WORDS
        if not cut or parts & ABOUT_WORDS:
            continue
        beside = BESIDE_WORDS | TOLD_WORDS if cut & LONG_WORDS else BESIDE_WORDS
        most = max(most, SOME if parts - cut - beside else REPLIES if cut & REPLY_WORDS else LONG if cut & LONG_WORDS else ALONE)
    return most


def _attributes(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is cut, and what its class and id say."""
    if tag in CUT_TAGS:
        return True, NONE
    if not attrs or tag in KEEP_TAGS or not _NAMED.search(attrs):
        return False, NONE
    doubt = NONE
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            doubt = max(doubt, _doubt(value))
        elif name == "role" and value in CUT_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "hidden":
            return True, NONE
    return False, NONE if tag in TEXT_TAGS or tag == "article" and doubt < LONG else doubt


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Containers in page order and the blocks of text outside cut parts."""
    root = Node("html", None, False, 0)
    nodes, stack, blocks, block, links = [root], [root], [], None, 0
    doubts: list[str] = []  # open inline elements with a cut word
    opened = Counter({"html": 1})  # of each tag, those on the stack
    hidden, depth, level = "", 0, 0  # an open inline element that is not shown, how many of its tag are open, and where
    loose: Node | None = None  # an open cut element without an end tag
    ends: dict[str, int] = {}
    at, n = 0, 0

    def text(raw: str) -> None:
        nonlocal block, n
        if hidden or stack[-1].cut or not raw:
            return
        if block is None:
            if raw.isspace():
                return
            # Inline elements belong to the block around them.
            n += 1
            block = Block(stack[-1], n)
            blocks.append(block)
        block.parts.append(raw)
        if doubts or raw.isspace():
            block.doubted += 1
        if links:
            block.link_chars += len(raw)

    def pop() -> None:
        nonlocal n, hidden, loose
        n += 1
        node = stack.pop()
        node.end = n
        opened[node.tag] -= 1
        if node is loose:
            loose = None
        if len(stack) < level:
            hidden = ""

    def last_end(tag: str) -> int:
        """Where the page's last end tag of this name is."""
        if tag not in ends:
            ends[tag] = max(page.rfind(f"</{tag}"), page.rfind(f"</{tag.upper()}"))
        return ends[tag]

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag in INLINE:
                if hidden:
                    depth -= tag == hidden
                    hidden = hidden if depth else ""
                    continue
                if tag == "a":
                    links = max(0, links - 1)
                if tag in doubts:
                    del doubts[len(doubts) - 1 - doubts[::-1].index(tag):]
                continue
            block, doubts = None, []
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in ("body", "article", "main") and tag in ("p", "li"):
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in INLINE:
            if tag in VOID:
                continue
            if hidden:
                depth += tag == hidden
                continue
            cut, doubt = _attributes(tag, m[3])
            if cut:  # not shown, up to its end or that of the container around
                hidden, depth, level = tag, 1, len(stack)
                continue
            if tag == "a":
                links += 1
            if doubts and tag == doubts[-1] or doubt >= ALONE or doubt and tag == "a":
                doubts.append(tag)
            continue
        block, doubts = None, []
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "html" and opened[tag] > 1 or tag == "body" and opened[tag]:
            continue
        if tag in P_ENDS and stack[-1].tag == "p":
            pop()
        closes = CLOSES.get(tag, ())
        for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in closes) else ():
            if stack[i].tag in closes:
                while len(stack) > i:
                    pop()
            elif stack[i].tag in SCOPE:
                break
        if tag == "body":
            while stack[-1].tag == "head":
                pop()
        while loose is not None and tag in ENDS_CUT:
            pop()
        links = 0 if tag in ("p", "div", "article", "section", "main") else links
        n += 1
        cut, doubt = _attributes(tag, m[3])
        node = Node(tag, stack[-1], bool(stack[-1].cut or cut or hidden), n, doubt)
        if loose is None and tag in CUT_TAGS and last_end(tag) < at:
            loose = node
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    while stack:
        pop()
    return nodes, blocks


def _clean(block: Block) -> str:
    return _SPACE.sub(" ", html.unescape("".join(block.parts))).strip()


def settle(nodes: list[Node], blocks: list[Block], texts: list[str]) -> tuple[list[Block], list[str]]:
    """Cuts the containers whose class or id and text say so; the blocks that stay."""
    # A short block of nothing but inline elements with a cut word (a share link) goes.
    kept = [(b, t) for b, t in zip(blocks, texts) if not 0 < b.doubted == len(b.parts) or len(t) >= SHORT or any(x in TEXT_TAGS for x in _tags(b.node))]
    if any(x.doubt for x in nodes):
        _measure(nodes, kept)
        for x in reversed(nodes):
            x.told |= x.tag in TEXT_TAGS and x.chars > 0
            if x.parent is not None:
                x.parent.told |= x.told
        plain = any(x.tag == "article" and not x.doubt and x.chars for x in nodes)
        for x in nodes:
            if x.parent is None:
                continue
            x.cut |= x.parent.cut
            if x.doubt and not x.cut and x.chars:
                few = x.link_chars >= LINKED * x.chars or x.chars < SHORT and not x.told
                bulk = x.chars - x.link_chars > BULK * (x.around.chars - x.around.link_chars)
                if x.tag == "article":
                    x.cut = x.in_article or plain or not bulk
                else:
                    x.cut = x.doubt >= LONG or not bulk and (x.doubt == ALONE or few)
        kept = [(b, t) for b, t in kept if not b.node.cut]
        _measure(nodes, kept)
        kept = _without_headings_of_replies(nodes, kept)
    return [b for b, _ in kept], [t for _, t in kept]


def _measure(nodes: list[Node], kept: list[tuple[Block, str]]) -> None:
    """Characters, and those in links, of every container."""
    for x in nodes:
        x.chars = x.link_chars = 0
    for b, t in kept:
        b.node.chars += len(t)
        b.node.link_chars += min(b.link_chars, len(t))
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.link_chars += x.link_chars


def _without_headings_of_replies(nodes: list[Node], kept: list[tuple[Block, str]]) -> list[tuple[Block, str]]:
    """Blocks without lower headings that have nothing but cut reader comments after them in their container."""
    last = {id(b.node): b.at for b, _ in kept}  # a container's last text of its own
    after: dict[int, bool | None] = {}  # by container: reader comments after all that was looked at; None: other text
    gone = set()
    for x in reversed(nodes):
        if x.parent is None:
            continue
        key = id(x.parent)
        if x.cut:
            if x.doubt == REPLIES and after.get(key, False) is False:
                after[key] = True
        elif x.chars:
            if x.tag in LOWER_HEADINGS and after.get(key) and last.get(key, 0) < x.at:
                gone.add(id(x))
            after[key] = None
    return [(b, t) for b, t in kept if id(b.node) not in gone] if gone else kept


def _tags(node: Node | None) -> Iterator[str]:
    while node is not None and node.tag in PARTS:
        yield node.tag
        node = node.parent


#: A sibling of the article with a smaller share of links goes with it.
FEW_LINKS = 0.3
#: Containers that a block passes points to.
PASSES = 4


def article(nodes: list[Node], blocks: list[Block], texts: list[str]) -> list[Node | Block]:
    """The best container and what goes with it beside it."""
    _measure(nodes, list(zip(blocks, texts)))
    for b, t in zip(blocks, texts):
        if t:
            points, share, up = 1 + t.count(",") + t.count("、") + t.count("，") + min(len(t) / 100, 3), 1.0, b.node.parent or b.node
            for _ in range(PASSES):
                up = up.box
                up.points += points * share
                share /= 2
                if up.parent is None:
                    break
                up = up.parent
    best, top = None, 0.0
    for x in nodes:
        if not x.cut and x.chars and (s := _score(x)) > top:
            best, top = x, s
    if best is None:
        return []
    # An <article> or <main> around the best container is the whole article.
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    kept: list[Node | Block] = [best]
    if up is None:
        while best.tag not in ("html", "body") and best.parent is not None and best.parent.tag not in ("html", "body") and best.parent.chars == best.chars:
            best = best.parent
        if best.tag in ("html", "body"):
            return kept
        kept = [x for x in nodes if x is best or x.parent is best.parent and not x.cut and x.chars and x.link_chars < FEW_LINKS * x.chars]
        return kept + [b for b, t in zip(blocks, texts) if b.node is best.parent and t and b.link_chars < FEW_LINKS * len(t)]
    for x in nodes:
        if x is not best and x.parent is best.parent and not x.cut and x.chars and best.tag not in ("html", "body"):
            links = x.link_chars / x.chars
            if _score(x) >= max(2.0, 0.2 * top) and links < FEW_LINKS or x.tag in ("p", "h1", "h2", "h3") and links < 0.25:
                kept.append(x)
    return kept


def _score(x: Node) -> float:
    return x.points * (1 - min(1.0, x.link_chars / x.chars)) if x.chars else 0.0


def main_text(page: str) -> str:
    """The article of one page."""
    nodes, blocks = parse(page or "")
    blocks, texts = settle(nodes, blocks, [_clean(b) for b in blocks])
    spans = sorted((x.at, x.end if isinstance(x, Node) else x.at) for x in article(nodes, blocks, texts))
    starts = [s for s, _ in spans]
    # What is chosen lies side by side, so the last span that starts before a block is its only chance.
    return "\n".join(t for b, t in zip(blocks, texts) if t and (k := bisect_right(starts, b.at)) and b.at <= spans[k - 1][1])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    rows = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), column(pages, html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
