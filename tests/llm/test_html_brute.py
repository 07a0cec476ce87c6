"""Page texts against a plain version: Python's own parser, a real tree, every sum taken anew where it is needed."""

import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tablestats.llm import html_text as H


class Element:
    def __init__(self, tag, attrs, parent):
        self.tag, self.parent, self.kids = tag, parent, []
        self.own, self.doubt = H._attributes(tag, " ".join(f'{k}="{v}"' if v is not None else k for k, v in attrs))
        self.cut = self.own

    def around(self):
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def walk(self):
        yield self
        for k in self.kids:
            if isinstance(k, Element):
                yield from k.walk()


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("html", [], None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(x.tag == tag for x in [self.at, *self.at.around()]) and not (tag == "html" and self.at is self.root and not self.root.kids):
            return
        if tag == "br":
            self.at.kids.append(" ")
        if tag in H.VOID:
            if tag not in H.INLINE:
                self.at.kids.append(Element(tag, [], self.at))  # a border between blocks
            return
        while self.at.tag in H.INLINE and tag not in H.INLINE and self.at.parent is not None:
            self.at = self.at.parent
        if tag in H.P_ENDS and self.at.tag == "p":
            self.at = self.at.parent
        if tag in H.CLOSES:
            for x in [self.at, *self.at.around()]:
                if x.tag in H.CLOSES[tag]:
                    self.at = x.parent
                    break
                if x.tag in H.SCOPE:
                    break
        e = Element(tag, attrs, self.at)
        self.at.kids.append(e)
        self.at = e

    def handle_endtag(self, tag):
        for x in [self.at, *self.at.around()]:
            if x.tag == tag and x.parent is not None:
                self.at = x.parent
                return

    def handle_data(self, data):
        self.at.kids.append(data)


def blocks_of(root):
    """[container, text, characters in links, parts, parts of doubtful inline elements] in page order."""
    out, now = [], None

    def visit(e, box, links, doubtful, hidden):
        nonlocal now
        inline = e.tag in H.INLINE
        if not inline:
            box, now, links, doubtful = e, None, links and e.tag not in ("p", "div", "article", "section", "main"), False
        else:
            hidden = hidden or e.own
            links = links or e.tag == "a"
            doubtful = doubtful or e.doubt >= H.ALONE or e.doubt and e.tag == "a"
        for k in e.kids:
            if isinstance(k, Element):
                visit(k, box, links, doubtful, hidden)
            elif not hidden and not any(x.own for x in [box, *box.around()]) and k:
                if now is None:
                    if k.isspace():
                        continue
                    now = [box, "", 0, 0, 0]
                    out.append(now)
                now[1] += k
                now[2] += len(k) * bool(links)
                now[3] += 1
                now[4] += bool(doubtful or k.isspace())
        if not inline:
            now = None

    visit(root, root, False, False, False)
    for b in out:
        b[1] = re.sub(r"\s+", " ", b[1]).strip()
    return out


def slow_text(page):
    tree = Tree()
    tree.feed(page or "")
    tree.close()
    blocks = blocks_of(tree.root)
    nodes = [e for e in tree.root.walk() if e.tag not in H.INLINE]
    blocks = [b for b in blocks if not 0 < b[4] == b[3] or len(b[1]) >= H.SHORT or any(x.tag in H.TEXT_TAGS for x in parts_up(b[0]))]

    def inside(e, x):
        return x is e or e in x.around()

    def chars(e):
        own = [b for b in blocks if inside(e, b[0])]
        return sum(len(b[1]) for b in own), sum(min(b[2], len(b[1])) for b in own)

    sizes = {id(e): chars(e) for e in nodes}
    told = {id(e): any(x.tag in H.TEXT_TAGS and sizes[id(x)][0] for x in e.walk() if x.tag not in H.INLINE) for e in nodes}
    plain = any(e.tag == "article" and not e.doubt and sizes[id(e)][0] for e in nodes)
    for e in nodes:
        if e.parent is None:
            continue
        e.cut = e.own or e.parent.cut
        n, linked = sizes[id(e)]
        if e.doubt and not e.cut and n:
            large = next(x for x in e.around() if x.parent is None or x.tag in ("article", "main"))
            bulk = n - linked > H.BULK * (sizes[id(large)][0] - sizes[id(large)][1])
            few = linked >= H.LINKED * n or n < H.SHORT and not told[id(e)]
            if e.tag == "article":
                e.cut = any(x.tag == "article" for x in e.around()) or plain or not bulk
            else:
                e.cut = e.doubt >= H.LONG or not bulk and (e.doubt == H.ALONE or few)
    blocks = [b for b in blocks if not b[0].cut]
    if any(e.doubt for e in nodes):
        for e in list(nodes):
            if e.tag in H.LOWER_HEADINGS and e.parent is not None and not e.cut and chars(e)[0]:
                rest = e.parent.kids[e.parent.kids.index(e) + 1:]
                after = [k for k in rest if isinstance(k, Element) and k.tag not in H.INLINE]
                bare = any(b[0] is e.parent and any(inline_text(k) and inline_text(k) in b[1] for k in rest if not isinstance(k, Element) or k.tag in H.INLINE) for b in blocks)
                if not bare and any(k.cut and k.doubt == H.REPLIES for k in after) and all(k.cut or not chars(k)[0] for k in after):
                    blocks = [b for b in blocks if b[0] is not e]
    points = {}
    for box, t, _, _, _ in blocks:
        if t:
            up, share = box.parent or box, 1.0
            for _ in range(H.PASSES):
                while up.tag in H.PARTS and up.parent is not None:
                    up = up.parent
                points[id(up)] = points.get(id(up), 0) + share * (1 + t.count(",") + t.count("、") + t.count("，") + min(len(t) / 100, 3))
                share /= 2
                if up.parent is None:
                    break
                up = up.parent
    sizes = {id(e): chars(e) for e in nodes}

    def score(e):
        n, linked = sizes[id(e)]
        return points.get(id(e), 0) * (1 - min(1, linked / n)) if n else 0

    best = max((e for e in nodes if not e.cut), key=score, default=None)
    if best is None or score(best) <= 0:
        return ""
    top, whole = score(best), next((x for x in [best, *best.around()] if x.tag in ("article", "main")), None)
    if whole is not None:
        best = whole
        kept = [best] + [e for e in nodes if e is not best and e.parent is best.parent and not e.cut and sizes[id(e)][0]
                         and (score(e) >= max(2.0, 0.2 * top) and sizes[id(e)][1] / sizes[id(e)][0] < H.FEW_LINKS
                              or e.tag in ("p", "h1", "h2", "h3") and sizes[id(e)][1] / sizes[id(e)][0] < 0.25)]
        bare = []
    else:
        while best.tag not in ("html", "body") and best.parent.tag not in ("html", "body") and sizes[id(best.parent)][0] == sizes[id(best)][0]:
            best = best.parent
        if best.tag in ("html", "body"):
            kept, bare = [best], []
        else:
            kept = [e for e in nodes if e is best or e.parent is best.parent and not e.cut and sizes[id(e)][0] and sizes[id(e)][1] < H.FEW_LINKS * sizes[id(e)][0]]
            bare = [b for b in blocks if b[0] is best.parent and b[1] and b[2] < H.FEW_LINKS * len(b[1])]
    return "\n".join(b[1] for b in blocks if b[1] and (any(b is x for x in bare) or any(inside(e, b[0]) for e in kept)))


def parts_up(e):
    while e is not None and e.tag in H.PARTS:
        yield e
        e = e.parent


def inline_text(k):
    return k.strip() if isinstance(k, str) else " ".join(inline_text(x) for x in k.kids).strip()


WORDS = "alpha beta, gamma delta; epsilon, zeta eta theta iota kappa lambda".split()
CLASSES = ["", "", "", "", "story", "comments", "comment", "share-buttons", "related-work", "sidebar", "promo-inline", "notice", "has-ads", "widget", "post comments-open"]


def random_page(rng):
    def text(n):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, n)))

    def inline(depth=0):
        t = text(30)
        if rng.random() < 0.3:
            tag = rng.choice(["b", "span", "a", "em"])
            extra = f' class="{rng.choice(CLASSES)}"' if rng.random() < 0.3 else " hidden" if rng.random() < 0.1 and tag == "span" else ""
            t += f" <{tag}{extra}>{inline(depth + 1) if depth < 2 else text(4)}</{tag}> {text(5)}"
        return t

    def block(depth):
        attrs = f' class="{rng.choice(CLASSES)}"' if rng.random() < 0.4 else f' id="{rng.choice(CLASSES)}"' if rng.random() < 0.1 else ""
        kind = rng.random()
        if depth > 3 or kind < 0.45:
            tag = rng.choice(["p", "p", "p", "h2", "h3", "blockquote", "pre"])
            return f"<{tag}{attrs}>{inline()}</{tag}>"
        if kind < 0.55:
            return f"<ul{attrs}>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind < 0.6:
            return f"<ul>" + "".join(f"<li><a href=x>{text(3)}</a></li>" for _ in range(5)) + "</ul>"
        tag = rng.choice(["div", "div", "section", "article", "nav", "aside", "footer", "main" if depth == 0 else "div"])
        bare = inline() if rng.random() < 0.2 else ""
        return f"<{tag}{attrs}>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 4))) + bare + f"</{tag}>"

    return "<html><body>" + "".join(block(0) for _ in range(rng.randint(1, 5))) + "</body></html>"


@pytest.mark.parametrize("seed", range(12))
def test_random_pages(seed):
    rng = random.Random(seed)
    for _ in range(60):
        page = random_page(rng)
        assert H.main_text(page) == slow_text(page), page


def test_pages_of_the_tables():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert [H.main_text(p) for p in pages] == [slow_text(p) for p in pages]
