"""HTML extraction by composite text density.

A page becomes a tree of its block elements. A node's density is its link-adjusted characters per tag:
C / T * log(C / LC * T / LT) to the base ln(C / nonlink * LC + LCb / Cb * C + e), with C and T the characters
and tags below it, LC and LT those of links, and LCb / Cb the body's link share. The node whose children's
densities have the largest sum is the content; the smallest density on its path to the body is the threshold.
From the body down, every node that reaches the threshold gives the node of the largest sum below it as content,
and its children are looked at in turn; beside the first content only prose that isn't mostly links counts. An
article element that holds content is content as a whole, with the articles beside it that aren't mostly links, and
so is a main element without articles; the headings just before the content, on its way to the body, belong to it.

What is never content goes before densities are taken: scripts and styles; nav, aside, footer and the like;
hidden elements. Elements that are marked go with reservations. An element is marked if it is a form or if a class,
an id or a role consists of words that say menu, advert, notice, comments and so on, with words of place and form
("left-sidebar", "comment-list"). It goes unless it wraps the content: the main element, an article when no other
stands free of such elements, or nearly all text of a page without either. An element of whose class only a part
says so ("amazon-ad-x") goes if its density is below the threshold, and a list of tags, topics or links if it is
mostly links; words that speak of a state ("no-sidebar", "comments-open", "content-sidebar-wrap") mean nothing.
A header goes unless it has a heading and stands in an article or main element or right above paragraphs.

Text: character references are decoded, white space inside a block becomes one space, a line break is white
space, blocks are joined by two line breaks. Nothing else is dropped.

Cases: a null or empty page, and one without content, gives an empty text. Unclosed and misplaced tags are
taken as a browser would, near enough: a block closes an open paragraph and what is open inside it, an inline
element goes on through the blocks in it, an end tag without its start is ignored, what is open at the end is
closed. Rows with the same page_id are extracted one by one, nulls in page_id and url pass through, extra columns
are ignored. A page is taken whole, whatever its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Comments, declarations and tags; an attribute's quotes end within 64 Ki characters, or they are no quotes.
TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside a block, and those of them that end wherever their end tag stands.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
#: Elements that are never content.
DROPPED = frozenset(
    "head script style title noscript template iframe object embed svg canvas video audio nav aside footer button select textarea input option fieldset dialog menu noembed noframes xmp".split()
)
WHOLE = ("#root", "html", "body", "article", "main")  # a page's own class says nothing about all of it
HEADINGS = ("h1", "h2", "h3")
#: Words of a class, an id or a role that mark an element as no content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments disqus respond replies pagination pager widget toolbar complementary contentinfo".split()
)
#: Words of place and form: beside marking words they change nothing.
PLACES = frozenset(
    "left right top bottom upper lower inner outer first last primary secondary global site page main my the box block bar area list item items container wrapper section group row col column unit slot "
    "space zone placement leaderboard skyscraper rectangle mobile desktop sticky fixed inline header title body text message panel form field button buttons link links icons thread reader user users reply post posts".split()
)
#: Words that speak of a state or of the content: with them a class marks nothing.
STATES = frozenset("no not non without with has have is open closed free enabled disabled allowed content layout article story entry home full width wrap on off count".split())
#: Lists that go where they are mostly links.
LISTS = frozenset("tag tags tagcloud topics categories keywords links toc".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
MARKED, DOUBTFUL, LIST = 1, 2, 4


class Node:
    __slots__ = ("children", "dropped", "mark", "link", "name", "parent", "texts", "inner_tags", "link_tags", "c", "lc", "t", "lt", "density", "total", "top", "prose", "mains", "articles", "heading")

    def __init__(self, name: str, parent: Node | None, dropped: bool, mark: int = 0):
        self.name, self.parent, self.dropped, self.mark = name, parent, dropped, mark
        self.children: list[Node] = []
        #: Text, and child nodes at their place.
        self.texts: list[str | Node] = []
        self.inner_tags = self.link_tags = 0
        self.link = 0

    def own(self) -> int:
        return sum(len(" ".join(x.split())) for x in self.texts if isinstance(x, str))


def _token(token: str) -> int:
    """What one token of a class, an id or a role says."""
    words = [w.lower() for w in WORD.findall(token)]
    marks = [w for w in words if w in MARKS]
    if any(w in STATES for w in words):
        return 0
    if marks:
        return MARKED if all(w in MARKS or w in PLACES for w in words) else DOUBTFUL
    return LIST if words and any(w in LISTS for w in words) and all(w in LISTS or w in PLACES for w in words) else 0


def _judged(name: str, rest: str) -> tuple[bool, int]:
    """Whether an element is never content, and how its class, id or role marks it."""
    if name in DROPPED:
        return True, 0
    mark = MARKED if name == "form" else 0
    if "=" in rest or "hidden" in rest:
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if key in ("class", "id", "role"):
                for token in value.split():
                    mark |= _token(token)
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, mark
            elif key == "aria-hidden" and value.lower() == "true":
                return True, mark
        return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub(" ", rest))), mark
    return False, mark


def parse(page: str) -> Node:
    """The tree of block elements; text of dropped elements is left out."""
    root = node = Node("#root", None, False)
    at = dropped = links = 0
    #: Open inline elements: name, the block that they were opened in, whether dropped, whether a link.
    inline: list[tuple[str, Node, bool, bool]] = []
    #: How many blocks and inline elements of a name are open: an end tag without a start isn't looked for.
    open_names: Counter[str] = Counter()
    last = page.rfind(">") + 1  # behind it no tag ends

    def text(s: str) -> None:
        if s and not dropped:
            node.texts.append(s)
            if links:
                node.link += len(s.strip())

    def shut(k: int) -> None:
        nonlocal dropped, links
        name, _, gone, link = inline.pop(k)
        open_names[name] -= 1
        dropped -= gone
        links -= link

    def close(to: Node) -> None:
        nonlocal node, dropped
        while node is not to:
            dropped -= node.dropped
            while inline and inline[-1][1] is node:
                shut(-1)
            open_names[node.name] -= 1
            node = node.parent

    while m := TAG.search(page, at, last):
        if m.start() > at:
            text(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        name, is_end, rest = name.lower(), m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if is_end:
            if not open_names[name]:
                pass
            elif name in INLINE:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][1] is not node and name not in FORMATTING:
                        break  # a block stands between them
                    if inline[k][0] == name:
                        shut(k)
                        break
            else:
                to = node
                while to is not root and to.name != name:
                    to = to.parent
                if to is not root:
                    close(to.parent)
            continue
        if name in INLINE:
            if name == "br":
                text(" ")
            if name == "a":
                node.link_tags += 1
                if links:  # they don't nest
                    shut(next(k for k in range(len(inline) - 1, -1, -1) if inline[k][3]))
            node.inner_tags += 1
            if name not in EMPTY and not rest.endswith("/"):
                never, mark = _judged(name, rest)
                gone = never or bool(mark & MARKED)
                inline.append((name, node, gone, name == "a"))
                open_names[name] += 1
                dropped += gone
                links += name == "a"
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        # a block ends an open paragraph; an item, cell or row ends its predecessor
        up = node
        while up is not root and up.name == "p":
            up = up.parent
        for group in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)):
            if name in group and up.name in group:
                up = up.parent
        close(up)
        child = Node(name, node, *_judged(name, rest))
        if name in WHOLE:
            child.dropped, child.mark = False, 0
        node.children.append(child)
        node.texts.append(child)
        if links:  # a block in a link
            child.link_tags += 1
        if name not in EMPTY and not rest.endswith("/"):
            node = child
            open_names[name] += 1
            dropped += child.dropped
    if at < len(page):
        text(html.unescape(re.sub(r"<[a-zA-Z/!].*\Z", "", page[at:], flags=re.S)))
    return root


def _order(node: Node) -> list[Node]:
    """The nodes that haven't been dropped, parents before their children, in page order."""
    todo, out = [node], []
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [x for x in reversed(n.children) if not x.dropped]
    return out


def _body(order: list[Node]) -> Node:
    return next((n for n in order if n.name == "body"), order[0])


#: A page's text outside marked elements stands for its content from so many characters on, or so small a part of the text inside them.
LEAST, PART = 140, 4


def _drop_marked(root: Node) -> None:
    """Drops the marked elements that aren't wrappers of the content."""
    order = _order(root)
    marked = [n for n in order if n.mark & MARKED]
    if not marked:
        return
    for n in reversed(order):
        n.prose = n.own() - n.link + sum(x.prose for x in n.children if not x.dropped)
        n.mains = (n.name == "main") + sum(x.mains for x in n.children if not x.dropped)
        n.articles = (n.name == "article") + sum(x.articles for x in n.children if not x.dropped)
    under, free_articles, free_mains, inside = {id(root): False}, 0, 0, 0
    for n in order:
        below = under[id(n)] or bool(n.mark & MARKED)
        free_articles += n.name == "article" and not below
        free_mains += n.name == "main" and not below
        if below and not under[id(n)]:
            inside += n.prose
        under.update((id(x), below) for x in n.children)
    outside = _body(order).prose - inside
    believed = outside >= LEAST or PART * outside >= inside
    kept: set[int] = set()
    for n in order:
        if not n.mark & MARKED:
            continue
        wraps = n.mains > 0 or n.articles > 0 and not free_articles and not free_mains
        # the content of a page that has neither: whatever holds most of it, and isn't in another one that goes
        most = not believed and not free_articles and not free_mains and 2 * n.prose > inside
        if not (wraps or most):
            n.dropped = True


def _drop_headers(root: Node) -> None:
    order = _order(root)
    inside = {id(root): False}
    for n in order:
        below = inside[id(n)] or n.name in ("article", "main")
        inside.update((id(x), below) for x in n.children)
    for n in reversed(order):
        n.heading = n.name in HEADINGS or any(x.heading for x in n.children if not x.dropped)
    for n in order:
        if n.name == "header":
            up = n.parent
            above = up is not None and up.name not in ("#root", "html", "body") and sum(x.own() for x in up.children if x.name == "p" and not x.dropped) >= 80
            n.dropped = not (n.heading and (inside[id(n)] or above))


def _measure(root: Node) -> Node:
    """Densities, their sums, and the largest sum at or below each node."""
    order = _order(root)
    for n in reversed(order):
        inner = [x for x in n.children if not x.dropped]
        n.c, n.lc = n.own() + sum(x.c for x in inner), n.link + sum(x.lc for x in inner)
        n.t, n.lt = 1 + n.inner_tags + sum(x.t for x in inner), n.link_tags + sum(x.lt for x in inner)
    body = _body(order)
    share = body.lc / max(1, body.c)
    for n in reversed(order):
        inner = n.c / max(1, n.lc) * n.t / max(1, n.lt)
        n.density = n.c / n.t * math.log(inner) / math.log(n.c / max(1, n.c - n.lc) * n.lc + share * n.c + math.e) if n.c and inner > 1 else 0.0
        below = [x for x in n.children if not x.dropped]
        n.total = sum(x.density for x in below)
        n.top = n
        for x in below:
            if x.top.total > n.top.total:  # of equal ones the outermost, then the first
                n.top = x.top
    return body


def select(root: Node) -> list[Node]:
    """The content nodes in page order."""
    _drop_marked(root)
    _drop_headers(root)
    body = _measure(root)
    if not body.c:
        return []
    best = body.top
    if not best.total:  # no node has children with text: the densest node
        best = max((n for n in _order(body) if n.c), key=lambda n: n.density)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    on_path = {id(n) for n in path}
    for n in _order(body):
        if n.mark & DOUBTFUL and id(n) not in on_path and n.density < threshold or n.mark & LIST and 2 * n.lc > n.c:
            n.dropped = True
    content = {id(best)}
    todo = [body]
    while todo:  # the threshold, from the body down
        n = todo.pop()
        if n.dropped or id(n) in content or n.density < threshold:
            continue
        if id(n) not in on_path and n.c and 2 * n.lc < n.c:
            content.add(id(n.top if n.top.total else n))
        if id(n) not in content:
            todo += n.children
    # what belongs to the content: its article, or a main element without one, and the headings before it
    for n in [x for x in _order(body) if id(x) in content]:
        holder, up = None, n
        while up is not None:
            if up.name == "article" or up.name == "main" and (holder is None or holder.name == "main"):
                holder = up
            up = up.parent
        if holder is not None:
            beside = holder.parent.children if holder.name == "article" else ()
            content.update(id(x) for x in (holder, *(x for x in beside if x.name == "article" and not x.dropped and 2 * x.lc < x.c)))
    up = best
    while up is not body:
        up = up.parent
        before = [x for x in up.children[: next(k for k, x in enumerate(up.children) if id(x) in on_path)] if not x.dropped]
        if before and before[-1].name in HEADINGS:
            content.add(id(before[-1]))
    out, todo = [], [body]
    while todo:
        n = todo.pop()
        if n.dropped:
            continue
        if id(n) in content:
            out.append(n)
        else:
            todo += reversed(n.children)
    return out


def render(nodes: list[Node]) -> str:
    blocks: list[str] = []
    for node in nodes:
        part: list[str] = []
        todo: list[str | Node | None] = [node]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                part.append(x)
                continue
            if part and (block := " ".join("".join(part).split())):
                blocks.append(block)
            part = []
            if x is not None and not x.dropped:  # None: a node's end
                todo.append(None)
                todo += reversed(x.texts)
    return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    return render(select(parse(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                text = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, pc.utf8_length(text).cast(pa.int64())], ["page_id", "url", "text", "n_chars"])

    page_id = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {page_id}, url string, text string, n_chars long")
