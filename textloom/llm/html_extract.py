"""Main-text extraction by tree scoring.

A page becomes a tree of its elements; what cannot be article text (menus,
headers, footers, side bars, notices, adverts, forms, scripts, styles, reader
comments: by element, role or the words of class and id) is marked with all
that is inside. Every paragraph earns points for its length and its commas and
passes them to its ancestors, the parent in full, each one further up less, all
discounted by the share of text inside links. The container with most points
is the article; it is widened to the <article> or <main> around it, if there is
one, else the siblings that carry points or prose of their own are kept with it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: Elements whose content is text of another kind, up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template"}
#: Elements that are never article text.
NEVER = {"nav", "header", "footer", "aside", "form", "noscript", "button", "select", "option", "menu", "dialog", "head", "svg", "math", "object", "embed", "canvas", "audio", "video", "map", "label", "input"} | RAW
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd"}
BLOCKS = PARAGRAPHS | HEADINGS | {"address", "article", "body", "center", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "hr", "html", "main", "ol", "section", "summary", "details", "table", "tbody", "tfoot", "th", "thead", "tr", "ul", "caption"} | (NEVER - {"button", "select", "option", "label", "input", "svg", "math", "object", "embed", "canvas", "audio", "video", "map"})
#: Start tags that end an open element of the second set, if no element of the third stands between.
CLOSES = {
    **{t: ({"p"}, {"button", "td", "th", "table"}) for t in BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}},
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
#: Words of class and id that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus disclaimer footer footnav form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion register related remark remarks reply replies respond search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Marks that other words of the same name take back: a page's layout, or the head of the article itself.
LAYOUT = frozenset("has with no without layout page wrapper hide hidden".split())
TAKEN_BACK = {"header": LAYOUT | frozenset("article entry post story content title".split())} | dict.fromkeys(("sidebar", "nav", "navbar", "comments", "comment", "footer", "ads", "banner", "widget", "widgets", "modal"), LAYOUT)
#: The only marks that count for <article> and <main>: these are not the article but stand in one's place.
ARTICLE_MARKS = frozenset("comment comments reply replies respond related teaser promo sponsored advert advertisement".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ENDS_SENTENCE = re.compile(r"[.!?。！？]\W*$")


class Node:
    __slots__ = ("tag", "parent", "gone", "in_link", "chars", "linked", "commas", "points", "links")

    def __init__(self, tag: str, parent: Node | None, gone: bool):
        self.tag, self.parent, self.gone = tag, parent, gone
        #: Whether it is in a link with no block between; a link left open ends with its block.
        self.in_link = tag == "a" or parent is not None and parent.in_link and tag not in BLOCKS
        self.chars = self.linked = self.commas = self.links = 0
        self.points = 0.0


def is_marked(tag: str, attributes: str) -> bool:
    """Whether an element's attributes say that it is not article text."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id") and tag not in ("html", "body"):
            for one in unescape(value).split():
                words = set(WORD.findall(CAMEL.sub(" ", one).lower()))
                marks = words & (ARTICLE_MARKS if tag in ("article", "main") else MARKS)
                if any(words.isdisjoint(TAKEN_BACK.get(m, ())) for m in marks):
                    return True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements, and the blocks of text in page order, each with the element it stands in."""
    root = Node("#root", None, False)
    nodes, stack, blocks, run = [root], [root], [], []
    position, end = 0, len(html)

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:  # gathered outside of what is gone, though that may be open by now
                holder = stack[-1]
                while (holder.gone or holder.tag not in BLOCKS) and holder.parent is not None:
                    holder = holder.parent
                blocks.append((holder, text))

    def text(piece: str) -> None:
        if not piece or stack[-1].gone:
            return
        piece = unescape(piece) if "&" in piece else piece
        run.append(piece)
        n = len(piece.strip())
        if n:
            linked = stack[-1].in_link or any(x.tag == "a" for x in stack[-3:])
            holder = stack[-1]
            while holder.tag not in BLOCKS and holder.parent is not None:
                holder = holder.parent
            holder.chars += n
            holder.linked += n * linked
            holder.commas += piece.count(",") + piece.count("，") + piece.count("、")

    def pop(at: int) -> None:
        for x in reversed(stack[at:]):
            if x.tag in BLOCKS:
                flush()
                break
        del stack[at:]

    while position < end:
        m = TAG.search(html, position)
        if m is None:
            text(html[position:])
            break
        text(html[position : m.start()])
        position = m.end()
        tag = m[2] and m[2].lower()
        if not tag or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        if m[1]:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if at:
                pop(at)
            elif tag == "p":
                flush()
            continue
        if tag in EMPTY:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in CLOSES:
            which, stop = CLOSES[tag]
            at = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in which:
                    at = k
                elif stack[k].tag in stop:
                    break
            if at:
                pop(at)
        if tag in BLOCKS:
            flush()
        parent = stack[-1]
        gone = parent.gone or tag in NEVER or m[3] != "" and is_marked(tag, m[3])
        if gone and tag in HEADINGS and parent.tag == "header" and not parent.parent.gone and any(x.tag in ("article", "main") for x in stack):
            gone = False  # a heading in the article's own header
        node = Node(tag, parent, gone)
        nodes.append(node)
        if tag == "a" and not gone:
            holder = parent
            while holder.tag not in BLOCKS and holder.parent is not None:
                holder = holder.parent
            holder.links += 1
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(html, position)
            position = close.start() if close else end
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        stack.append(node)
    pop(1)
    flush()
    return nodes, blocks


def extract(html: str) -> str:
    """The main text of a page, its blocks joined by line breaks; empty if there is none."""
    nodes, blocks = parse(html)
    if not blocks:
        return ""
    own: dict[int, list[int]] = {}
    total: dict[int, list[int]] = {}  # characters, linked ones, links, of an element with all inside
    for node in reversed(nodes):  # children come after their parents
        if node.gone:
            continue
        t = total.setdefault(id(node), [0, 0, 0])
        t[0] += node.chars
        t[1] += node.linked
        t[2] += node.links
        if node.parent is not None:
            up = total.setdefault(id(node.parent), [0, 0, 0])
            for k in range(3):
                up[k] += t[k]
    for node in nodes:
        if node.gone or node.tag not in PARAGRAPHS and not (node.tag in ("div", "section", "article", "main", "body") and node.chars):
            continue
        chars, linked, _ = total[id(node)]
        if not node.chars:
            continue
        points = (1 + node.commas + min(node.chars / 100, 3.0) + node.chars / 1000) * (1 - linked / max(chars, 1))
        # a container with text of its own is its own paragraph
        up = node.parent if node.tag in PARAGRAPHS else node
        share, level = 1.0, 1
        while up is not None and up.tag not in ("#root", "html"):
            up.points += points * share
            level += 1
            share = 0.5 if level == 2 else 1 / (3 * (level - 1))
            up = up.parent

    def density(node: Node) -> float:
        chars, linked, _ = total.get(id(node), (0, 0, 0))
        return linked / chars if chars else 0.0

    candidates = [x for x in nodes if not x.gone and x.points > 0 and x.tag not in PARAGRAPHS]
    if not candidates:
        best = nodes[0]
    else:
        best = max(candidates, key=lambda x: x.points * (1 - density(x)) + (25 if x.tag in ("article", "main") else 0))
    up = best
    wide = None
    while up is not None:
        if up.tag in ("article", "main"):
            wide = up
        up = up.parent
    keep = {id(wide or best)}
    if wide is None and best.parent is not None:
        least = max(10.0, 0.2 * best.points)
        titles: dict[int, int] = {}  # characters of headings in each sibling
        for x in nodes:
            if x.tag in HEADINGS and not x.gone:
                up = x
                while up is not None and up.parent is not best.parent:
                    up = up.parent
                if up is not None:
                    titles[id(up)] = titles.get(id(up), 0) + total[id(x)][0]
        for x in nodes:
            if x.parent is best.parent and x is not best and not x.gone:
                chars, linked, _ = total[id(x)]
                prose = x.tag == "p" and density(x) < 0.25 and chars > 80
                if x.points >= least or prose or chars and titles.get(id(x), 0) == chars:
                    keep.add(id(x))
    #: Lists and boxes inside the article that are little but links.
    menus = {id(x) for x in nodes if not x.gone and x.tag in ("ul", "ol", "div", "section", "table", "dl") and id(x) not in keep and total[id(x)][2] >= 3 and density(x) > 0.6}
    inside: dict[int, bool] = {}

    def kept(node: Node) -> bool:
        path = []
        x: Node | None = node
        known = False
        while x is not None:
            if id(x) in inside:
                known = inside[id(x)]
                break
            if id(x) in menus:
                known = False
                break
            path.append(x)
            if id(x) in keep:
                known = True
                break
            x = x.parent
        for y in path:
            inside[id(y)] = known
        return known

    return "\n".join(t for node, t in blocks if kept(node))


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of each row of pages, with text and n_chars (its code points).

    Whole pages are read, however long; null and empty pages give an empty text
    and 0. Tags that the page's end cuts off are dropped, elements left open end
    with their parent. Rows are independent: repeated ones are returned as they
    come, an empty table gives an empty one, and other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract(x) for x in texts_of(batch, html)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return map_batches(pages.select(*keep, html), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars bigint", rows=500)
