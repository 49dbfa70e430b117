"""Main text of web pages by composite text density (CETD).

Method: one pass builds the DOM with the usual rules for tags that are left out or not closed. For every node, characters,
characters inside links, tags and link tags are counted over its subtree; the composite density is characters per tag,
scaled down by the logarithm of the share and length of links. A node's density sum adds the densities of its children. The node
with the largest sum anchors the article; the least density on the path from it up to the body is the threshold, and
the article is the highest node on that path (below the body) whose density is above the body's own. Inside it, link lists
under the threshold are left out.

What never is main text goes before the counts: scripts, styles and other raw elements, controls of forms, nav, header (unless it
is inside an article), footer, aside, dialogs and hidden elements. Forms, and elements marked as a menu, sidebar, notice, advert or reader
comments by a name in class, id or role, go by what they hold: one with over half of the page's characters stays if it holds the
article, main or h1 element, or if next to nothing is left without it. A name marks as a whole, at the end of a compound (``user-comments``)
or before a word for a holder (``ad-box``); not after a state word (``has-sidebar``), and in an id, which may stem from a heading, not if it is
an everyday word. Headings are never marked. Inside an ``article`` element reader comments, adverts, notices of consent and newsletter boxes go
by their name, other marked parts only if more than half of them is links. If the article would be one of several containers
directly under the body, it is the body.

Text: character references decoded once, white space inside a block to one space, trimmed; blocks (and parts around
a block inside) in page order, joined by a line feed. ``br`` ends a line like a block.

Defined cases: a null or empty page, or one without text, gives an empty text. Text outside of any element counts as the
body's. Very deep nesting is flat work (no recursion, no walk over the open elements). Repeated pages each get a row.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import text_of

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                  r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template head title svg math canvas iframe object embed audio video map nav footer aside button "
                    "select option textarea input label fieldset legend dialog menu datalist optgroup noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
                   "table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("br body html caption dd dt li option optgroup legend summary title td th tr tbody thead tfoot".split())
# what an opening tag closes, and the elements at which the search for it ends
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
# Words of class, id and role that name a part beside the article. READERS go inside of one too; EVERYDAY words are
# also common in headings and so in ids made from them.
READERS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promoted outbrain taboola "
                    "cookie cookies consent gdpr popup modal newsletter subscribe subscription comment comments commentlist disqus respond".split())
STRUCTURE = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside widget widgets "
                      "header masthead topbar footer foot colophon copyright complementary contentinfo".split())
EVERYDAY = frozenset("promotion rail notice notices notification alert overlay toast signup login search replies discussion share sharing social related "
                     "recommended recommendations skip".split())
BESIDE = READERS | STRUCTURE | EVERYDAY
STATES = frozenset("has have no not with without is show hide hidden non".split())
HOLDERS = frozenset("box bar wrapper wrap container block area section list form links link panel slot unit holder inner group module row strip region thread".split())
OWN_PARTS = frozenset("post entry article content story section title page".split())
BODY_PARTS = frozenset(("html", "body", "main", "article"))
CONTAINERS = frozenset("div section article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "links", "tags", "link_tags", "density", "total", "mark", "inside")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.mark, self.inside = "", False


def _beside(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no main text whatever it holds; ``inside``: of an article element."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs or tag in BODY_PARTS:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _mark(attrs: str) -> str:
    """The word of class, id or role that names a part beside the article, READERS first, or an empty text."""
    found = ""
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name not in ("class", "id", "role"):
            continue
        for token in value.strip("\"'").split():
            parts = _WORDS.findall(_CAMEL.sub(" ", token).lower())
            if not parts or parts[0] in STATES:
                continue
            words = [parts[-1]]
            if len(parts) > 1 and (parts[-1] in HOLDERS or parts[-1] in BESIDE):
                words.append(parts[0])
            if len(parts) > 1 and parts[-1] in ("header", "foot", "footer") and parts[0] in OWN_PARTS:
                words = []
            for word in words:
                if word in READERS:
                    return word
                if word in STRUCTURE or word in EVERYDAY and name != "id":
                    found = found or word
    return found


def parse(page: str) -> Node:
    """The DOM under a body node; dropped elements are kept as empty nodes."""
    body = Node("body", None, False)
    stack, at, end = [body], 0, len(page)
    opened: Counter[str] = Counter()        # of each name on the stack, so that nothing is looked for in vain

    def cut(low: int) -> None:
        opened.subtract(n.tag for n in stack[low:])
        del stack[low:]

    def text(s: str) -> None:
        if s and not stack[-1].dropped:
            stack[-1].children.append(html.unescape(s))

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the outermost open element of ``names`` above the nearest of ``stops``."""
        if not any(opened[n] for n in names):
            return
        low = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops:
                break
            if stack[k].tag in names:
                low = k
        if low:
            cut(low)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a "<" that opens nothing is text
            text(page[at:lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"].replace("&", "&amp;"))
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            if name == "p" and not opened["p"]:
                stack[-1].children.append(Node("p", stack[-1], False))
            elif name not in ("html", "body") and opened[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        cut(k)
                        break
                    if stack[k].tag in ("td", "th", "table") and name not in BLOCKS:
                        break
            continue
        if name in ("html", "body"):
            continue
        if name not in ("head",) and stack[-1].tag == "head" and name not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            cut(len(stack) - 1)
        if name in CLOSES_P and stack[-1].tag != "body":
            close(("p",), ("button", "td", "th", "table", "article", "section", "div", "li", "blockquote", "main", "figure"))
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name == "a":
            close(("a",), ("td", "th", "table", "div", "li", "p"))
        attrs = m["attrs"] or m["attrs2"] or ""
        parent = stack[-1]
        node = Node(name, parent, parent.dropped or _beside(name, attrs, opened["article"] > 0))
        node.inside = opened["article"] > 0
        node.mark = "form" if name == "form" else _mark(attrs) if attrs and name not in BODY_PARTS and name not in HEADINGS else ""
        if not parent.dropped:
            parent.children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            inside, at = page[at:stop.start() if stop else end], stop.end() if stop else end
            if not node.dropped:
                node.children.append(html.unescape(inside))
        elif name not in VOID and not attrs.rstrip().endswith("/") or name not in VOID and name in BLOCKS:
            stack.append(node)
            opened[name] += 1
    return body


def _walk(top: Node) -> list[Node]:
    """Nodes of a subtree, parents before children, without dropped ones."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped]
    return out


def leave_out(body: Node) -> None:
    """Drop forms and marked parts by what they hold (module docstring)."""
    nodes = _walk(body)
    size: dict[int, int] = {}
    titled: dict[int, bool] = {}            # holds an article, main or h1 element with text
    for node in reversed(nodes):
        size[id(node)] = sum(len("".join(c.split())) if isinstance(c, str) else size.get(id(c), 0) for c in node.children)
        titled[id(node)] = size[id(node)] > 0 and (node.tag in ("article", "main", "h1") or any(titled.get(id(c), False) for c in node.children if not isinstance(c, str)))
    outer, todo = [], [body]                # marked parts outside of an article, the outermost ones
    rest, rest_titled = size[id(body)], False
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str) or c.dropped:
                continue
            if c.mark and not c.inside:
                outer.append(c)
                rest -= size[id(c)]
            else:
                rest_titled = rest_titled or size[id(c)] > 0 and c.tag in ("article", "main", "h1")
                todo.append(c)
    whole = size[id(body)]

    def goes(node: Node) -> bool:
        if node.inside:
            return (node.mark == "form" or node.mark in READERS) and not titled[id(node)]
        if 2 * size[id(node)] <= whole:
            return True
        return not titled[id(node)] and (rest_titled or 4 * rest >= whole)
    for node in nodes:
        if node.mark:
            node.dropped = goes(node)


def measure(body: Node) -> list[Node]:
    """Counts, composite densities and density sums of every node; returns the nodes in page order."""
    nodes = _walk(body)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.dropped:
                node.chars += c.chars
                node.links += c.links
                node.tags += c.tags + 1
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.links, node.link_tags = node.chars, node.link_tags + 1
    whole = body.links / max(1, body.chars)
    for node in reversed(nodes):
        c, tags, lc, lt = node.chars, max(1, node.tags), node.links, max(1, node.link_tags)
        if c:
            plain = max(1, c - lc)
            base = math.log(c * lc / plain + whole * c + math.e)
            node.density = c / tags * math.log(max(1.0, (c / max(1, lc)) * (tags / lt)) + 1) / base
        node.total = sum(x.density for x in node.children if not isinstance(x, str) and not x.dropped)
    return nodes


def article(body: Node) -> tuple[Node, float]:
    """The article's node and the threshold."""
    nodes = measure(body)
    best = max(nodes, key=lambda n: n.total)  # of equal sums the first, which is the outermost
    if not best.total:
        return body, 0.0
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    outer = best
    for node in path[1:-1]:
        if node.density >= body.density:
            outer = node
    beside = [x for x in body.children if not isinstance(x, str) and not x.dropped and x is not outer]
    if outer.parent is body and outer.tag not in ("main", "article") and any(
            x.tag in CONTAINERS and x.density >= threshold and x.links <= 0.5 * x.chars and 2 * x.total >= outer.total for x in beside):
        outer = body
    return outer, threshold


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    body = parse(page)
    leave_out(body)
    top, threshold = article(body)
    lines: list[list[str]] = [[]]
    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            lines.append([])
        elif isinstance(x, str):
            lines[-1].append(x)
        elif not x.dropped:
            if x is not top and x.links > 0.5 * x.chars and (x.mark or x.tag in BLOCKS and x.density < threshold and x.link_tags > 1):
                lines.append([])
                continue
            block = x.tag in BLOCKS
            todo += [None] * block + list(reversed(x.children)) + [None] * block
    return "\n".join(t for t in (" ".join("".join(parts).split()) for parts in lines) if t)


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with a string column ``out``: the main text, empty where there is none."""
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in batch], pa.string())

    return pages.withColumn(out, F.arrow_udf(of, "string")(text_of(pages, html_col)))
