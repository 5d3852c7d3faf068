"""The main text of web pages by composite text density.

A page becomes a tree of elements.  Scripts, styles, forms and the like, menus,
page headers and footers, sidebars, adverts, notices and reader comments are
left out, by their element, role, class or id.  For each node left:

    c, t    characters of text and elements below it
    lc, lt  characters inside links and links below it
    density = c/t * log(c*t / (lc*lt)) / log(log(c*lc/(c-lc) + c*LC/C + e) + e - 1)

with divisors of 0 as 1, and ``LC/C`` the share of link characters of the body; the
last term keeps the divisor at 1 or more where a page has no links.
A node without text has density 0.  The subtree whose children's densities have
the greatest sum holds the main text; the least density on the path from it to
the body is the threshold.  From the body downwards, each node that reaches the
threshold marks the subtree with the greatest sum below it; nodes below the
threshold are not entered.  An ``article`` or ``main`` around the first subtree
counts whole, and lists that are nearly only short links don't count.

Marked text is cut into blocks at elements that are not inline; references are
decoded, white space (any of Unicode) becomes one space, ``br`` is white space,
and empty blocks go.  Blocks are joined by two newlines.

Null and empty pages, and pages without text in their body, give an empty text.
Tags and comments that the end of a page cuts off are dropped, elements that it
leaves open end there, and end tags without a start are ignored.  Pages are
worked on one by one, in time and memory proportional to their length; repeated
rows each give a row, an empty table an empty one.  Columns that are not kept
are not read, so their names don't clash.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame

from .store import map_texts

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr
    q s samp small span strike strong sub sup time tt u var wbr""".split())
LEFT_OUT = frozenset("""head title script style noscript template iframe object embed applet svg math canvas audio
    video map form button input select textarea option datalist fieldset nav menu footer aside dialog noframes
    noembed xmp frameset""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of a class or an id that say what is not the article.
NOTED = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner banners
    sponsor sponsors sponsored promo promos promotion sidebar sidebars sidebox rail menu menus submenu nav navi navbar
    navigation breadcrumb breadcrumbs crumbs topbar toolbar header masthead footer foot bottombar cookie cookies
    consent gdpr notice notices alert alerts notification notifications disclaimer popup modal overlay interstitial
    paywall comment comments commentlist commentary disqus respond reply replies feedback share sharing
    sharebar social related recommended recommendations teaser teasers newsletter subscribe subscription signup login
    search searchbox form widget widgets pagination pager copyright legal skip skiplink hidden""".split())
# A class that says that there is or isn't such a part; its words say nothing.
ABOUT = ("no-", "has-", "with-", "without-", "is-", "not-")
MAIN = ("article", "main")
# What an element's start tag ends, up to the elements that hold it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}
ROOTS = frozenset("html body table td th caption article section main div".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                 r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
COMMENTS = re.compile(r"(\d+ )?(reader )?(comments?|responses|replies)( \(?\d+\)?)?:?", re.I)
# A list is a menu if it has so many links, so large a share of its characters
# is in them, and they have so few characters on average.
MENU_LINKS, MENU_SHARE, MENU_CHARS = 3, 0.8, 40


class Node:
    """An element; ``inside`` holds texts and elements in their order."""
    __slots__ = ("name", "inside", "note", "hold", "c", "t", "lc", "lt", "density", "total", "marked")

    def __init__(self, name: str):
        self.name, self.inside = name, []
        self.note = self.hold = self.marked = False
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0


class Open:
    """The open elements, with the places of each name, so that no tag walks
    over all of them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], defaultdict(list), [0]

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def push(self, node: Node) -> None:
        if node.name not in INLINE:
            self.blocks.append(len(self.nodes))
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def end(self, at: int) -> None:
        """Ends the element at a place and all inside it; 0 ends none."""
        while at and len(self.nodes) > at:
            self.places[self.nodes.pop().name].pop()
            if self.blocks[-1] == len(self.nodes):
                self.blocks.pop()

    def end_tag(self, name: str) -> None:
        """Ends the innermost element of a name; an inline end tag doesn't reach
        over an element that is none."""
        at = self.last([name])
        limit = self.blocks[-1] if name in INLINE else self.last(ROOTS) if name == "p" else 0
        if at > limit:
            self.end(at)

    def make_room(self, name: str) -> None:
        """Ends what a start tag ends without an end tag."""
        if name in ENDS:
            ended, holders = ENDS[name]
            holder = self.last(holders)
            self.end(min((x for x in (self.last([e]) for e in ended) if x > holder), default=0))
        if name not in INLINE and self.nodes[self.blocks[-1]].name == "p":
            self.end(self.blocks[-1])


def tree(page: str) -> Node:
    """The elements of a page below a root."""
    root = Node("")
    stack = Open(root)
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            stack.nodes[-1].inside.append(page[at:start])
        if start == size:
            break
        m = TAG.match(page, start) or BROKEN.match(page, start)
        if not m:
            stack.nodes[-1].inside.append("<")
            at = start + 1
            continue
        at = m.end()
        name = m.lastindex and m.group(2)
        if not name or not m.group(4):
            continue
        name = name.lower()
        if m.group(1):
            stack.end_tag(name)
            continue
        stack.make_room(name)
        node = Node(name)
        _look_at(node, m.group(3), any(stack.places[n] for n in MAIN))
        stack.nodes[-1].inside.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.push(node)
    return root


def _look_at(node: Node, attributes: str, in_main: bool) -> None:
    """``hold``: left out for what the element is; ``note``: for its class or id."""
    name = node.name
    node.hold = name in LEFT_OUT or name == "header" and not in_main
    if not attributes.strip() or name in ("html", "body", *MAIN):
        return
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "role":
            node.hold |= value.strip().lower() in ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            node.hold = True
        elif key == "style":
            node.hold |= "display:none" in value.replace(" ", "").lower()
        elif key in ("class", "id"):
            for word in html.unescape(value).split():
                if not word.lower().startswith(ABOUT):
                    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", word)
                    node.note |= any(p.lower() in NOTED for p in parts)


def _prune(root: Node) -> Node:
    """Leaves out what is not the article; gives the body, or the root."""
    order = _before_children(root)
    body = next((n for n in order if n.name == "body"), root)
    # A class speaks only of parts without an article, and not of the whole page.
    holds = set()
    for n in reversed(order):
        if n.name in MAIN or any(id(x) in holds for x in n.inside if isinstance(x, Node)):
            holds.add(id(n))
        if n.name == "form" and id(n) in holds:
            n.hold = False
        if n.hold:
            holds.discard(id(n))
    for n in order:
        parts = [x for x in n.inside if isinstance(x, Node)]
        heading = next((x for x in parts if len(x.name) == 2 and x.name[0] == "h" and x.name in "h2h3h4h5h6"), None)
        if heading and n.name in ("section", "div", "ol", "ul") and heading is parts[0] and id(n) not in holds:
            n.hold |= bool(COMMENTS.fullmatch(" ".join(_text([heading]).split())))
    strict = lambda n: n.hold or n.note and id(n) not in holds
    if not _has_text(body, strict):
        strict = lambda n: n.hold
        if not _has_text(body, strict):
            strict = lambda n: n.hold and n.name != "form"
    for n in order:
        n.inside = [x for x in n.inside if isinstance(x, str) or not strict(x)]
    return body


def _has_text(body: Node, left_out: Callable[[Node], bool]) -> bool:
    open_ = [body]
    while open_:
        for x in open_.pop().inside:
            if isinstance(x, str):
                if x.strip():
                    return True
            elif not left_out(x):
                open_.append(x)
    return False


def _before_children(root: Node) -> list[Node]:
    order, open_ = [], [root]
    while open_:
        n = open_.pop()
        order.append(n)
        open_.extend(x for x in reversed(n.inside) if isinstance(x, Node))
    return order


def _text(nodes: list[Node]) -> str:
    return "".join(x for n in nodes for m in _before_children(n) for x in m.inside if isinstance(x, str))


def measure(body: Node) -> list[Node]:
    """Fills in counts, densities and sums of all nodes; gives them in page order."""
    order = _before_children(body)
    for n in reversed(order):
        for x in n.inside:
            if isinstance(x, str):
                n.c += len(" ".join(html.unescape(x).split()))
            else:
                n.c += x.c
                n.t += x.t + 1
                n.lc += x.lc
                n.lt += x.lt + (x.name == "a")
        if n.name == "a":
            n.lc = n.c
    share = body.lc / body.c if body.c else 0.0
    for n in reversed(order):
        if n.c:
            t, lc, lt, other = n.t or 1, n.lc or 1, n.lt or 1, (n.c - n.lc) or 1
            base = math.log(n.c * n.lc / other + share * n.c + math.e)
            # Without a link the base is e or a little more; its logarithm is never 0.
            n.density = max(0.0, n.c / t * math.log(n.c * t / (lc * lt)) / math.log(base + math.e - 1))
        n.total = sum(x.density for x in n.inside if isinstance(x, Node))
    return order


def mark(body: Node) -> None:
    """Marks the subtrees that hold the main text."""
    order = measure(body)
    if not body.c:
        return
    parent = {id(x): n for n in order for x in n.inside if isinstance(x, Node)}
    place = {id(n): i for i, n in enumerate(order)}
    # The best sum below each node: the first in page order of equal ones.
    best: dict[int, Node] = {}
    for n in reversed(order):
        b = n
        for x in n.inside:
            if isinstance(x, Node):
                o = best[id(x)]
                if (o.total, -place[id(o)]) > (b.total, -place[id(b)]):
                    b = o
        best[id(n)] = b
    top = best[id(body)]
    threshold, around, n = top.density, top, top
    while n is not body:
        n = parent[id(n)]
        threshold = min(threshold, n.density)
        if n.name in MAIN and around.name not in MAIN:
            around = n
    around.marked = True
    open_ = [body]
    while open_:
        n = open_.pop()
        if n.c and n.density >= threshold:
            best[id(n)].marked = True
            open_.extend(x for x in n.inside if isinstance(x, Node))


def _is_menu(n: Node) -> bool:
    return (n.name in ("ul", "ol", "div", "p", "table", "section", "dl", "center") and n.lt >= MENU_LINKS
            and n.lc >= MENU_SHARE * n.c and n.lc <= MENU_CHARS * n.lt)


def blocks(body: Node) -> list[str]:
    """Marked texts in page order, cut at elements that are not inline."""
    found: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            found.append(text)
    # Entries: what comes next, and whether it is inside a marked subtree.
    open_: list[tuple[object, bool]] = [(body, False)]
    while open_:
        x, inside = open_.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                held.append(x)
        elif not (_is_menu(x) and x is not body):
            inside = inside or x.marked
            inline = x.name in INLINE
            if x.name == "br":
                held.append(" ")
            if not inline:
                end()
                open_.append((None, inside))
            open_.extend((y, inside) for y in reversed(x.inside))
    end()
    return found


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    body = _prune(tree(page))
    mark(body)
    return "\n\n".join(blocks(body))


def extract(df: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """``keep, text, n_chars``: the main text of each page and its code points."""
    def make():
        def work(pages: list[str | None]) -> dict[str, list]:
            texts = [main_text(p) for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}
        return work
    return map_texts(df, keep, page, "text string, n_chars long", make)
