"""Main text of web pages by composite text density.

Each node's density is its characters for each tag below it, adjusted by the share of link text (the
composite text density of Sun, Song and Liao, "DOM based content extraction via text density", 2011).  A
node is judged by the sum of its children's densities, a run of text and inline elements being one child: the
node with the largest sum holds the article, and along the path from body to it the least density gives the
threshold: other parts that reach it are kept, each by its own node with the largest sum, and the rest is
dropped, as are blocks inside that miss it and are lists of links.
Parts that announce themselves as furniture (navigation, asides, forms, notices, comments and so on) are
taken out before densities are computed; where only a name or a form tells so, not those that seem to hold the article.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm._common import text_or_empty

# Element names of HTML by how they are parsed or shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
INVISIBLE = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext head template svg math object audio video canvas datalist select option button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("nav header footer aside dialog menu".split())
#: Furniture unless the article may be in them: a form may go around a whole page.
FORMS = frozenset(["form", "fieldset"])
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An open paragraph outside of these stays open, and an inline element's end inside of those ends nothing outside.
KEEPS_PARAGRAPH = ("table", "td", "th", "button", "object")
SCOPES = ("table", "article", "body")
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["tr", "td", "th", "tbody", "tfoot"]), frozenset(["table"])),
    "tbody": (frozenset(["tr", "td", "th", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tr", "td", "th", "thead", "tbody"]), frozenset(["table"])),
}
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that tell furniture, each as a whole word between separators.
FURNITURE_WORDS = frozenset(
    """ad ads adbox adsense advert adverts advertise advertisement advertisements advertising sponsor sponsored promo promoted promotion banner
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pager pagination toc
    header masthead topbar footer colophon sidebar sidebars aside rail widget widgets
    notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login paywall
    comment comments commentlist respond disqus discussion replies reply
    share sharing social related recommended recommendations trending popular outbrain taboola
    form search searchform skip hidden disclaimer""".split()
)
#: Those of them that tell what readers wrote, which may be longer than the article.
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus discussion replies reply".split())
ARTICLE_WORDS = frozenset("article post entry content main story body text".split())
#: A block of so many links at least, that make up so large a share of its characters, is a list of links.
LEAST_LINKS, LINK_SHARE = 3, 0.9
#: A part reaches the threshold with so much of it: a heading, or fewer blocks, lower the density of a like text a little.
NEARLY = 0.7
#: Words beside which header means the article's own.
HEADED_WORDS = frozenset("article post entry story".split())

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<bogus>[!?][^>]*(?:>|\Z))|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(?P<own>/?)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "furniture", "doubt", "declares", "chars", "link_chars", "tags", "link_tags", "density", "total", "said")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False, said: bool = False):
        self.tag, self.parent, self.furniture, self.said = tag, parent, furniture, said
        self.doubt, self.declares = "", False
        self.children: list[Node | str] = []


def _furniture(tag: str, attrs: dict[str, str]) -> bool:
    if tag in FURNITURE or attrs.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


def _furniture_words(attrs: dict[str, str]) -> set[str]:
    """Words of class and id that tell furniture."""
    named = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()
    words = set(_WORDS.findall(named))
    found = words & FURNITURE_WORDS
    return set() if found == {"header"} and words & HEADED_WORDS else found


def _children(node: Node) -> Iterator[Node]:
    return (c for c in node.children if isinstance(c, Node) and not c.furniture and c.tag not in INVISIBLE)


def _settle(root: Node) -> None:
    """Makes furniture of the parts that are so by a word of their name, or as forms, only.

    Such a part stays in, for the density to judge, where no article or main is beside it and it either contains one
    or holds more than half of the page's text outside links; the latter isn't enough for comments.
    """
    order, todo = [], [root]
    while todo:
        order.append(node := todo.pop())
        todo += _children(node)
    declared: dict[Node, int] = {}  # articles in each subtree
    for n in reversed(order):
        declared[n] = n.declares + sum(declared[c] for c in _children(n))
    plain: dict[Node, int] = {}  # characters outside links
    scopes = [root]
    while scopes:
        doubtful, beside, todo = [], 0, [(scopes.pop(), 0)]
        while todo:
            node, above = todo.pop()
            for c in _children(node):
                if c.doubt:
                    doubtful.append((c, above))
                else:
                    beside += c.declares
                    todo.append((c, above + c.declares))
        for c, above in doubtful:
            c.furniture = beside > above
            if not c.furniture and not declared[c]:
                if not plain:
                    for n in reversed(order):
                        own = sum(len("".join(x.split())) for x in n.children if isinstance(x, str))
                        plain[n] = 0 if n.tag == "a" else own + sum(plain.get(x, 0) for x in n.children if isinstance(x, Node))
                c.furniture = c.doubt == "comments" or 2 * plain[c] <= plain[root]
            if not c.furniture:
                scopes.append(c)


class _Open:
    """The open elements from the root to the present one, with the places of each tag, so that no search walks the path."""

    def __init__(self, root: Node):
        self.path = [root]
        self.places: dict[str, list[int]] = {}

    @property
    def node(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.path) > place:
            self.places[self.path.pop().tag].pop()

    def last(self, tags) -> int:
        """The innermost place of any of the tags; 0, the root's, where none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_within(self, tags, stop) -> int:
        """The outermost place of any of the tags inside the innermost of ``stop``; 0 if there is none."""
        edge, found = self.last(stop), []
        for t in tags:
            held = self.places.get(t, ())
            at = bisect_right(held, edge)
            found += held[at : at + 1]
        return min(found, default=0)


def parse(source: str) -> Node:
    """A forgiving tree: unknown ends are skipped, open paragraphs and items close where HTML closes them.

    Time is in proportion to the page, however deeply it is nested.
    """
    root = Node("html", None)
    path = _Open(root)
    doubts = False
    at, size, found = 0, len(source), _TAG.match
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            path.node.children.append(source[at:])
            break
        if lt > at:
            path.node.children.append(source[at:lt])
        m = found(source, lt)
        if not m:
            path.node.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if end := m["end"]:
            end = end.lower()
            place = path.last([end])
            if place and not (end in INLINE and path.last(SCOPES) > place):
                path.cut(place)
            elif end == "p":
                path.node.children.append(Node("p", path.node))
            continue
        if not m["start"]:
            continue
        tag = m["start"].lower()
        if tag in ("html", "body") and (tag == "html" or path.last(["body"])):
            continue
        if tag in CLOSES_PARAGRAPH:
            paragraph = path.last(["p"])
            if paragraph > path.last(KEEPS_PARAGRAPH):
                path.cut(paragraph)
            if tag[0] == "h" and tag[1:].isdigit() and path.node.tag[0] == "h" and path.node.tag[1:].isdigit():
                path.cut(len(path.path) - 1)
        elif tag in CLOSED_BY and (place := path.first_within(*CLOSED_BY[tag])):
            path.cut(place)
        attrs = {k.lower(): next((v for v in (a, b, c) if v), "") for k, a, b, c in _ATTR.findall(m["attrs"] or "")} if m["attrs"] else {}
        words = set(_WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) if attrs else set()
        node, role = path.node, attrs.get("role", "").lower()
        own = tag in ("main", "article") or role in ("main", "article") or attrs.get("itemprop") == "articleBody"
        # an article's own header is its headline
        furniture = _furniture(tag, attrs) and not (tag == "header" and path.last(["article"]) and not role)
        new = Node(tag, node, furniture, own or bool(words & ARTICLE_WORDS))
        furniture_words = _furniture_words(attrs) if attrs and not (tag == "header" and not furniture) else set()
        new.declares = own and (not furniture_words or tag == "main" or role == "main")
        if (furniture_words or tag in FORMS) and tag not in ("html", "body", "main", "article"):
            new.doubt = "comments" if furniture_words & COMMENT_WORDS else "name"
            doubts = True
        node.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else size
        elif tag not in VOID and not (m["own"] and tag not in INLINE and tag not in CLOSES_PARAGRAPH):
            path.push(new)
    if doubts:
        _settle(root)
    return root


def _path(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _ordered(root: Node) -> list[Node]:
    """Visible nodes, parents first; no recursion, as pages may be nested deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed([*_children(node)])
    return out


def _count(n: Node) -> None:
    own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
    below = [c for c in n.children if isinstance(c, Node) and hasattr(c, "chars")]
    n.chars = own + sum(c.chars for c in below)
    n.tags = sum(c.tags + 1 for c in below)
    n.link_chars = n.chars if n.tag == "a" else sum(c.link_chars for c in below)
    n.link_tags = sum(c.link_tags + (c.tag == "a") for c in below)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * links + ratio * chars + math.e)
    return max(0.0, chars / tags * math.log(chars * tags / (links * link_tags)) / math.log(base))


def _runs(n: Node) -> Iterator[Node | tuple[int, int, int, int]]:
    """Children that are blocks, and between them characters, tags, link characters and link tags of each run."""
    chars = tags = link_chars = link_tags = 0
    for c in n.children:
        if isinstance(c, str):
            chars += len("".join(c.split()))
        elif not hasattr(c, "chars"):
            continue
        elif c.tag in INLINE or c.tag in VOID:
            chars, tags, link_chars, link_tags = chars + c.chars, tags + c.tags + 1, link_chars + c.link_chars, link_tags + c.link_tags + (c.tag == "a")
        else:
            if chars:
                yield chars, tags, link_chars, link_tags
            chars = tags = link_chars = link_tags = 0
            yield c
    if chars:
        yield chars, tags, link_chars, link_tags


def measure(nodes: list[Node]) -> None:
    """Composite text density of every node, and the sum over its children."""
    for n in reversed(nodes):
        _count(n)
    body = nodes[0]
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(nodes):
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, ratio)
        n.total = sum(c.density if isinstance(c, Node) else _density(*c, ratio) for c in _runs(n)) if n.chars else 0.0


def _widened(best: Node, top: Node, body: Node) -> Node:
    """``best`` widened, within ``top``, to the part that calls itself article, or to parents as dense as it."""
    for up in _path(best):
        if up.tag in ("article", "main") or up.said and up is not body:
            best = up
        if up is top or up.tag in ("article", "main"):
            break
    while best.tag != "article" and best is not top and best is not body and best.parent.density >= best.density and best.parent.link_chars * 3 < best.parent.chars:
        best = best.parent
    return best


def _parts(node: Node, kept: set[Node], ratio: float, threshold: float) -> list[Node]:
    """Children in ``kept`` in page order, and runs of text between block children, as parts of their own, where dense enough."""
    out: list[Node] = []
    run: Node | None = None
    for c in node.children:
        if isinstance(c, Node) and (c in kept or c.tag not in INLINE and c.tag != "br"):
            run = None
            if c in kept:
                out.append(c)
            continue
        if run is None:
            out.append(run := Node("div", node))
        run.children.append(c)
    for part in out:
        if part not in kept:
            _count(part)
            part.density = _density(part.chars, part.tags, part.link_chars, part.link_tags, ratio)
    return [p for p in out if p.density and p.density >= threshold * NEARLY or p in kept]


def _mark(nodes: list[Node]) -> tuple[list[Node], float]:
    """Subtrees of the article in page order, none inside another, and the threshold.

    The subtree of the largest density sum is one; the least density from it up to the body is the threshold.
    Any other part that reaches it, as all parts around it do, gives its own subtree of the largest sum.
    """
    root = nodes[0]
    if not root.chars:
        return [], 0.0
    # text before or after the body is the page's as well, so the root stands for a body that doesn't hold all of it
    body = next((n for n in nodes if n.tag == "body" and n.chars == root.chars), root)
    largest: dict[Node, Node] = {}  # the block of the largest sum in each subtree
    for n in reversed(nodes):
        found = [n] if n.chars and (n.tag not in INLINE or n is body) else []
        found += [largest[c] for c in n.children if isinstance(c, Node) and c in largest]
        if found:
            largest[n] = max(found, key=lambda x: (x.total, x.chars))
    best = largest[body]
    path = list(_path(best))
    threshold = min(n.density for n in path[: path.index(body) + 1])
    marked: set[Node] = set()
    opened: set[Node] = set()  # parts around marked ones
    todo = [body]
    while todo:
        node = todo.pop()
        if node in marked or node.density < threshold * NEARLY:
            continue
        if node not in opened:
            top = _widened(largest[node], node, body)
            marked.add(top)
            while top is not node:
                top = top.parent
                opened.add(top)
        if node in opened:
            todo += [c for c in node.children if isinstance(c, Node) and c in largest]
    kept, tops, todo = marked | opened, [], [body]
    while todo:
        node = todo.pop()
        if node in opened:
            todo += reversed(_parts(node, kept, root.link_chars / root.chars, threshold))
        else:
            tops.append(node)
    return tops, threshold


def _is_menu(n: Node, threshold: float) -> bool:
    """Whether a block is a list of links and not dense enough."""
    return getattr(n, "link_tags", 0) >= LEAST_LINKS and n.density < threshold and n.link_chars >= LINK_SHARE * n.chars


def _blocks(top: Node, threshold: float) -> list[str]:
    """Texts of blocks in page order: a block ends where a block-level element starts or ends.

    Lists of links are dropped but where the page says that all around them is the article.
    """
    trusted = any(n.declares for n in _path(top))
    out: list[list[str]] = [[]]
    todo: list[tuple[Node | str | None, bool]] = [(top, trusted)]
    while todo:
        x, sure = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.tag == "br":
            out[-1].append(" ")
        elif x.furniture and x is not top or x.tag in INVISIBLE or x is not top and not sure and x.tag not in INLINE and _is_menu(x, threshold):
            if x.tag not in INLINE:
                out.append([])
        elif x.tag in INLINE:
            todo += [(c, sure) for c in reversed(x.children)]
        else:
            out.append([])
            sure = sure or x.declares
            todo += [(None, sure), *[(c, sure) for c in reversed(x.children)]]
    texts = (_SPACE.sub(" ", html.unescape("".join(parts))).strip() for parts in out if parts)
    return [t for t in texts if t]


def main_text(source: str) -> str:
    """The article's blocks joined by line feeds; empty if the page has no visible text."""
    nodes = _ordered(parse(source))
    measure(nodes)
    tops, threshold = _mark(nodes)
    return "\n".join(text for top in tops for text in _blocks(top, threshold))


def _extracted(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("_html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, text, n_chars, one for each row of ``pages`` (page_id, url and html are read).

    A null or empty html, and a page without visible text, give an empty text.  Null ids and urls pass
    through, repeated rows give repeated rows; an empty table gives none.  Pages are read one at a time, whole.
    """
    raw = pages.select("page_id", "url", text_or_empty("html").alias("_html"))
    return raw.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
