"""Main-text extraction by composite text density.

Markup is read into a tree of block elements. A node's density is its characters per tag, adjusted by links: it
falls with the share of characters and tags inside links. A node's density sum is the sum of its children's
densities, its own text counting as one child. On every page the node with the greatest sum marks the text; <article>
and <main> only weigh NAMED in this choice. From it the subtree grows towards the body while the parent is no less
dense than the body as a whole; below the body, siblings join that are as dense and hold SHARE of the greatest sum,
and articles join an article. What lies beside the path and is mostly links stays out. Navigation, headers, footers, asides,
scripts, styles and hidden elements are left out beforehand, as are forms, but for one that wraps most of the page's
paragraphs, and blocks of reader comments by class or id, in articles too, wherever other text is left. A page's only h1
belongs to the text if it stands before it. A class, role or id that says advert, notice
and the like makes a node a suspect: its density is multiplied by PENALTY, and it is dropped only if it is mostly links
or, by class or role, a brief container; one outside of articles that lies in the greatest node or beside the path,
with other text there, also if its reduced density is below the body's. A node with more than half of the text is no
suspect unless it is brief.

Defined results: a null or empty page has an empty text; a page cut off inside a tag loses that tag only; an
unclosed script, style or comment runs to the end, a self-closed one (<svg/>) ends there; text without any element is one block; repeated rows are read alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from stockweave.session import attach

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select)(?=[\s/>])(?:\s*/>|(?:[^>"']|"[^"]*"|'[^']*')*(?:(?<=[\s"']/)>|>.*?(?:</(?P=raw)\s*>|\Z)))|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</?\Z""", re.S | re.I)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside head title button menu dialog".split())
_FORMS = frozenset(("form", "fieldset"))
_NOISE = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted outbrain taboola
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager masthead topbar toolbar header footer foot sidebar aside rail widget widgets
    cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login paywall
    comment comments respond reply replies disqus discussion share sharing social related recommended recommendations
    complementary contentinfo search form skip copyright disclaimer""".split())
#: Weight of <article> and <main> in the choice, and the least share of the greatest sum for a sibling below the body.
NAMED, SHARE = 1.25, 0.2
#: Parts of a class, role or id that may stand beside a noise word: site-header is one, no-sidebar is not.
_NEUTRAL = frozenset("site page global top bottom left right box block wrapper wrap container inner outer area section list item items bar button buttons link links icon icons slot unit".split())
#: Words of a block of reader comments, and those that may stand beside them.
_COMMENT = frozenset("comment comments commentlist respond replies disqus".split())
_BESIDE = _NEUTRAL | frozenset("user users reader readers visitor post article entry thread threads body content form title author".split())
#: An id of these words says as much as a class does.
_SURE = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo outbrain taboola cookie cookies consent gdpr newsletter subscribe subscription signup paywall popup modal share sharing social".split())
#: Read as text whatever the class says, unless mostly links.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption address".split())
#: Factor on a suspect's density, and the most characters of a brief one (a tenth of the page's at most).
PENALTY, BRIEF = 0.1, 200
_CLOSES_P = _BLOCKS - {"body", "html", "head", "title", "option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"li", "dd", "dt"}


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "named", "suspect", "comment")

    def __init__(self, name: str, parent: "Node | None", dropped: bool = False):
        self.name, self.parent, self.children, self.dropped = name, parent, [], dropped
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.named = name in ("article", "main") or parent is not None and parent.named
        self.suspect, self.comment = "", False


def _noisy(value: str, words: frozenset = _NOISE, beside: frozenset = _NEUTRAL) -> bool:
    for word in value.lower().split():
        parts = [t for t in re.split(r"[^a-z]+", word) if t]
        if not words.isdisjoint(parts) and all(t in words or t in beside for t in parts):
            return True
    return False


def _judge(node: Node, attrs: str) -> None:
    """Sets dropped, and suspect: "" or the attribute that speaks against the node ("id", or "class" for class and role)."""
    if node.dropped or node.name in _DROPPED or node.name == "header" and not node.named:
        node.dropped = True
    elif attrs and not attrs.isspace():
        plain = node.name not in ("article", "main")
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id") and _noisy(value, _COMMENT, _BESIDE):
                node.comment = True
            if not plain:
                continue
            if key == "hidden" or key == "style" and _HIDDEN.search(value):
                node.dropped = True
            elif key in ("class", "role") and _noisy(value):
                node.suspect = "class"
            elif key == "id" and not node.suspect and _noisy(value):
                node.suspect = "class" if _noisy(value, _SURE) else "id"


def parse(page: str) -> Node:
    """Block tree; a node's children are nodes and strings (text with inline markup removed, references decoded)."""
    root = Node("body", None)
    at, text, links, pos = root, [], 0, 0

    unclosed: dict[str, int] = {}  # open elements by name: an end tag without its start costs nothing

    def leave(to: Node) -> Node:
        nonlocal at
        while at is not to:
            unclosed[at.name] -= 1
            at = at.parent
        return at

    def put():
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                at.children.append(joined)

    def read(raw: str):
        if raw:
            decoded = html.unescape(raw) if "&" in raw else raw
            text.append(decoded)
            n = len(decoded.strip())
            at.chars += n
            if links:
                at.link_chars += n

    for m in _TOKEN.finditer(page):
        read(page[pos : m.start()])
        pos = m.end()
        name, closing = (m["name"] or m["name2"] or "").lower(), m["close"] or m["close2"]
        if not name:
            if m["raw"] is None and m[0][:4] != "<!--" and m[0][:9].upper() == "<![CDATA[":
                read(m[0][9:].removesuffix("]]>"))
            continue
        if name not in _BLOCKS:
            if name == "br":
                text.append(" ")
            if name == "a":
                if closing:
                    links = max(0, links - 1)
                else:
                    links, at.link_tags = links + 1, at.link_tags + 1
            if not closing:
                at.tags += 1
            continue
        if name in ("html", "body"):
            continue
        put()
        if closing:
            if unclosed.get(name):
                node = at
                while node.name != name:
                    node = node.parent
                leave(node.parent)
                links = 0
            continue
        if name in _CLOSES_P or name in ("td", "th", "tr"):
            node = at
            while node is not root and node.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                node = node.parent
            if node is not at:
                leave(node)
                links = 0
        if at.name == name and name in ("li", "td", "th", "tr", "dd", "dt", "option"):
            leave(at.parent)
        new = Node(name, at, at.dropped)
        _judge(new, m["attrs"] or "")
        at.children.append(new)
        at.tags += 1
        if name not in _VOID:
            at = new
            unclosed[name] = unclosed.get(name, 0) + 1
    read(page[pos:])
    put()
    return root


def _post_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    return order[::-1]


def _density(c: int, t: int, lc: int, lt: int, C: int, LC: int) -> float:
    base = math.log(c / max(c - lc, 1) * lc + LC / C * c + math.e)
    t = max(t, 1)
    ratio = c / max(lc, 1) * t / max(lt, 1)
    return c / t * max(0.0, math.log(ratio) / math.log(base)) if c and ratio > 1 and base > 1 else (c / t * 1e-3)


def _add_up(order: list[Node], own: dict) -> None:
    for node in order:
        node.chars, node.tags, node.link_chars, node.link_tags = own[node]
        for c in node.children:
            if isinstance(c, Node) and not c.dropped:
                node.chars += c.chars
                node.tags += c.tags
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags


def _drop_confirmed(root: Node, order: list[Node]) -> bool:
    found = False
    for node in order:
        if node.suspect and 2 * node.chars > root.chars:
            node.suspect = "" if node.chars > BRIEF else node.suspect
        elif node.suspect and (_mostly_links(node) or node.suspect == "class" and node.name not in _TEXT and node.chars <= min(BRIEF, root.chars / 10)):
            node.dropped = found = True
    return found


def _drop_forms(root: Node, order: list[Node]) -> bool:
    """Forms go, but for one that wraps the page: it holds more than half of the text, in paragraphs or articles."""
    paragraphs: dict[Node, int] = {}
    found = False
    for node in order:
        inside = node.chars if node.name in ("p", "article", "main") else sum(paragraphs.get(c, 0) for c in node.children if isinstance(c, Node))
        paragraphs[node] = inside
        if node.name in _FORMS and not (2 * node.chars > root.chars and inside > BRIEF / 2):
            node.dropped = found = True
    return found


def _drop_comments(root: Node, order: list[Node], own: dict) -> bool:
    """Blocks of reader comments go where other text stays: an article, or more than a brief text that is no suspect's."""
    if not any(node.comment for node in order):
        return False
    rest, article, stack = 0, False, [root]
    while stack:
        node = stack.pop()
        if node.dropped or node.comment or node.suspect and 2 * node.chars <= root.chars:
            continue
        rest += own[node][0] - own[node][2]
        article = article or node.name in ("article", "main") and any(isinstance(c, str) or isinstance(c, Node) and not c.comment and c.chars for c in node.children)
        stack += [c for c in node.children if isinstance(c, Node)]
    if not (rest > BRIEF or article and rest):
        return False
    for node in order:
        node.dropped = node.dropped or node.comment
    return True


def _weigh(root: Node) -> list[Node]:
    order = _post_order(root)
    own = {n: (n.chars, n.tags, n.link_chars, n.link_tags) for n in order}
    _add_up(order, own)
    for drop in (_drop_forms, lambda *a: _drop_comments(*a, own)):
        if drop(root, order):
            order = _post_order(root)
            _add_up(order, own)
    if _drop_confirmed(root, order):
        order = _post_order(root)
        _add_up(order, own)
    C, LC = max(root.chars, 1), root.link_chars
    for node in order:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, C, LC) * (PENALTY if node.suspect else 1.0)
    for node in order:
        c, t, lc, lt = own[node]
        inner = [x for x in node.children if isinstance(x, Node)]
        node.total = sum(x.density for x in inner if not x.dropped)
        if any(isinstance(x, str) for x in node.children):
            node.total += _density(c, t - len(inner), lc, lt, C, LC)
    for node in reversed(order):  # parents first: what is inside a suspect is one
        if node.suspect:
            node.total *= PENALTY
            for c in node.children:
                if isinstance(c, Node) and not c.dropped and not c.suspect and not c.named:
                    c.suspect = "inner"
    return order


def _blocks(node: Node, dropped: bool = False) -> list[str]:
    """Texts of a subtree in order, those of dropped nodes only if asked for."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif dropped or not x.dropped:
            stack += reversed(x.children)
    return out


def _title(order: list[Node]) -> Node | None:
    """The page's only first-level heading, if it is no suspect and not mostly links."""
    found = [n for n in order if n.name == "h1" and n.chars]
    return found[0] if len(found) == 1 and not found[0].suspect and not _mostly_links(found[0]) else None


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, joined by line feeds; a lone first-level heading before it belongs to it."""
    if not page:
        return ""
    root = parse(page)
    order = _weigh(root)
    title = _title(order)
    blocks = _chosen(root, order)
    # every list of blocks is a part of the page in order, so a title that is not in it stands before or after all of it
    if title is not None and blocks and not any(x is y for y in blocks for x in title.children):
        every = _blocks(root, True)
        place = {id(x): k for k, x in enumerate(every)}
        own = _blocks(title, True)
        if own and place.get(id(own[0]), len(every)) < min(place[id(x)] for x in blocks):
            blocks = own + blocks
    return "\n".join(blocks)


def _chosen(root: Node, order: list[Node]) -> list[str]:
    """The blocks of the greatest density sum's subtree and of what joins it."""
    best = max(order, key=lambda n: (n.total * (NAMED if n.name in ("article", "main") else 1.0), n.chars))
    top = best
    if any(isinstance(c, str) or not c.dropped and not c.suspect and c.chars for c in best.children):
        _leave_out(best, None, root.density)
    while top is not root and top.parent is not root and top.parent.density >= root.density:
        _leave_out(top.parent, top, root.density)
        top = top.parent
    if top.parent is not root:
        return _blocks(top)
    text_beside = any(isinstance(c, str) for c in root.children)
    for c in root.children:
        if isinstance(c, Node) and c is not top and not c.dropped:
            undo = 1 / PENALTY if top.suspect and c.suspect else 1.0
            alike = c.name == top.name == "article" and not _mostly_links(c)
            c.dropped = not (alike or text_beside and not _mostly_links(c) and not c.suspect or c.density * undo >= root.density and max(c.total, c.density) * undo >= SHARE * best.total)
    return _blocks(root)


def _mostly_links(node: Node) -> bool:
    return 2 * node.link_chars >= node.chars


def _leave_out(parent: Node, path: Node | None, least: float) -> None:
    for c in parent.children:
        if isinstance(c, Node) and c is not path and (path is not None and _mostly_links(c) or c.suspect == "class" and not c.named and c.density < least):
            c.dropped = True


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages(page_id, url, html)."""
    attach(pages.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
