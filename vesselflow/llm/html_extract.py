"""Main-text extraction from raw HTML by tree scoring.

Each page is parsed to a small tree (implied ends of paragraphs, items and cells; raw script and style text;
unclosed and truncated markup).  Boilerplate is cut by tag, role, visibility and class or id name; headings, and an article's
paragraphs and sections, are not cut by a name without high link density or little text.  Every
remaining paragraph passes points for its length and commas to its ancestors, less with distance; an
ancestor's score is discounted by its link density.  The best container is kept (the article or main
element around it, if there is one), and with it the siblings that score like it or read like text.

Pages are independent: the work is a map over the table and needs no shuffle.

Defined results: null or empty html gives an empty text; a page without any scored paragraph gives the body without
its boilerplate; a null id or url passes through; repeated rows are extracted alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import workers

# Fixed values of HTML and of page conventions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot "
                  "thead tr ul".split())
CUT_TAGS = frozenset("nav footer aside form button select option input label fieldset dialog menu svg canvas object embed audio video head "
                     "search map".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
                      "cookie cookies copyright dfp disqus discussion feedback foot footer gdpr head header login masthead menu menus modal "
                      "nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted "
                      "promotion recommended related replies reply respond share sharing sidebar signin signup skyscraper social sponsor "
                      "sponsored subscribe subscription tags toolbar topbar widget widgets".split())
# Cut names that articles use for parts of their own as well.
LOOSE_NAMES = frozenset("discussion feedback notice notices overlay promotion related replies reply respond social tags widget widgets".split())
TOP_NAMES = frozenset("banner head header masthead topbar".split())
COMMENT_NAMES = frozenset("comments commentlist disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
KEEP_NAMES = frozenset("has with without no wrapper wrap layout page".split())
GOOD_NAMES = frozenset("article body content entry main post story text".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select")
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("p li b a i em strong span".split())       # their closing tags do not reach beyond a container
STOPS = frozenset("ul ol dl table article section div main body td th blockquote".split())

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*+>?|<[a-zA-Z][^>]*+\Z""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "attrs", "up", "kids", "score", "scored", "size", "linked", "inside", "head", "block")

    def __init__(self, tag: str, attrs: str, up: "Node | None"):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []
        self.score, self.scored, self.size, self.linked = 0.0, False, 0, 0
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))     # below an article or main element
        self.head = self.block = False       # a headline, a block below it (known once measured)


class _Open:
    """The open elements from the root down, with the places of every tag, so that no tag walks the path."""

    def __init__(self, root: Node):
        self.path, self.places, self.blocks, self.stops = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        at = len(self.path)
        self.path.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK or node.tag in ("td", "th"):
            self.blocks.append(at)
        if node.tag in STOPS:
            self.stops.append(at)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.path) > at:
            self.places[self.path.pop().tag].pop()
        for places in (self.blocks, self.stops):
            while places[-1] >= at:
                places.pop()


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    opened = _Open(root)
    path = opened.path
    pos, end = 0, len(page)
    while pos < end:
        m = _TAG.search(page, pos)
        if m is None:
            path[-1].kids.append(html.unescape(page[pos:]))
            break
        if m.start() > pos:
            path[-1].kids.append(html.unescape(page[pos:m.start()]))
        pos = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            at = opened.last(tag)
            if at and (tag not in INLINE or at > opened.stops[-1]):
                opened.close(at)
            elif tag == "br":
                path[-1].kids.append(Node("br", "", path[-1]))
            continue
        if tag in BLOCK:                     # a block ends an open paragraph, whatever inline tags it left open
            at = opened.blocks[-1]
            if path[at].tag == "p" or tag in TITLES and path[at].tag in TITLES:
                opened.close(at)
        if tag in CLOSES:
            at = max(map(opened.last, CLOSES[tag]))
            if at and at > max(map(opened.last, LISTS)):
                opened.close(at)
        attrs = m.group(3)
        node = Node(tag, attrs, path[-1])
        path[-1].kids.append(node)
        if tag in RAW:
            close = _END[tag].search(page, pos)
            pos = close.end() if close else end
        elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            opened.push(node)
    return root


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _names(a: dict[str, str]) -> list[list[str]]:
    return [[x.lower() for x in _NAME.findall(name)] for name in (a.get("class", "") + " " + a.get("id", "")).split()]


def _boilerplate(node: Node) -> bool:
    tag = node.tag
    if tag in CUT_TAGS or tag in RAW:
        return True
    if tag == "header":                      # the headline block of an article stays
        return not node.inside or not any(isinstance(k, Node) and k.tag in ("h1", "h2", "hgroup") for k in node.kids)
    if not node.attrs or tag in ("html", "body", "article", "main"):
        return False
    a = _attributes(node.attrs)
    if a.get("role", "").lower() in CUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or _HIDE.search(a.get("style", "")):
        return True
    return tag not in HEADINGS and _named(node, a)


def _named(node: Node, a: dict[str, str]) -> bool:
    """Whether a class or id name and the measured text say boilerplate; a name alone does not cut an article's own parts."""
    inside = node.inside
    dense, few = 2 * node.linked > node.size, node.size - node.linked < 100
    for kind in ("class", "id"):
        for n in _names({kind: a.get(kind, "")}):
            hit = CUT_NAMES.intersection(n)
            if not hit or not KEEP_NAMES.isdisjoint(n) or hit <= TOP_NAMES and (inside or not GOOD_NAMES.isdisjoint(n)) and node.head:
                continue
            whole = len(hit) == len(set(n))
            match = whole or n[-1] in CUT_NAMES
            sure = not hit <= LOOSE_NAMES
            if node.tag == "p" or node.tag == "section" and inside:
                if match and dense or whole and (not hit.isdisjoint(COMMENT_NAMES) and node.tag != "p" or few and sure and kind == "class"):
                    return True
            elif dense or (match or few if sure else whole and few and not (inside and node.head)):
                return True
    return False


def _measure(root: Node) -> None:
    """Cut boilerplate; sizes of text and of linked text, headlines and blocks below each node; children before parents."""
    stack = [(root, False, False)]
    while stack:
        node, linked, ready = stack.pop()
        if not ready:
            linked = linked or node.tag == "a"
            node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in CUT_TAGS and k.tag not in RAW]
            stack.append((node, linked, True))
            stack.extend((k, linked, False) for k in node.kids if isinstance(k, Node))
            continue
        kids = []
        for k in node.kids:
            if isinstance(k, str):
                n = len("".join(k.split()))
                node.size += n
                node.linked += n if linked else 0
            elif _boilerplate(k):
                continue
            else:
                node.size += k.size
                node.linked += k.linked
                node.head = node.head or k.head or k.tag in ("h1", "h2", "hgroup")
                node.block = node.block or k.block or k.tag in BLOCK
            kids.append(k)
        node.kids = kids


def _text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k is not node and (k.tag in ("br", "td", "th") or k.tag in BLOCK and not k.size):
            out.append(" ")
        else:
            stack.extend(reversed(k.kids))
    return "".join(out)


def _score(root: Node) -> list[Node]:
    """Ancestors that a paragraph gave points to, in page order."""
    scored, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.up is None or node.block or not (node.tag in BLOCK or node.tag in ("td", "th")):
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and k.size)
            continue
        t = " ".join(_text(node).split())
        points = 1 + t.count(",") + min(len(t) / 100, 3)
        points *= 1 - node.linked / node.size
        up, share = node.up, 1.0
        for level in range(4):
            if up is None or up.tag == "#root":
                break
            if not up.scored:
                up.scored = True
                scored.append(up)
                names = [x for n in _names(_attributes(up.attrs)) for x in n] if up.attrs else []
                up.score = (25.0 if up.tag in ("article", "main") else 0.0) + (10.0 if not GOOD_NAMES.isdisjoint(names) else 0.0)
            up.score += points * share
            up, share = up.up, 0.5 if level == 0 else share / 2
    return scored


def _flat(nodes: list) -> str:
    """The blocks below these nodes, one a line; a cell or a break is a space, both ends of a block end a line."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        t = " ".join("".join(held).split())
        if t:
            out.append(t)
        held.clear()

    stack: list = list(reversed(nodes))
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            held.append(k)
        else:
            if k.tag in BLOCK:
                flush()
                stack.append(None)
            elif k.tag in ("br", "td", "th"):
                held.append(" ")
                stack.append(" ")
            stack.extend(reversed(k.kids))
    flush()
    return "\n".join(out)


def _wrapped(node: Node) -> float:
    """The best score, less by links, of a node and of the only children with text below it."""
    top = 0.0
    while True:
        top = max(top, node.score * (1 - node.linked / node.size) if node.scored else 0.0)
        kids = [k for k in node.kids if isinstance(k, Node) and k.size == node.size]
        if not kids:
            return top
        node = kids[0]


def main_text(page: str | None) -> str:
    """The article of one page, however deep its elements nest."""
    if not page:
        return ""
    root = parse(page)
    _measure(root)
    scored = _score(root)
    if not scored:
        return _flat([root])
    best = max(scored, key=lambda n: n.score * (1 - n.linked / n.size))       # the first of equals, in page order
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.up
    if best.tag in ("html", "body") or best.up is None:
        return _flat([best])
    top = _wrapped(best)
    while best.up.size == best.size and best.tag not in ("article", "main") and best.up.tag not in ("html", "body", "#root"):
        best = best.up                               # a wrapper without other text: its siblings are the blocks
    keep = []
    for k in best.up.kids:
        if k is best:
            keep.append(k)
        elif isinstance(k, Node) and k.size and best.tag not in ("main",):
            density = k.linked / k.size
            t = " ".join(_text(k).split())
            if _wrapped(k) >= max(10.0, 0.2 * top) and not (best.tag == "article" and k.tag not in ("article", "section")):
                keep.append(k)
            elif k.tag == "p" and (len(t) > 80 and density < 0.25 or not density and re.search(r"[.!?](\s|$)", t)):
                keep.append(k)
    return _flat(keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    workers(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
