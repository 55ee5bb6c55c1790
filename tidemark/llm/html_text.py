"""Main text of web pages (operator 3) by tree scoring.

The page becomes a tree (end tags implied as browsers imply them; unclosed and stray tags are borne). Parts that are no
article by their element, role or class name (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts,
styles) are set aside; a form that holds most of the page's paragraphs wraps the page and is kept, and within an article a block
of a doubtful name is kept if it reads like prose. Every paragraph with text passes points, for its length and commas and discounted by its link density, to
its parent in full, to the grandparent by half, and by less further up. The container with most points is taken, widened to an
article or main element around it, and with it those of its siblings that score well or read like text. Their blocks, in
page order, are the result; a block's white space is folded, nothing is cut.

Defined results: null, empty or textless html gives an empty text; a page without paragraphs gives what is left of its body;
repeated rows give equal texts; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*+\"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z))*+)(?:>|\Z)|[^>]*+(?:>|\Z))", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template")}
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split())
DROPPED = frozenset("script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas audio video head title dialog map menu search fieldset label datalist".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: What a start tag ends, and the elements that such an end does not cross.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4".split())
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table figure".split())
#: Fixed words: parts of class, id and role names that mark what is no article, and what is.
AWAY = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies dialog disqus disclaimer footer footnav gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promoted promotion recommended respond shoutbox sidebar sidebars skip sponsor sponsored subscribe toolbar topbar trackback complementary alert".split())
#: Parts of names that mark what is no article unless it stands within one and reads like prose.
DOUBTFUL = frozenset("form login promo related replies reply search share sharing signup social widget widgets".split())
STAY = frozenset("article articlebody body content entry hentry main page post story text".split())
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("anchors", "commas", "direct", "dropped", "inside", "kids", "links", "para", "parent", "score", "size", "tag", "words")

    def __init__(self, tag: str, parent: Node | None, words: frozenset[str], dropped: bool) -> None:
        self.tag, self.parent, self.words, self.dropped = tag, parent, words, dropped
        self.kids: list[Node | str] = []
        self.score = self.direct = 0.0
        self.size = self.links = self.commas = self.anchors = 0
        # whether an article is open here, and which paragraph is
        self.inside: bool = tag in ("article", "main") or parent is not None and parent.inside
        self.para: Node | None = self if tag == "p" else None if parent is None or tag in ("button", "table", "td", "th", "object") else parent.para


def _names(attrs: str) -> tuple[frozenset[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return frozenset(), False
    words: list[str] = []
    hidden = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            words += _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return frozenset(words), hidden


class _Stack:
    """The open elements and, by tag, at which depths they stand."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> Node:
        node = self.nodes.pop()
        self.depths[node.tag].pop()
        return node

    def deepest(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags; 0 if none is open."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def cut(self, depth: int) -> None:
        """Close all from that depth on. Each step pops an element, so all ends cost as much as all starts."""
        while len(self.nodes) > depth:
            self.pop()

    def end(self, tag: str) -> bool:
        """Close the innermost open element of that tag, if its end tag reaches it."""
        depth = self.deepest((tag,))
        if not depth or (tag not in _CROSSING and depth < self.deepest(_SCOPES)):
            return False
        self.cut(depth)
        return True


_SCOPES = frozenset(("td", "th", "table"))
#: End tags that reach beyond a table cell.
_CROSSING = frozenset("table tr tbody thead tfoot body html td th".split())


def parse(html: str) -> Node:
    """The page's tree; entities in its texts are decoded."""
    root = Node("#root", None, frozenset(), False)
    open_ = _Stack(root)
    forms: list[Node] = []
    doubtful: list[Node] = []
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            open_.top.kids.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                open_.top.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            if not open_.end(tag) and tag == "br":
                open_.top.kids.append(" ")
            continue
        if tag == "br":
            open_.top.kids.append(" ")
            continue
        if tag in ("html", "body") and open_.deepest((tag,)):
            continue
        if tag in CLOSES_P and open_.top.para is not None:
            open_.cut(open_.deepest(("p",)))
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            while (depth := open_.deepest(ends)) > open_.deepest(stop):
                open_.cut(depth)
        if tag in HEADINGS and open_.top.tag in HEADINGS:
            open_.pop()
        if tag == "body":  # ends an unclosed head
            open_.end("head")
        node = open_.top
        words, hidden = _names(attrs)
        off = tag in DROPPED or hidden or (tag == "header" and not node.inside) or (tag not in ("html", "body", "article", "main") and bool(words & AWAY) and not (words & STAY and not words & {"ad", "ads", "comment", "comments", "sidebar", "footer", "nav", "menu", "related", "cookie"}))
        # a paragraph of an article whose long name merely holds such a word is judged as prose
        named = off and not hidden and node.inside and tag in ("p", "blockquote", "h2", "h3", "h4") and len(words) > 2
        off = off and not named
        unsure = named or not off and tag not in ("html", "body", "article", "main") and bool(words & DOUBTFUL) and not words & STAY
        new = Node(tag, node, words, off or unsure)
        if unsure:
            doubtful.append(new)
        elif tag == "form" and not hidden and not words & AWAY:
            forms.append(new)
        node.kids.append(new)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = html.find(">", end.end()) + 1 if end else n
            at = at or n
        elif tag not in VOID and not attrs.endswith("/") or tag in ("p", "div", "li", "article", "section", "td", "a", "b", "span"):
            open_.push(new)
    _readmit(root, forms, doubtful)
    return root


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _readmit(root: Node, forms: list[Node], doubtful: list[Node]) -> None:
    """Keep the forms that hold most of the page's paragraph text, and the doubtful blocks of an article that read like prose."""
    if not forms and not doubtful:
        return
    # paragraph text and link text below each element; what lies in dropped parts counts for the doubtful part around it alone
    prose: dict[int, list[int]] = {}
    maybe = {id(x) for x in (*forms, *doubtful)}
    order, todo = [], [(root, False)]
    while todo:
        x, para = todo.pop()
        if x.dropped and id(x) not in maybe:
            continue
        para |= x.tag in PARAGRAPHS
        order.append((x, para))
        todo += [(k, para) for k in x.kids if not isinstance(k, str)]
    for x, para in reversed(order):
        text = sum(len(" ".join(k.split())) for k in x.kids if isinstance(k, str))
        own = [text if para else 0, text if x.tag == "a" else 0, text]
        for k in x.kids:
            if not isinstance(k, str) and (below := prose.get(id(k))):
                own = [a + b for a, b in zip(own, below, strict=True)]
        if x.tag == "a":
            own[1] = own[2]
        prose[id(x)] = own
    whole = prose[id(root)][0]
    for x in doubtful:
        para, links, text = prose.get(id(x), (0, 0, 0))
        x.dropped = not (x.parent is not None and x.parent.inside and para >= 25 and links < 0.5 * text)
    for x in forms:
        para = prose.get(id(x), (0, 0, 0))[0]
        x.dropped = not (para >= 25 and para > whole - para)


def _open(node: Node, tag: str) -> Iterator[Node]:
    """The innermost open element of that tag, if any."""
    while node.parent is not None:
        if node.tag == tag:
            yield node
            return
        node = node.parent


def _walk(node: Node) -> Iterator[Node]:
    """Kept elements in page order, without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [k for k in reversed(x.kids) if not isinstance(k, str) and not k.dropped]


def _measure(root: Node) -> list[Node]:
    """Sets size, links and commas of every kept element."""
    order = list(_walk(root))
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                x.size += len(" ".join(k.split()))
                x.commas += k.count(",") + k.count("，") + k.count("、")
            elif not k.dropped:
                x.size += k.size
                x.links += k.size if k.tag == "a" else k.links
                x.anchors += (k.tag == "a") + k.anchors
                x.commas += k.commas
    return order


def density(x: Node) -> float:
    return min(1.0, x.links / x.size) if x.size else 0.0


def _is_paragraph(x: Node) -> bool:
    return x.tag in PARAGRAPHS or x.tag in ("div", "section", "article", "main", "body", "#root") and any(isinstance(k, str) and not k.isspace() for k in x.kids)


def choose(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    order = _measure(root)
    scored: list[Node] = []
    for x in order:
        if not _is_paragraph(x) or not x.size:
            continue
        own = x.size if x.tag in PARAGRAPHS else sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        points = (1 + x.commas + min(own / 100, 3)) * (1 - density(x)) * (1 if own >= 25 else 0.1)
        up, level = (x.parent if x.tag in PARAGRAPHS else x), 0
        while up is not None and level < 5:
            if not up.score:
                scored.append(up)
                bonus = {"article": 10, "main": 8, "section": 1, "pre": 3, "blockquote": 1}.get(up.tag, 0)
                up.score += 1e-9 + bonus + (5 if up.words & STAY else 0)
            up.score += points / (1, 2, 6, 9, 12)[level]
            up.direct += points * (level == 0)
            up, level = up.parent, level + 1
    scored = [x for x in scored if x.tag not in ("tr", "ul", "ol", "dl")]
    if not scored:
        return [root]
    best = max(scored, key=lambda x: x.score * (1 - density(x)))
    for up in (up for t in ("article", "main") for up in _open(best, t)):
        if up is not best:
            best = up
            break
    while best.parent is not None and best.tag in ("p", "li", "td", "h2", "h3", "h4", "tbody", "table"):
        best = best.parent
    if best.tag not in ("article", "main") and (parts := _parts(best, order)):
        return parts
    if best.parent is None:
        return [best]
    kept = []
    for k in best.parent.kids:
        if isinstance(k, str) or k.dropped:
            continue
        alike = k.score * (1 - density(k)) >= max(10, 0.2 * best.score)
        text = k.tag in TEXTUAL and k.size and density(k) < 0.33 and best.tag != "main"
        if k is best or alike or text:
            kept.append(k)
    return kept


def _parts(best: Node, order: list[Node]) -> list[Node]:
    """An article without an element of its own may be spread over wrappers: the children of the smallest element that holds all containers
    with a fifth of the points that paragraphs pass directly to the best of them, from the first to the last of these, and texts beside
    them. Nothing if they all lie in the best container."""
    least = 0.2 * max(x.direct * (1 - density(x)) for x in _walk(best))
    if least <= 0:
        return []
    # containers below each element, in one pass
    held: dict[int, int] = {}
    for x in reversed(order):
        n = int(x is best or x.direct * (1 - density(x)) >= least and density(x) < 0.5) + sum(held.get(id(k), 0) for k in x.kids if not isinstance(k, str))
        if n:
            held[id(x)] = n
    top, whole = order[0], held[id(order[0])]
    if held[id(best)] == whole:
        return []
    while inner := [k for k in top.kids if not isinstance(k, str) and held.get(id(k)) == whole]:
        top = inner[0]
    if top.direct * (1 - density(top)) >= least:  # it has text of its own
        return [top]
    kids = [k for k in top.kids if not isinstance(k, str) and not k.dropped]
    at = [i for i, k in enumerate(kids) if id(k) in held]
    return [k for i, k in enumerate(kids) if at[0] <= i <= at[-1] or k.tag in TEXTUAL and k.size and density(k) < 0.33]


def _is_menu(x: Node) -> bool:
    """A block of short links outside articles. Lists of references within an article are text."""
    return not x.inside and x.tag in ("ul", "ol", "div", "section", "dl", "table") and density(x) > 0.6 and x.anchors > 1 and x.links < 40 * x.anchors


def blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of the blocks below nodes, in page order."""
    buffer: list[str] = []
    chosen = {id(x) for x in nodes}
    todo: list[Node | str | None] = list(reversed(nodes))

    def flush() -> Iterator[str]:
        if text := " ".join("".join(buffer).split()):
            yield text
        buffer.clear()

    while todo:
        x = todo.pop()
        if x is None:
            yield from flush()
        elif isinstance(x, str):
            buffer.append(x)
        elif not x.dropped and (id(x) in chosen or not _is_menu(x)):
            block = x.tag in BLOCK or x.tag == "#root"
            if block:
                yield from flush()
                todo.append(None)
            todo += reversed(x.kids)
    yield from flush()


def main_text(html: str | None) -> str:
    return "\n".join(blocks(choose(parse(html)))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
