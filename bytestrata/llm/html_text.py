"""HTML extraction by tree scoring: the main text of a page.

A forgiving parser, which reads tags and attributes as the HTML standard's tokeniser does, builds the element tree of the
whole page. Every text block passes points to its ancestors, one for being there, one per comma and up to three for its
length, times one less its link density: all of them to its parent, and each ancestor passes on half of what it gets, up to the root. A container's score is
its points with a prior for its element and class, times one less its link density. The whole article or main element about
the best container is kept; without one, the container and all prose beside it and its ancestors that isn't mainly links,
bare text too.

Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers and hidden elements are cut off before, by
element, role and class. A class or id counts only if it names the element: not if it states a layout (``no-sidebar``,
``comments-open``), not on a wrapper of the page, and names that parts of an article have too (a section ``discussion`` or
``related``) only where its content isn't prose under a heading. A page that would be left empty is read again without names.

Each page is a row of its own: no shuffle, memory of one batch of pages.

Defined results: a null, empty or textless page gives an empty text; references are decoded once; white space, of any
kind that Unicode knows, becomes one space inside a block; blocks are joined in page order; formulas are text in a line;
nothing is capped. Repeated rows and rows without page_id give a row each; an empty table gives no rows; further columns of
the input play no part.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript iframe template noembed noframes head title nav header footer aside form button select textarea input fieldset dialog menu menuitem object embed svg annotation annotation-xml canvas audio video map".split())
#: Elements that a start tag of the key closes when they are open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
#: What such a start tag doesn't look beyond.
WALLS = frozenset("ul ol dl table div section article main body html td th blockquote select".split())

_UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|popup|modal|overlay|cookies?|consent|gdpr|notice|alert|newsletter|subscribe|signup|comments?|commentlist|disqus|discussion|respond|replies|sidebar|aside|widget|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|outbrain|taboola|login|search|skip|hidden|print-only)(?:$|[\s_-])",
    re.I,
)
#: Names that state the layout of a wrapper, not what it is.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:(?:no|not|has|have|with|without|show|hide|is|enable|disable)[_-]\w+(?:[_-]\w+)*|\w+[_-](?:open|opened|closed|enabled|disabled|on|off|active|inactive|left|right|none))(?=$|\s)", re.I)
#: Unlikely names that sections of an article have too.
_EITHER = re.compile(r"(?:^|[\s_-])(?:discussion|related|recommend\w*|search|share|sharing|social|notice|alert)(?:$|[\s_-])", re.I)
#: Names of what holds no article, however long it is.
_NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|cookies?|consent|gdpr|newsletter|outbrain|taboola|disqus|comments?|commentlist|discussion|respond|replies)(?:$|[\s_-])", re.I)
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|body|post|entry|story|text|blog|hentry)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_PRIOR = {"article": 30.0, "main": 25.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 1.0, "body": 0.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -1.0}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))


#: Beside the best container these are kept as they are, and of the rest what has a clause or sentence.
_TEXTS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table".split())
_SENTENCE = re.compile(r"\w[\w)\"'»”’]*[.!?…,;:。！？，、]")


class Node:
    __slots__ = ("attrs", "children", "cut", "links", "parent", "points", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.attrs, self.children = tag, parent, attrs, []
        self.points, self.text, self.links, self.cut = 0.0, 0, 0, False


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    found = {}
    for name, a, b, c in _ATTR.findall(raw):
        name = name.lower()
        if name in _READ and name not in found:
            found[name] = html.unescape(a or b or c)
    return found


def parse(page: str) -> Node:
    """The element tree; a child is a Node or a decoded text."""
    root = Node("html", None, {})
    here, at, size = root, 0, len(page)
    low = None

    def add(text: str) -> None:
        if text:
            here.children.append(html.unescape(text) if "&" in text else text)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            # a sign that opens no tag, or a tag that never ends: the latter is dropped with what follows
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]) and page.find(">", lt) < 0:
                add(page[at:lt])
                at = size
                break
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = root  # an inline end tag closes no block
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag == "br":
                here.children.append(" ")
            continue
        if tag in ("html", "body") and here is root and tag == "html":
            root.attrs = root.attrs or _attributes(m[3])
            continue
        if tag not in INLINE and tag not in VOID:
            up = here
            while up is not root and up.tag != "p" and (up.tag in INLINE):
                up = up.parent
            if up is not root and up.tag == "p":
                here = up.parent  # a block ends an open paragraph
            if tag in CLOSES:
                up, walls = here, WALLS - CLOSES[tag]
                last = None
                while up is not root and up.tag not in walls:
                    if up.tag in CLOSES[tag]:
                        last = up
                    up = up.parent
                if last:
                    here = last.parent
        node = Node(tag, here, _attributes(m[3]))
        here.children.append(node)
        if tag in RAW:
            low = low or page.lower()
            if len(low) != size:  # lower case may change the length
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = low.find(f"</{tag}", at)
            at = size if end < 0 else (page.find(">", end) + 1 or size)
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
        elif tag not in VOID and tag not in ("svg", "math", "path"):
            here = node  # a slash doesn't close an HTML element
    if at < size:
        add(page[at:])
    return root


def _cut(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    attrs = node.attrs
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""))))


def _named(node: Node) -> str:
    """The class and id of an element that go with what isn't the article; else an empty text."""
    if not node.attrs or node.tag in ("article", "main", "body", "html"):
        return ""
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")
    if not _UNLIKELY.search(names):
        return ""
    names = _LAYOUT.sub(" ", names)
    return names if _UNLIKELY.search(names) and not re.search(r"\b(?:article|main|post|entry)[-_]?(?:body|content|text)\b", names, re.I) else ""


def _is_section(node: Node, names: str) -> bool:
    """Whether an element with a name of either kind is a part of an article: prose under a heading, inside an article."""
    if _UNLIKELY.search(_EITHER.sub(" ", names)) or not any(isinstance(x, Node) and re.fullmatch("h[1-6]", x.tag) for x in node.children):
        return False
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None and node.links < node.text / 4 and bool(_SENTENCE.search(_blocks([x for x in node.children if isinstance(x, Node) and x.tag in ("p", "div", "section", "blockquote")])))


def _prepare(root: Node, by_name: bool = True) -> list[Node]:
    """Mark what is cut off, by name too if asked for; all nodes that stay, parents first.

    A name alone cuts off no wrapper of the page: an element with a main in it, or with more than half of the page's text
    outside links; one named after comments or adverts only if it holds an h1 too, as those may be longer than the article.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.cut = _cut(node)
        if not node.cut:
            order.append(node)
            todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    suspects = {id(x): names for x in order if (names := _named(x))} if by_name else {}
    if not suspects:
        return order
    _measure(order)
    holds: dict[int, set[str]] = {}
    for node in reversed(order):
        own = holds.pop(id(node), set()) if id(node) not in suspects else holds.get(id(node), set())
        up = own | {node.tag} if node.tag in ("main", "h1") else own
        if up and node.parent is not None:
            holds.setdefault(id(node.parent), set()).update(up)
    half = (root.text - root.links) / 2
    for node in order:
        if names := suspects.get(id(node)):
            inside = holds.get(id(node), set())
            larger = node.text - node.links > half and ("h1" in inside or not _NEVER.search(names))
            node.cut = "main" not in inside and not larger and not _is_section(node, names)
    out: list[Node] = []
    gone: set[int] = set()
    for node in order:
        if node.cut or id(node.parent) in gone:
            gone.add(id(node))
        else:
            out.append(node)
    return out


def _measure(order: list[Node]) -> None:
    """Characters, and those in links, under each node."""
    for node in reversed(order):
        own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        node.text = own + sum(x.text for x in node.children if isinstance(x, Node) and not x.cut)
        node.links = node.text if node.tag == "a" else sum(x.links for x in node.children if isinstance(x, Node) and not x.cut)


def _own_text(node: Node) -> str:
    """The text of a block without the blocks inside it."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or (x.tag in INLINE and not x.cut):
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def _score(node: Node) -> float:
    prior = _PRIOR.get(node.tag, 0.0)
    if node.attrs and _LIKELY.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"):
        prior += 25.0
    return (node.points + prior * (node.text > 0)) * (1 - (node.links / node.text if node.text else 0.0))


def _blocks(nodes: list[Node]) -> str:
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.cut:
            if x.tag in VOID:
                parts.append("" if x.tag in ("wbr", "img") else " ")
            elif x.tag in INLINE:
                todo += reversed(x.children)
            else:
                todo += [" ", *reversed(x.children), " "]
    return " ".join("".join(parts).split())


def _prose(nodes: list[Node | str]) -> bool:
    """Whether these children of one container, a block or a run of text and inline elements, are text and not mainly links."""
    size = sum(len(x.strip()) if isinstance(x, str) else x.text * (not x.cut) for x in nodes)
    links = sum(x.links for x in nodes if isinstance(x, Node) and not x.cut)
    if not size:
        return False
    if len(nodes) == 1 and isinstance(nodes[0], Node) and nodes[0].tag in _TEXTS:
        return links / size < 0.25
    return links / size < 0.3 and bool(_SENTENCE.search(_blocks(nodes)))


def _around(best: Node) -> list[Node | str]:
    """What belongs to the best container: the whole article or main element about it, or else the prose beside it and its ancestors."""
    whole, up = None, best
    while up is not None:
        whole, up = up if up.tag in ("article", "main") else whole, up.parent
    if whole:
        return [whole]
    kept: deque[Node | str] = deque([best])
    while best.parent is not None and best.tag not in ("body", "html"):
        runs: list[list[Node | str]] = []
        loose = False
        for x in best.parent.children:
            inline = isinstance(x, str) or x.tag in INLINE or x.tag in VOID
            if inline and loose:
                runs[-1].append(x)
            else:
                runs.append([x])
            loose = inline
        at = next(k for k, run in enumerate(runs) if run[0] is best)
        for run in reversed(runs[:at]):
            if _prose(run):
                kept.extendleft([" ", *reversed(run), " "])
        for run in runs[at + 1 :]:
            if _prose(run):
                kept.extend([" ", *run, " "])
        best = best.parent
    return list(kept)


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    return _main_text(root, True) or _main_text(root, False)


_PARAGRAPHS = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6".split())


def _main_text(root: Node, by_name: bool) -> str:
    order = _prepare(root, by_name)
    _measure(order)
    for node in order:
        node.points = 0.0
    for node in reversed(order):  # children before parents
        if node.tag in INLINE or node.tag in VOID or node.parent is None:
            passed = node.points  # an inline element hands on what it got
        else:
            text = _own_text(node)
            own = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - node.links / node.text) if text and node.text else 0.0
            if node.tag in _PARAGRAPHS:
                passed = own + node.points / 2
            else:
                node.points += own  # text that stands in a container itself
                passed = node.points / 2
        if node.parent is not None:
            node.parent.points += passed
    holders = [x for x in order if x.text and x.tag not in INLINE and x.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre")]
    if not holders:
        return _blocks([root])
    best = max(holders, key=_score)
    while best.tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "dd", "dt") and best.parent:
        best = best.parent  # the parts of a table belong together
    return _blocks(_around(best))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            texts = [main_text(x.as_py()) for x in some.column("html")]
            yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
