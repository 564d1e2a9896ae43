"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree (void elements, elements closed by the next of their kind, unclosed
and stray tags). What never holds the article goes with all below it: elements of DROPPED_TAGS, by role, or hidden.
Names of classes and ids only raise a suspicion, which the element's own text settles (see _is_junk): a name
such as `comments-open` or `page-with-sidebar` costs nothing if prose is below it, and a form goes unless it wraps the page.

Then each paragraph passes points to its ancestors: one, one for each comma, and
one for each hundred characters up to three; the parent gets all, the grandparent half, those above a share
that falls with distance. Containers start with points for their tag and names, and a container's sum is
discounted by its link density (characters in links over characters). The best container is widened to the
<article> or <main> around it. Siblings that score well or read like prose are kept with it, and so are headings
before and headings, lists, quotes, tables and sections between them; if no first-order heading is among all that,
the nearest one above the container is.

Every text run between block boundaries is a block: character references are decoded, white space becomes
one space, ends are trimmed, empty blocks go, and blocks are joined in page order by a line feed.

Defined results: a null or empty page, or one with nothing but what is always dropped, gives an empty text; where
suspicion leaves nothing, the page is read without it; a very long or deep page is read whole, without recursion; equal
scores go to the container that comes first; rows repeated are extracted each; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    # Quotes may hold a ">"; where they don't pair up, the next ">" ends the tag.
    r"|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot "
    "thead tr ul video audio".split()
)
CLOSES_P = BLOCK - frozenset("option optgroup caption tbody tfoot thead tr legend".split())
#: An element that the start of another ends, up to a boundary.
ENDED_BY_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED_TAGS = frozenset(
    "head script style noscript template iframe nav footer aside button select textarea input label menu dialog svg "
    "canvas object applet audio video map noembed noframes xmp title".split()
)
FORM_TAGS = frozenset("form fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that say what doesn't belong to the article: reader comments; adverts and notices; other page parts.
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
ADVERT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense consent cookie cookies gdpr newsletter outbrain promo promoted promotion "
    "sponsor sponsored taboola".split()
)
PART_WORDS = frozenset(
    "banner breadcrumb breadcrumbs login menu modal nav navbar navigation pager pagination paywall popup related share sharing sidebar "
    "signup social subscribe subscription toolbar widget widgets".split()
)
#: Words that say so only if nothing in the same name speaks of content.
MAYBE_WORDS = frozenset("alert aside bar bottom extra foot footer form head header masthead message meta notice notification search tags tool top warning".split())
CONTENT = frozenset("article blog body column content entry hentry main page post story text".split())
#: Words that don't change what a name says.
PLAIN_WORDS = frozenset(
    "area block box button buttons center container global group holder inner item items layer left line link links list local outer overlay "
    "panel posts primary right row rows secondary section section site slot thread unit user view wrap wrapper".split()
)
NEVER_DROPPED = frozenset("html body main".split())
#: Words that make a name say what an element has or shows elsewhere.
_MODIFIERS = frozenset("has have with without no is not hide show".split())
#: Characters, outside links, of a block that is prose; shares of the page's prose that clear a name.
PROSE, MOST, MUCH = 80, 0.5, 0.25
COMMENTS, PART, ADVERT_HINT, HINT, MAYBE, FORM = range(1, 7)
_TAG_POINTS = {"article": 10, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3}
_PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary caption".split())


#: Ancestors that a paragraph's points reach.
LEVELS = 6


def suspicion(name: str) -> int:
    """What the name of a class or id says about its element."""
    words = [w for w in map(str.lower, _NAME_WORDS.findall(name)) if not w.isdigit()]
    if _MODIFIERS & set(words):
        return 0
    sure = ADVERT_WORDS | PART_WORDS
    if all(w in sure or w in COMMENT_WORDS or w in MAYBE_WORDS or w in PLAIN_WORDS or w in CONTENT for w in words):
        if COMMENT_WORDS & set(words):
            return COMMENTS
        if sure & set(words):
            return PART
        return MAYBE if MAYBE_WORDS & set(words) and not CONTENT & set(words) else 0
    if (ADVERT_WORDS | COMMENT_WORDS) & set(words):
        return ADVERT_HINT
    return HINT if PART_WORDS & set(words) else 0


class Node:
    __slots__ = ("tag", "parent", "children", "names", "dropped", "suspect", "score", "chars", "linked", "prose", "own", "holds")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.names: set[str] = set()
        self.dropped = tag in DROPPED_TAGS
        self.suspect = FORM if tag in FORM_TAGS else 0
        self.score = self.chars = self.linked = 0.0
        #: Prose in and below, unlinked characters of a block's own, and whether an article, main or heading is below.
        self.prose, self.own, self.holds = 0, 0, frozenset()
        if attributes and "=" in attributes or "hidden" in attributes:
            self._look(attributes)

    def _look(self, attributes: str) -> None:
        found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
        seen = set()
        for name in f"{found.get('class', '')} {found.get('id', '')}".split():
            seen.add(suspicion(name))
            self.names.update(w.lower() for w in _NAME_WORDS.findall(name))
        if self.tag in NEVER_DROPPED:
            return
        style = found.get("style", "").replace(" ", "").lower()
        if (
            "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
            or "display:none" in style
            or "visibility:hidden" in style
            or found.get("role", "").lower() in DROPPED_ROLES
        ):
            self.dropped = True
        if self.names & CONTENT:
            seen.discard(MAYBE)
        if self.tag == "article":
            seen -= {HINT, ADVERT_HINT, MAYBE}
        self.suspect = min(seen - {0}, default=self.suspect)


def parse(page: str) -> Node:
    root = node = Node("#root", None)
    at, end, last = 0, len(page), page.rfind(">") + 1
    while at < end:
        m = _TOKEN.search(page, at) if at < last or page.find("<!", at) >= 0 else None
        if not m:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not root and up.tag != tag:
                # An inline end tag doesn't close the block around it.
                if up.tag in BLOCK and tag not in BLOCK and tag not in ("td", "th"):
                    up = root
                else:
                    up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in CLOSES_P:
            up = node
            while up is not root and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in ENDED_BY_SIBLING:
            ended, border = ENDED_BY_SIBLING[tag]
            up = node
            while up is not root and up.tag not in ended and up.tag not in border:
                up = up.parent
            if up.tag in ended:
                node = up.parent
        new = Node(tag, node, m[3] or m[4] or "")
        node.children.append(new)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        node = new
    return root


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _is_junk(node: Node, root: Node, inside: bool) -> bool:
    """Whether the suspicion against a node holds, by the text below it."""
    share = node.prose / root.prose if root.prose else node.chars / (root.chars or 1)
    if node.tag == "article" and node.suspect != COMMENTS or inside and node.suspect == MAYBE and "h1" in node.holds:
        return False
    if node.suspect == COMMENTS:
        return "article" not in node.holds
    if node.suspect == PART:
        return share <= MOST and "article" not in node.holds
    if node.suspect == HINT:
        return not node.prose or node.linked * 3 > node.chars
    return share < MUCH or node.suspect == FORM and not node.prose and share <= MOST


def _is_page_header(node: Node, inside: bool) -> bool:
    """A <header> that isn't the article's: inside is whether an article or main is around it."""
    if inside:
        return False
    parts = {c.tag for c in node.parent.children if isinstance(c, Node)}
    return node.parent.tag in ("#root", "html", "body", "form") or not node.holds & {"h1", "h2", "h3"} or bool(node.holds & {"nav", "form"}) or bool(parts & {"footer", "nav"})


def _judge(root: Node) -> None:
    """Settle for each node whether it is dropped."""
    order: list[Node] = []
    stack: list[tuple[Node, Node, bool]] = [(root, root, False)]
    while stack:
        node, block, linked = stack.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        if node.tag in BLOCK or node.tag in _PARAGRAPHS:
            block = node
        for child in node.children:
            if isinstance(child, str):
                n = len(child.strip())
                node.chars += n
                if linked:
                    node.linked += n
                else:
                    block.own += n
            elif not child.dropped:
                stack.append((child, block, linked))
    for node in reversed(order):
        node.prose += node.own if node.own >= PROSE else 0
        if any(isinstance(c, Node) and c.tag == "nav" for c in node.children):
            node.holds = node.holds | {"nav"}
        if (up := node.parent) is not None:
            up.chars, up.linked = up.chars + node.chars, up.linked + node.linked
            if node.suspect != COMMENTS or "article" in node.holds:
                up.prose += node.prose
            mine = {"article"} if node.tag == "main" or node.tag == "article" and node.suspect != COMMENTS else {node.tag} if node.tag in _HEADINGS | FORM_TAGS else set()
            if not up.holds >= (mine := mine | node.holds):
                up.holds = up.holds | mine
    stack2: list[tuple[Node, bool]] = [(root, False)]
    while stack2:
        node, inside = stack2.pop()
        inside = inside or node.tag in ("article", "main")
        for child in node.children:
            if isinstance(child, Node) and not child.dropped:
                if child.suspect and _is_junk(child, root, inside) or child.tag == "header" and _is_page_header(child, inside):
                    child.dropped = True
                else:
                    stack2.append((child, inside))
    for node in order:
        node.chars = node.linked = 0.0


def _measure(root: Node) -> list[Node]:
    """Characters and linked characters of all kept nodes, and the points of containers; iteratively, as trees
    can be deep."""
    order: list[Node] = []
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked = linked or node.tag == "a"
        own, commas, below = 0, 0, []
        for child in node.children:
            if isinstance(child, str):
                if text := child.strip():
                    own += len(text)
                    commas += text.count(",") + text.count("、") + text.count("，")
            elif not child.dropped:
                below.append((child, linked))
        stack += reversed(below)  # in page order
        node.chars += own
        if linked:
            node.linked += own
        node.score += _TAG_POINTS.get(node.tag, 0) + (25 if node.names & CONTENT else 0)
        if own and not linked:
            block = node
            while block.parent is not None and block.tag not in BLOCK and block.tag not in _PARAGRAPHS:
                block = block.parent
            points, up, far = 1 + commas + min(own / 100, 3), block.parent if block.tag in _PARAGRAPHS and block.parent else block, 0
            while up is not None and far < LEVELS:
                up.score += points / (1 if far == 0 else 2 if far == 1 else 3 * far)
                up, far = up.parent, far + 1
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _blocks(tops: list[Node]) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(_html.unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    for top in tops:
        stack: list[object] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif item.dropped:
                run.append(" ")
            else:
                if item.tag in BLOCK:
                    flush()
                    stack.append(None)
                elif item.tag in ("br", "td", "th", "img", "wbr"):
                    run.append("" if item.tag == "wbr" else " ")
                stack += reversed(item.children)
        flush()
    return blocks


_BETWEEN = _HEADINGS | frozenset("p ul ol dl blockquote pre figure table section div hgroup header details address".split())


def _kept(best: Node) -> list[Node]:
    """The best container with what belongs to it among its siblings, in page order."""
    around = [n for n in best.parent.children if isinstance(n, Node) and not n.dropped and n.chars]
    least = max(10.0, best.score * (1 - _density(best)) * 0.2)

    def belongs(n: Node) -> bool:
        if n.tag == "p":
            return n.chars > PROSE and _density(n) < 0.25 or not n.linked
        if n.tag == best.tag and n.names == best.names and n.prose and _density(n) < 0.25:
            return True
        return n is best or n.tag == "h1" or n.tag in BLOCK and n.tag not in _PARAGRAPHS and n.score * (1 - _density(n)) >= least

    good = [i for i, n in enumerate(around) if belongs(n)]
    first, last = good[0], good[-1]
    while first and around[first - 1].tag in _HEADINGS:
        first -= 1
    while last + 1 < len(around) and around[last + 1].tag in ("ul", "ol", "dl", "blockquote", "pre", "table") and not around[last + 1].linked:
        last += 1
    tops = [n for i, n in enumerate(around) if first <= i <= last and (i in good or i < good[0] or i > good[-1] or n.tag in _BETWEEN and _density(n) < 0.25)]
    if not any(n.tag == "h1" or "h1" in n.holds for n in tops):
        below = best.parent
        while below.parent is not None:
            sides = below.parent.children
            before = [n for n in sides[: next(i for i, n in enumerate(sides) if n is below)] if isinstance(n, Node) and n.tag == "h1" and not n.dropped and n.chars]
            if before:
                return [before[-1], *tops]
            below = below.parent
    return tops


def _main_text(root: Node) -> str:
    nodes = _measure(root)
    if not root.chars:
        return ""
    holders = [n for n in nodes if n.chars and (n.tag in BLOCK or n.tag in ("td", "th") or n is root) and n.tag not in _PARAGRAPHS | {"html"} or n.tag in ("td", "blockquote")]
    best = max(holders, key=lambda n: n.score * (1 - _density(n)), default=root)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    return "\n".join(_blocks([best] if best.parent is None else _kept(best)))


def extract(page: str | None) -> str:
    """The main text of an HTML page."""
    if not page:
        return ""
    root = parse(page)
    _judge(root)
    if text := _main_text(root):
        return text
    return _main_text(parse(page))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every row."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array([extract(h) for h in batch["html"].to_pylist()], pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return map_batches(source, rows, f"{kinds}, text string")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
