"""Operators on raw pages: cleaned text, titles, metadata and links.

The DOM variants run in Arrow batches with a tolerant parser; the regular-expression variants stay in the JVM and
suit markup without the elements that only a tree can tell apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PAGE_NOISE, Settings
from ..functions import text as T
from ..functions import urls as U

# Fixed values.
DROPPED = frozenset("script style nav header footer aside noscript iframe form".split())
DROPPED_CLASS = re.compile(r"feedback|rating|survey|cookie|breadcrumb|pagination|share|social|widget|banner|alert|modal|tooltip|dropdown|collapse", re.I)
DATE_NAMES = ("article:modified_time", "article:published_time", "date", "DC.date", "last-modified")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("p div article section ul ol li table tr td th h1 h2 h3 h4 h5 h6 main body header footer nav aside form blockquote pre dl dt dd".split())
_NOISE = re.compile(f"^({'|'.join(PAGE_NOISE)})$", re.I)


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def texts(self, skip=lambda node: False) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node is self or not skip(node):
                stack += reversed(node.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.node = Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS and self.node.tag == "p" or tag == "li" and self.node.tag == "li":
            self.node = self.node.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.node)
        self.node.children.append(new)
        if tag not in _VOID:
            self.node = new

    def handle_startendtag(self, tag, attrs):
        self.node.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.node))

    def handle_endtag(self, tag):
        up = self.node
        while up is not self.root and up.tag != tag:
            up = up.parent
        if up is not self.root:
            self.node = up.parent

    def handle_data(self, data):
        self.node.children.append(data)


def dom(page: str | None) -> Element:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def _dropped(node: Element) -> bool:
    return node.tag in DROPPED or any(DROPPED_CLASS.search(c) for c in node.attrs.get("class", "").split())


def _tree(page: str | Element | None) -> Element:
    return page if isinstance(page, Element) else dom(page)


def page_text(page: str | Element | None) -> str:
    """Text of the page's main container, a line for each text node, without noise lines and short lines."""
    root = _tree(page)
    kept: list[Element] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if not _dropped(node):
            kept.append(node)
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]
    first = lambda good: next((n for n in kept if good(n)), None)
    main = (
        first(lambda n: n.tag == "main")
        or first(lambda n: re.search("content|main|body", n.attrs.get("id", ""), re.I))
        or first(lambda n: any(re.search("content|main|article", c, re.I) for c in n.attrs.get("class", "").split()))
        or first(lambda n: n.tag == "article")
        or first(lambda n: n.tag == "body")
    )
    if main is None:
        return ""
    lines = (line.strip() for t in main.texts(_dropped) for line in t.strip().splitlines())
    return "\n".join(line for line in lines if len(line) >= 4 and not _NOISE.match(line))


def page_title(page: str | Element | None) -> str:
    """The title element, or the first heading, or nothing."""
    nodes = list(_tree(page).walk())
    for tag in ("title", "h1"):
        for node in nodes:
            if node.tag == tag:
                return "".join(t.strip() for t in node.texts())
    return ""


def page_date(page: str | Element | None) -> str | None:
    nodes = list(_tree(page).walk())
    metas = [n for n in nodes if n.tag == "meta"]
    for name in DATE_NAMES:
        for attribute in ("property", "name"):
            tag = next((m for m in metas if m.attrs.get(attribute) == name), None)
            if tag is not None:
                break
        if tag is not None and tag.attrs.get("content"):
            return tag.attrs["content"][:10]
    return next((n.attrs["datetime"][:10] for n in nodes if n.tag == "time" and "datetime" in n.attrs), None)


def service_status(page: str | Element | None) -> str | None:
    text = " ".join(t.strip() for t in _tree(page).texts() if t.strip()).lower()
    if "servizio attivo" in text:
        return "attivo"
    return "non attivo" if "servizio non attivo" in text or "servizio sospeso" in text else None


def clean_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, title, text, category, section, date, service_status of raw pages, by their trees."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, category in zip(batch["html"].to_pylist(), batch["category"].to_pylist(), strict=True):
                tree = dom(page)  # built once, and gone before the next
                found.append((page_title(tree), page_text(tree), page_date(tree), service_status(tree) if category == "servizio" else None))
            title, text, date, status = (pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else [[]] * 4))
            yield pa.RecordBatch.from_arrays(
                [batch["url"], title, text, batch["category"], batch["section"], date, status],
                ["url", "title", "text", "category", "section", "date", "service_status"],
            )

    source = pages.select(F.col(url).alias("url"), F.col(html).alias("html"), U.category(F.col(url)).alias("category"), U.section(F.col(url)).alias("section"))
    return source.mapInArrow(rows, "url string, title string, text string, category string, section string, date string, service_status string")


def unescaped(c: Column) -> Column:
    for name, value in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def whole_references(html: Column) -> Column:
    """html in which only references with their semicolon are references, as for the regular expressions; the tree decodes some without."""
    return F.regexp_replace(html, "&(?=#?[A-Za-z0-9]++(?!;))", "&amp;")


def title(html: Column) -> Column:
    """The title by regular expression."""
    first = lambda tag: T.strip(unescaped(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")))
    return F.coalesce(F.nullif(first("title"), F.lit("")), first("h1"))


def article_text(html: Column) -> Column:
    """The text of the article element by regular expression: tags end lines, short and noise lines go."""
    body = F.regexp_extract(html, "(?is)<article[^>]*>(.*?)(?:</article>|$)", 1)
    for tag in sorted(DROPPED):
        body = F.regexp_replace(body, f"(?is)<{tag}[ >].*?</{tag}>", "")
    return T.clean_page(unescaped(F.regexp_replace(F.regexp_replace(body, "(?s)<!--.*?-->", ""), "<[^>]*>", "\n")))


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'>\s]*)"""), 1), lambda h: T.strip(unescaped(h)))


def links(pages: DataFrame, settings: Settings) -> DataFrame:
    """(url, position, link) of the links that a crawl would follow, repeated ones too."""
    found = pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("position", "href")).where(~U.unusable_href(F.col("href")))
    found = found.select("url", "position", U.defragmented(U.join(F.col("url"), F.col("href"))).alias("link"))
    return found.where(~U.should_skip(F.col("link"), settings))


def pdf_links(pages: DataFrame, settings: Settings) -> DataFrame:
    """(url, position, link) of links to PDFs on allowed hosts; no other rule applies."""
    found = pages.select("url", F.posexplode(hrefs(F.col("html"))).alias("position", "href")).where(F.lower("href").endswith(".pdf"))
    found = found.select("url", "position", U.join(F.col("url"), F.col("href")).alias("link"))
    return found.where(U.allowed_domain(F.col("link"), settings))
