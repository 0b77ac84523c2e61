"""HTML pages to blocks and links. The tree walk is per page; Spark spreads the pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.rows import explode_rows


# Elements dropped, elements read, elements that never hold content
_DROPPED = {"script", "style", "nav", "footer", "header", "form"}
_READ = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol"}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer", "keygen", "menuitem",
}


_BLOCKS = T.ArrayType(
    T.StructType([T.StructField("type", T.StringType()), T.StructField("content", T.StringType())])
)


class _Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[_Node]:
        """Elements below this one in document order, dropped ones left out."""
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, _Node) and node.name not in _DROPPED:
                yield node
                todo.extend(reversed(node.children))

    def strings(self) -> Iterator[str]:
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.name not in _DROPPED:
                todo.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(s.strip() for s in self.strings())


class _Tree(HTMLParser):
    """Builds the element tree without closing tags the page leaves open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.stack = [self.root]
        self.joined = False

    def handle_starttag(self, tag, attrs):
        self.joined = False
        node = _Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.joined = False
        self.stack[-1].children.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.joined = False
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name == tag:
                del self.stack[depth:]
                return

    def handle_data(self, data):
        siblings = self.stack[-1].children
        if self.joined and siblings:
            siblings[-1] += data
        else:
            siblings.append(data)
        self.joined = True

    def handle_comment(self, data):
        self.joined = False

    handle_decl = handle_pi = unknown_decl = handle_comment


def _parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _table(node: _Node) -> str | None:
    rows = []
    for tr in (n for n in node.walk() if n.name == "tr"):
        cells = [n.text() for n in tr.walk() if n.name in ("td", "th")]
        if any(cells):
            rows.append(cells)
    if not rows:
        return None
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    rows.insert(1, ["---"] * width)
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _outermost(body: _Node) -> Iterator[_Node]:
    """Elements to read that are not inside a table or list."""
    todo = list(reversed(body.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.name in _DROPPED:
            continue
        if node.name in _READ:
            yield node
        if node.name not in ("table", "ul", "ol"):
            todo.extend(reversed(node.children))


def page_blocks(html: str) -> list[dict]:
    root = _parse(html)
    body = next((n for n in root.walk() if n.name == "body"), root)
    blocks = []
    for node in _outermost(body):
        if node.name == "table":
            content, kind = _table(node), "table"
        elif node.name in ("ul", "ol"):
            items = (n.text() for n in node.walk() if n.name == "li")
            content, kind = "\n".join(f"- {t}" for t in items if t), "text"
        else:
            content, kind = node.text(), "text"
        if content:
            blocks.append({"type": kind, "content": content})
    if not blocks:
        lines = (s.strip() for s in "\n\n".join(root.strings()).split("\n"))
        whole = "\n\n".join(s for s in lines if s)
        if whole:
            blocks.append({"type": "text", "content": whole})
    return blocks


def page_links(url: str, html: str) -> list[str]:
    """Absolute links of a page that stay on its host, in page order."""
    host = urlparse(url).netloc
    links = []
    for node in _parse_all(html):
        if node.name != "a" or "href" not in node.attrs:
            continue
        try:
            target = urljoin(url, node.attrs["href"] or "")
            if urlparse(target).netloc == host:
                links.append(target)
        except ValueError:
            break
    return links


def _parse_all(html: str) -> Iterator[_Node]:
    todo = [_parse(html)]
    while todo:
        node = todo.pop()
        if isinstance(node, _Node):
            yield node
            todo.extend(reversed(node.children))


@F.pandas_udf(_BLOCKS)
def html_blocks(html: pd.Series) -> pd.Series:
    """Blocks of each page; one of type `error` for a page the parser cannot read."""

    def read(page):
        try:
            return page_blocks(page) if page is not None else None
        except (AssertionError, ValueError) as problem:
            return [{"type": "error", "content": f"HTML: {problem or 'malformed markup'}"}]

    return html.map(read)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_links(url: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([page_links(u, h) for u, h in zip(url, html, strict=True)])


def html_to_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per block: block_no, type, content, page_number."""
    keep = [c for c in pages.columns if c != html]
    return explode_rows(pages, keep, html_blocks(html), "_b", "block_no").select(
        *keep,
        "block_no",
        F.col("_b.type").alias("type"),
        F.col("_b.content").alias("content"),
        F.lit(1).alias("page_number"),
    )
