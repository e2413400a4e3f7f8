"""Scans of HTML (S3, S5, S13, S16): elements, URLs, images and metadata from page text.

One pass of the standard parser per page and task; the only Python in a page's way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# -- fixed values ---------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATCHED = frozenset("a button input select iframe img video audio li h1 h2 h3 div form span".split())
CLOSES_BEFORE = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
ATTRIBUTES = ("href", "src", "data-src", "data-url", "data-link", "data-video", "data-embed", "onclick", "placeholder", "type", "title", "alt", "role")
DATA_URLS = ("data-src", "data-url", "data-link", "data-video", "data-embed", "data-href")
MOST_ELEMENTS = 301
_QUOTED = re.compile(r"https?://[^'\")\s]+")
_LOOSE = re.compile(r"https?://[^\"'\s<>]{10,300}")
_CONTENT = re.compile("embed|player|video|stream|watch|download|server|m3u8|mp4", re.I)
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "attr", "parent", "parts", "kids")

    def __init__(self, tag: str, attr: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attr, self.parent, self.parts, self.kids = tag, attr, parent, [], []

    @property
    def text(self) -> str:
        return "".join(self.parts)

    @property
    def cls(self) -> str:
        return self.attr.get("class", "")

    def below(self) -> Iterator[_Node]:
        """Descendants in document order."""
        todo = self.kids[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.kids))

    @property
    def first_class(self) -> str:
        return (self.attr.get("class") or "").split(" ")[0] if self.attr.get("class") else ""


class _Tree(HTMLParser):
    """Open elements as a stack; every text goes to all of them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSES_BEFORE.get(tag)
        if closes and self.open and self.open[-1].tag in closes:
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None)
        if node.parent:
            node.parent.kids.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        for node in self.open:
            node.parts.append(data)


def parse(html: str | None) -> list[_Node]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.nodes


def kind_of(node: _Node) -> str:
    """Element type by tag, role and class."""
    tag = node.tag
    if tag == "a":
        return "link"
    if tag == "button" or node.attr.get("role") == "button" or "onclick" in node.attr:
        return "clickable"
    return {"input": "input", "select": "select", "iframe": "iframe", "img": "image", "video": "media", "audio": "media", "li": "list-item", "h1": "heading", "h2": "heading", "h3": "heading", "form": "form", "div": "container"}.get(tag, "text")


def elements(html: str | None) -> Iterator[dict]:
    """S3: matched elements in document order, the first 301 matches; empty leaf div and span are skipped but count."""
    for i, node in enumerate(n for n in parse(html) if n.tag in MATCHED):
        if i >= MOST_ELEMENTS:
            return
        text = _SPACE.sub(" ", "".join(node.parts)).strip()
        if node.tag in ("div", "span") and not text and not node.kids:
            continue
        p = node.parent
        yield {
            "seq": i, "tag": node.tag, "type": kind_of(node), "text": text[:60], "class": node.attr.get("class", ""), "id": node.attr.get("id", ""),
            "selector": f"#{node.attr['id']}" if node.attr.get("id") else node.tag + (f".{node.first_class}" if node.first_class else ""),
            "parent": (p.attr.get("id") or p.first_class or p.tag).lower() if p else "", "attr": {k: node.attr[k][:200] for k in ATTRIBUTES if k in node.attr},
        }


def page_urls(html: str | None) -> list[tuple[str, str]]:
    """Distinct (url, kind) in order: frames, links, media, data attributes, quoted and loose URLs in the text."""
    found: dict[str, str] = {}

    def put(url: str | None, kind: str) -> None:
        if url and not url.startswith(("#", "javascript:", "about:blank")):
            found.setdefault(url, kind)

    nodes = parse(html)
    for n in nodes:
        if n.tag == "iframe":
            put(n.attr.get("src") or n.attr.get("data-src"), "iframe")
    for n in nodes:
        if n.tag == "a" and n.attr.get("href", "").startswith(("http", "/")):
            put(n.attr["href"], "link")
    for n in nodes:
        if n.tag in ("video", "audio", "source", "embed", "object"):
            put(n.attr.get("src") or n.attr.get("data"), "media")
    for n in nodes:
        put(next((n.attr[k] for k in DATA_URLS if n.attr.get(k)), None), "data")
    for u in _QUOTED.findall(html or ""):
        put(u, "text")
    for u in _LOOSE.findall(html or ""):
        if _CONTENT.search(u):
            put(u, "text")
    return list(found.items())


def images(html: str | None) -> list[tuple[str, str]]:
    """(resolved URL, attribute) of lazy images: cover_url, data-original, data-src, lazy_url, then src unless a placeholder; repeats once."""
    found: dict[str, str] = {}
    for n in parse(html):
        if n.tag != "img":
            continue
        src = n.attr.get("src", "")
        holder = bool(re.search(r"placeholder|blank|loading|lazy|data:image|1x1|spacer", src, re.I)) or not src
        for key in ("cover_url", "data-original", "data-src", "lazy_url", *(() if holder else ("src",))):
            if n.attr.get(key, "").startswith("http"):
                found.setdefault(n.attr[key], key)
                break
    return list(found.items())


def metadata(html: str | None) -> dict[str, str]:
    """Meta tags of S16: names under 60 letters with contents under 200; later ones overwrite."""
    out = {}
    for n in parse(html):
        key, content = n.attr.get("property") or n.attr.get("name"), n.attr.get("content")
        if n.tag == "meta" and key and content and len(key) < 60 and len(content) < 200:
            out[key] = content
    return out


ELEMENT_SCHEMA = "page_id long, seq int, tag string, type string, text string, class string, id string, selector string, parent string, attr map<string,string>"


def scan_elements(pages: DataFrame) -> DataFrame:
    """Element rows of pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["page_id", "seq", "tag", "type", "text", "class", "id", "selector", "parent", "attr"]
        for f in frames:
            yield pd.DataFrame([{"page_id": p, **e} for p, h in zip(f["page_id"], f["html"], strict=True) for e in elements(h)], columns=cols)

    return pages.select("page_id", "html").mapInPandas(run, ELEMENT_SCHEMA)


def scan_urls(pages: DataFrame) -> DataFrame:
    """(page_id, seq, url, kind) of pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, i, u, k) for p, h in zip(f["page_id"], f["html"], strict=True) for i, (u, k) in enumerate(page_urls(h), 1)], columns=["page_id", "seq", "url", "kind"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, seq int, url string, kind string")


def scan_images(pages: DataFrame) -> DataFrame:
    """(page_id, seq, url, attribute) of pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, i, u, k) for p, h in zip(f["page_id"], f["html"], strict=True) for i, (u, k) in enumerate(images(h), 1)], columns=["page_id", "seq", "url", "attribute"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, seq int, url string, attribute string")


def scan_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, name, content) of pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, k, v) for p, h in zip(f["page_id"], f["html"], strict=True) for k, v in metadata(h).items()], columns=["page_id", "name", "content"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, name string, content string")
