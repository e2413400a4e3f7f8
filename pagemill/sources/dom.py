"""Scans that need the tree of a page: live elements and URLs, server blocks, heuristics, players, readers.

Each scan is a function of (html, url) that gives rows; ``scan`` runs one over
pages.  What only a browser knows (visibility, sizes, resolved addresses) is
left out: attributes are taken as they stand.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pagemill.functions import rules as R
from pagemill.sources.html import _Node, metadata, parse

Rows = list[dict]
#: Scan name: (function of html and url, schema of its rows after page_id).
SCANS: dict[str, tuple[Callable[[str | None, str], Rows], str]] = {}
_SPACE = re.compile(r"\s+")


def _scan(schema: str) -> Callable:
    def add(f: Callable[[str | None, str], Rows]) -> Callable[[str | None, str], Rows]:
        SCANS[f.__name__] = (f, schema)
        return f

    return add


def _in(node: _Node, *words: str) -> bool:
    return any(w in node.cls for w in words)


def _named(node: _Node, *words: str) -> bool:
    both = f"{node.cls} {node.attr.get('id', '')}".lower()
    return any(w in both for w in words)


def _source(node: _Node) -> str:
    return node.attr.get("src") or node.attr.get("data-src") or ""


def _flat(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def escaped(name: str) -> str:
    """A name as it stands in a selector."""
    out = "".join(c if c.isalnum() or c in "-_" else "\\" + c for c in name)
    return f"\\3{out[0]} {out[1:]}" if out[:1].isdigit() else out


# -- live scans -----------------------------------------------------------------


def _live_kind(node: _Node) -> str:
    tag, attr = node.tag, node.attr
    if tag in ("input", "textarea"):
        return "input"
    if tag == "select":
        return "select"
    if tag == "a" or attr.get("href"):
        return "link"
    if tag == "button" or attr.get("onclick") or attr.get("role") in ("button", "tab"):
        return "clickable"
    fixed = {"img": "image", "iframe": "iframe", "video": "media", "audio": "media", "form": "form"}
    if tag in fixed:
        return fixed[tag]
    if re.search("h[1-6]", tag):
        return "heading"
    if tag in ("ul", "ol", "li", "table"):
        return {"li": "list-item", "table": "table"}.get(tag, "list")
    return "text" if _flat(node.text) and not node.kids else "container"


def _live_selector(node: _Node, same: dict[tuple[str, str], list[_Node]]) -> str:
    if node.attr.get("id"):
        return "#" + escaped(node.attr["id"])
    cls = next((c for c in node.cls.split() if 2 < len(c) < 40), None)
    if cls:
        alike = same[node.tag, cls]
        at = f":nth-of-type({alike.index(node) + 1})" if len(alike) > 1 else ""
        return f"{node.tag}.{escaped(cls)}{at}"
    if node.parent:
        return f"{_live_selector(node.parent, same)} > {node.tag}:nth-child({node.parent.kids.index(node) + 1})"
    return node.tag


@_scan("seq int, tag string, type string, text string, class string, id string, selector string, parent string, attr map<string,string>")
def live_elements(html: str | None, url: str = "") -> Rows:
    """Every element with its richer type; containers of under 2 or over 50 children go; the first 300."""
    nodes = parse(html)
    same: dict[tuple[str, str], list[_Node]] = {}
    for n in nodes:
        for c in dict.fromkeys(n.cls.split()):
            same.setdefault((n.tag, c), []).append(n)
    out: Rows = []
    for n in nodes:
        kind = _live_kind(n)
        if kind == "container" and not 2 <= len(n.kids) <= 50:
            continue
        if len(out) == R.LIVE_ELEMENTS:
            break
        p = n.parent
        out.append({
            "seq": len(out), "tag": n.tag.upper(), "type": kind, "text": _flat(n.text)[:60], "class": n.cls.strip()[:80], "id": n.attr.get("id", ""), "selector": _live_selector(n, same),
            "parent": (p.attr.get("id") or p.cls.split(" ")[0] or p.tag.upper()) if p else "", "attr": {k: n.attr[k][:200] for k in R.LIVE_ATTRIBUTES if n.attr.get(k)} | ({"name": n.attr["name"]} if n.attr.get("name") else {}),
        })
    return out


@_scan("seq int, url string")
def live_urls(html: str | None, url: str = "") -> Rows:
    """Frames, media, the first 300 links, URLs in onclick (plain, then with escaped slashes), data attributes, scripts of 30 to 20,000 letters."""
    found: dict[str, None] = {}

    def add(u: str | None) -> None:
        if u and u != "about:blank" and not u.startswith(("#", "javascript:", "data:")):
            found.setdefault(u)

    nodes = parse(html)
    for n in nodes:
        if n.tag == "iframe":
            add(_source(n))
    for n in nodes:
        if n.tag in ("video", "audio", "embed", "object") or (n.tag == "source" and any(p.tag in ("video", "audio") for p in _above(n))):
            add(n.attr.get("src") or n.attr.get("data"))
    for n in [n for n in nodes if n.tag == "a" and "href" in n.attr][:300]:
        add(n.attr["href"])
    for n in nodes:
        code = n.attr.get("onclick", "")
        for u in re.findall(R.QUOTED_URL, code):
            add(u)
        for u in re.findall(R.ESCAPED_URL, code):
            add(u.replace("\\/", "/"))
    for n in nodes:
        add(next((n.attr[k] for k in R.LIVE_DATA_URLS if n.attr.get(k)), None))
    for n in nodes:
        if n.tag == "script" and 30 <= len(n.text) <= 20_000:
            for u in re.findall(R.LOOSE_URL, n.text)[:20]:
                if re.search(R.CONTENT_URL, u, re.I):
                    add(u)
    return [{"seq": i, "url": u} for i, u in enumerate(found, 1)]


def _above(node: _Node) -> Iterator[_Node]:
    while node.parent:
        node = node.parent
        yield node


@_scan("seq int, url string")
def final_urls(html: str | None, url: str = "") -> Rows:
    """URLs of frames, in scripts, and of images, each once."""
    nodes = parse(html)
    urls = [n.attr["src"] for n in nodes if n.tag == "iframe" and n.attr.get("src", "").startswith("http")]
    for n in nodes:
        if n.tag == "script":
            urls += re.findall(R.SCRIPT_URL, n.text)
    for n in nodes:
        if n.tag == "img":
            u = n.attr.get("src") or n.attr.get("data-src") or n.attr.get("lazy_url") or ""
            urls += [u] if u.startswith("http") else []
    return [{"seq": i, "url": u} for i, u in enumerate(dict.fromkeys(urls), 1)]


# -- server blocks --------------------------------------------------------------


def _keyed(node: _Node) -> dict[str, str]:
    keyed = ((n.attr.get("data-key") or n.attr.get("data-server-prop"), n) for n in node.below())
    return {k: n.text.strip() for k, n in keyed if k}


def _global(nodes: list[_Node]) -> dict[str, str]:
    keyed = ((n.attr.get("data-global") or n.attr.get("data-site-info"), n) for n in nodes)
    return {k: n.text.strip() for k, n in keyed if k}


def _title(nodes: list[_Node]) -> str:
    return next((n.text.strip() for n in nodes if n.tag == "title"), "")


_BLOCK = "seq int, server map<string,string>, title string, global map<string,string>"


@_scan(_BLOCK)
def server_blocks(html: str | None, url: str = "") -> Rows:
    """Elements named after servers or players with what their marked parts say, else their text."""
    nodes = parse(html)
    out = []
    for n in nodes:
        p = n.parent
        child = p is not None and ((n.tag == "li" and "player" in p.attr.get("id", "").lower()) or (n.tag == "div" and "server" in p.cls.lower()))
        if child or _named(n, "server") or "player" in n.cls.lower():
            text = n.text.strip()
            out.append(_keyed(n) or ({"text": text} if text else {}))
    return [{"seq": i, "server": s, "title": _title(nodes), "global": _global(nodes)} for i, s in enumerate(out)]


@_scan(_BLOCK)
def first_server_block(html: str | None, url: str = "") -> Rows:
    """The children of the first such element; empty ones go."""
    nodes = parse(html)
    block = next((n for n in nodes if _named(n, "server", "player")), None)
    found = [_keyed(k) or ({"text": k.text.strip()} if k.text.strip() else {}) for k in block.kids] if block else []
    return [{"seq": i, "server": s, "title": _title(nodes), "global": _global(nodes)} for i, s in enumerate(f for f in found if f)]


@_scan("src string")
def wrapped_frame(html: str | None, url: str = "") -> Rows:
    """The first frame in the player's wrapper."""
    wrapper = next((n for n in parse(html) if "reproductor-wrapper" in n.cls.split()), None)
    frame = next((n for n in wrapper.below() if n.tag == "iframe"), None) if wrapper else None
    return [{"src": frame.attr.get("src", "")}] if frame else []


# -- images and metadata --------------------------------------------------------


@_scan("seq int, url string, attribute string")
def live_images(html: str | None, url: str = "") -> Rows:
    """As the static scan, with data-original among the placeholders, data-lazy-src as a last resort, and background images."""
    found: dict[str, str] = {}
    nodes = parse(html)
    for n in nodes:
        if n.tag != "img":
            continue
        src = n.attr.get("src", "")
        holder = not src or bool(re.search(R.PLACEHOLDER, " ".join(n.attr.get(k, "") for k in ("src", "data-original")), re.I))
        for key in ("cover_url", "data-original", "data-src", "lazy_url", *(() if holder else ("src",)), "data-lazy-src"):
            if n.attr.get(key, "").startswith("http"):
                found.setdefault(n.attr[key], key)
                break
    for n in nodes:
        got = re.search(r"background-image\s*:\s*url\([\"']?([^\"')]+)", n.attr.get("style", ""))
        if got and got[1].startswith("http"):
            found.setdefault(got[1], "background-image")
    return [{"seq": i, "url": u, "attribute": a} for i, (u, a) in enumerate(found.items(), 1)]


@_scan("name string, value string")
def schema_org(html: str | None, url: str = "") -> Rows:
    """Itemtype and itemprops of marked items; later ones overwrite."""
    out: dict[str, str] = {}
    for n in parse(html):
        if "itemscope" not in n.attr:
            continue
        if n.attr.get("itemtype"):
            out["@type"] = n.attr["itemtype"]
        for prop in n.below():
            name = prop.attr.get("itemprop")
            value = prop.text.strip() or prop.attr.get("content") or prop.attr.get("href") or ""
            if name and value:
                out[name] = value
    return [{"name": k, "value": v} for k, v in out.items()]


def _json_ld(nodes: list[_Node]) -> str | None:
    """The first JSON-LD block, as JSON; null if there is none that parses."""
    block = next((n for n in nodes if n.tag == "script" and n.attr.get("type") == "application/ld+json"), None)
    try:
        return None if block is None else json.dumps(json.loads(block.text or "{}"), ensure_ascii=False)
    except ValueError:
        return None


@_scan("meta map<string,string>, structured string")
def page_data(html: str | None, url: str = "") -> Rows:
    """Meta tags and the first JSON-LD block of a page that has either."""
    meta, structured = metadata(html), _json_ld(parse(html))
    return [{"meta": meta, "structured": structured}] if meta or structured else []


# -- extraction by kind of finding ------------------------------------------------


@_scan("seq int, data string")
def card_grid(html: str | None, url: str = "") -> Rows:
    """JSON that the first fifty cards carry, or what they carry as raw text."""
    out = []
    for n in [n for n in parse(html) if _in(n, "card", "item")][:50]:
        data = n.attr.get("data-anime") or n.attr.get("data-item") or n.attr.get("data-json")
        if data:
            try:
                out.append(json.loads(data))
            except ValueError:
                out.append({"raw": data})
    return [{"seq": i, "data": json.dumps(x, ensure_ascii=False)} for i, x in enumerate(out)]


@_scan("seq int, text string, href string")
def episode_list(html: str | None, url: str = "") -> Rows:
    """Links below episode or chapter containers."""
    links = [n for n in parse(html) if n.tag == "a" and any(_in(p, "episod", "capitul") for p in _above(n))]
    return [{"seq": i, "text": n.text.strip()[:60], "href": n.attr.get("href", "")} for i, n in enumerate(links)]


def _frames(nodes: list[_Node]) -> list[_Node]:
    return [n for n in nodes if n.tag == "iframe" and _source(n) and "about:blank" not in _source(n)]


@_scan("seq int, src string, width string, height string, parent_class string")
def video_player(html: str | None, url: str = "") -> Rows:
    """Frames with a source."""
    return [{"seq": i, "src": _source(n), "width": n.attr.get("width", ""), "height": n.attr.get("height", ""), "parent_class": n.parent.cls if n.parent else ""} for i, n in enumerate(_frames(parse(html)))]


@_scan("seq int, class_name string, iframes array<string>, tabs array<string>")
def server_container(html: str | None, url: str = "") -> Rows:
    """Server and player containers with their frames and tabs."""
    out = []
    for n in parse(html):
        if _in(n, "server", "servidor", "player", "reproductor"):
            below = list(n.below())
            out.append({"seq": len(out), "class_name": n.cls, "iframes": [_source(k) for k in below if k.tag == "iframe"], "tabs": [k.text.strip() for k in below if k.tag == "button" or k.attr.get("role") == "tab"]})
    return out


@_scan("seq int, text string, href string, is_current boolean, total int")
def pagination(html: str | None, url: str = "") -> Rows:
    """Links and buttons of the first pagination block."""
    block = next((n for n in parse(html) if _in(n, *R.PAGE_BLOCKS)), None)
    links = [n for n in block.below() if n.tag in ("a", "button")] if block else []
    return [
        {"seq": i, "text": n.text.strip()[:20], "href": n.attr.get("href", ""), "is_current": _in(n, "current", "active") or "aria-current" in n.attr, "total": len(links)}
        for i, n in enumerate(links)
    ]


#: The scan for a kind of finding; other kinds have none.
EXTRACTORS = {"card-grid": "card_grid", "episode-list": "episode_list", "video-player": "video_player", "server-container": "server_container", "pagination": "pagination"}


def extract(pages: DataFrame, finding: str) -> DataFrame | None:
    """What the scan for a kind of finding gives, or None where there is no such scan."""
    return scan(pages, EXTRACTORS[finding]) if finding in EXTRACTORS else None


# -- heuristics -----------------------------------------------------------------


def _cards(nodes: list[_Node]) -> Rows:
    """Class names of 3 to 40 letters and a card's keyword on 3 to 500 elements, the five most frequent."""
    counts = Counter(c for n in nodes for c in n.cls.split() if 3 <= len(c) <= 40)
    fits = [(c, k) for c, k in counts.items() if 3 <= k <= 500 and any(w in c.lower() for w in R.CARD_WORDS)]
    return [{"type": "card-grid", "selector": "." + c, "score": min(5 * k, 100), "count": k} for c, k in sorted(fits, key=lambda x: -x[1])[:5]]


def _link_lists(nodes: list[_Node]) -> Rows:
    """Containers of 2 to 1000 links of which one class has seven in ten."""
    out = []
    for box in nodes:
        if box.tag not in ("div", "ul", "ol", "nav", "section"):
            continue
        links = [n for n in box.below() if n.tag == "a" and "href" in n.attr]
        if not 2 <= len(links) <= 1000:
            continue
        for cls, k in Counter(c for c in (n.cls.strip() for n in links) if c).items():
            if k >= 0.7 * len(links) and len(cls) > 2:
                around = (box.cls.strip() or box.tag.upper()).lower()
                texts = " ".join(n.text.strip()[:50] for n in links[:5]).lower()
                kind = next((name for name, pattern, whole in R.LIST_KINDS if re.search(pattern, around + texts if whole else around)), "link-list")
                out.append({"type": kind, "selector": "." + escaped(cls), "score": min(3 * k, 85), "count": len(links)})
                break
    return out


def _players(nodes: list[_Node]) -> Rows:
    """Frames with a source, and the nearest container up to five levels above a frame that is named after servers."""
    out = [{"type": "video-player", "selector": "iframe", "score": 90, "count": len(found)}] if (found := _frames(nodes)) else []
    boxes: Counter[str] = Counter()
    for n in nodes:
        if n.tag == "iframe":
            for _, p in zip(range(5), _above(n), strict=False):
                cls = p.cls.strip()
                if len(cls) > 2 and re.search(R.PLAYER_BLOCKS, cls.lower()):
                    boxes[cls] += 1
                    break
    return out + [{"type": "server-container", "selector": "." + escaped(c), "score": 80, "count": k} for c, k in boxes.items()]


def _first_block(nodes: list[_Node], fits: Callable[[_Node], bool], inside: Callable[[_Node], bool], kind: str, score: int, name: str, least: Callable[[list[_Node]], bool]) -> Rows:
    for n in nodes:
        if fits(n):
            found = [k for k in n.below() if inside(k)]
            if least(found):
                return [{"type": kind, "selector": "." + (n.cls.split() or [name])[0], "score": score, "count": len(found)}]
    return []


def _search_input(nodes: list[_Node]) -> Rows:
    for n in nodes:
        if n.tag != "input":
            continue
        hint, own = n.attr.get("placeholder", "").lower(), n.attr.get("id", "")
        asks = n.attr.get("type") in ("text", "search") or any(w in hint for w in ("buscar", "search")) or any(w in own for w in ("filtro", "search", "buscar"))
        name = own or n.cls.strip()
        if asks and name:
            return [{"type": "search-input", "selector": "#" + escaped(name), "score": 90, "count": 1}]
    return []


@_scan("seq int, type string, selector string, score int, count int")
def findings(html: str | None, url: str = "") -> Rows:
    """Heuristic findings of a page, the surest first."""
    nodes = parse(html)
    tag = lambda *tags: lambda n: n.tag in tags
    two = lambda found: len(found) >= 2
    links_or_buttons = lambda found: max(Counter(n.tag for n in found).values(), default=0) >= 2
    meta = metadata(html)
    got = [
        *_cards(nodes), *_link_lists(nodes), *_players(nodes),
        *_first_block(nodes, lambda n: _in(n, *R.PAGE_BLOCKS), tag("a", "button"), "pagination", 95, "pagination", links_or_buttons),
        *_search_input(nodes),
        *_first_block(nodes, lambda n: _in(n, "filtro", "filter"), tag("select", "input", "button"), "filter-group", 85, "filters", two),
        *([{"type": "metadata", "selector": 'meta, script[type="application/ld+json"]', "score": 70, "count": len(meta)}] if meta or _json_ld(nodes) else []),
        *_first_block(nodes, lambda n: n.attr.get("role") == "tablist" or _in(n, "tabs", "pestanas"), lambda n: n.attr.get("role") == "tab" or n.tag in ("button", "a"), "tabs", 88, "tabs", two),
    ]
    return [{"seq": i, **f} for i, f in enumerate(sorted(got, key=lambda f: -f["score"]))]


# -- readers and players ----------------------------------------------------------


def _options(select: _Node) -> list[_Node]:
    return [n for n in select.below() if n.tag == "option"]


@_scan("batch_size int, batch_url string, page_urls array<string>")
def batch_reader(html: str | None, url: str = "") -> Rows:
    """The largest batch size that a page offers with its address, and the page list that stands on a page already loaded in batches."""
    size, value, pages = 1, "", []
    for s in (n for n in parse(html) if n.tag == "select"):
        options = _options(s)
        texts = [o.text for o in options]
        values = [o.attr.get("value", o.text) for o in options]
        if texts and re.search(R.BATCH_SELECT, texts[0], re.I):
            for t, v in zip(texts, values, strict=True):
                got = re.search(r"\d+", t)
                if got and int(got[0]) > size:
                    size, value = int(got[0]), v
        elif not pages:
            named = any(w in s.cls for w in R.PAGE_SELECTS)
            by_value = len(values) >= 2 and all(re.search(r"-\d+-\d+\.html", v, re.I) for v in values[:2])
            by_text = len(texts) >= 2 and all(re.match(r"\d+/\d+", t) for t in texts[:2])
            if named or by_value or by_text:
                pages = [v for v in values if v.startswith(("http", "/"))]
    known = size > 1 and bool(value)
    return [{"batch_size": size, "batch_url": url.rstrip("/") + value if known else "", "page_urls": pages}] if known or pages else []


def player_source(html: str | None) -> str | None:
    """The media file of an embedded player's setup: its first media ``file``, else the source of the highest number in its label."""
    for script in re.findall(r"<script[^>]*>([\s\S]*?)</script>", html or "", re.I):
        if len(script) <= 10 or not any(w in script for w in ("jwplayer", "sources", "playlist")):
            continue
        if got := re.search(R.PLAYER_FILE, script, re.I):
            return got[1]
        if got := re.search(R.PLAYER_SETUP, script):
            try:
                setup = json.loads(re.sub(r"([{,]\s*)(\w+)(\s*:)", r'\1"\2"\3', got[1]).replace("'", '"'))
            except ValueError:
                continue
            sources = [s for s in setup.get("sources") or [] if s.get("file")] if isinstance(setup.get("sources"), list) else []
            if sources:
                return max(sources, key=lambda s: int((re.search(r"\d+", s.get("label") or "") or ["0"])[0]))["file"]
            if setup.get("file"):
                return setup["file"]
    return None


@_scan("direct_url string, frame_url string")
def embed_step(html: str | None, url: str = "") -> Rows:
    """What an embed page leads to: a media URL, else its first frame."""
    whole = lambda u: "https:" + u if u.startswith("//") else u
    direct = player_source(html)
    for pattern in R.MEDIA_URLS:
        if not direct and (got := re.search(pattern, html or "", re.I)):
            direct = got[0]
    frame = re.search(R.FRAME_SOURCE, html or "", re.I)
    return [{"direct_url": whole(direct) if direct else None, "frame_url": whole(frame[1]) if frame else None}]


# -- running ----------------------------------------------------------------------


def scan(pages: DataFrame, name: str) -> DataFrame:
    """Rows of a scan over pages (page_id, url, html), with their page_id."""
    f, schema = SCANS[name]
    cols = ["page_id", *(c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(","))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame([{"page_id": p, **r} for p, u, h in zip(x["page_id"], x["url"], x["html"], strict=True) for r in f(h, u or "")], columns=cols)

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, {schema}")
