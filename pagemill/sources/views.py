"""Relations over the test tables, as SQL of either dialect.

The tables hold no media pages, so some relations are decorated by fixed rules
on ids: hosts, paths, labels.  Both engines get the same text.
"""

from __future__ import annotations

from pagemill.functions import urls
from pagemill.functions.dialect import Dialect, cases, lit

HREF = r'<a href="([^"]*)">'


def string(d: Dialect, x: str) -> str:
    return f"CAST({x} AS {'STRING' if d.spark else 'VARCHAR'})"


def links(d: Dialect) -> str:
    """page_id, page_url, seq (from 1), url: hrefs as they stand in a page, in order."""
    return f"SELECT page_id, p.url AS page_url, seq0 + 1 AS seq, l.href AS url FROM pages p {d.numbered(d.all('html', HREF), 'l', 'href')}"


def urls_of_pages(d: Dialect) -> str:
    """page_id, seq, url, context: page URLs on decorated hosts and paths."""
    host = f"concat('host', {string(d, 'page_id % 7')}, '.com')"
    tail = f"concat({d.extract('url', '([^/?#]*)(?:[?#].*)?$')}, {string(d, 'page_id')})"
    decorated = [
        f"concat('http://', {host}, '/embed/', {tail})", f"concat('http://', {host}, '/watch/', {tail})", f"concat('http://', {host}, '/ver/', {tail})", f"concat('http://', {host}, '/download/', {tail})",
        f"concat('http://', {host}, '/', {tail}, '.mp4')", f"concat('http://www.', {host}, '/', {tail}, '.m3u8?t=', {string(d, 'page_id')})", f"concat('http://', {host}, '/', {tail}, '.zip')", f"concat('http://cdn.', {host}, '/', {tail})",
        f"concat('https://player.', {host}, '/', {string(d, 'page_id')})", f"concat('http://', {host}, ':8080/', {tail})", f"concat('http://analytics.', {host}, '/', {tail}, '.mp4')", f"concat('http://', {host}, '/x?redirect=', {tail})",
    ]
    url = cases([(f"page_id % 12 = {i}", x) for i, x in enumerate(decorated)], "url")
    context = cases([("page_id % 5 = 0", "'server 1'"), ("page_id % 5 = 1", "'Episodio 3'"), ("page_id % 5 = 2", "'descargar'")], "''")
    return f"SELECT page_id, page_id AS seq, {url} AS url, {context} AS context FROM pages"


def streams(d: Dialect) -> str:
    """page_id, seq, url, labels (joined by spaces), direct_url."""
    labels = ("4K Latino", "1080p FHD", "720p English", "CAM", "server 1", "download", "ad publicidad", "English sub", "")
    text = cases([(f"page_id % 9 = {i}", lit(x)) for i, x in enumerate(labels)], "''")
    return f"SELECT page_id, seq, url, {text} AS labels, CASE WHEN page_id % 4 = 0 THEN concat('https://cdn.com/v', {string(d, 'page_id % 6')}, '.mp4') ELSE '' END AS direct_url FROM ({urls_of_pages(d)}) v_u"


def attempts(d: Dialect) -> str:
    """seq, domain, element_type, action, class, success, urls_found from the event log."""
    k = d.long(d.extract("props", "([0-9]+)"))
    classes = ("btn-server", "server-list", "play-btn", "lang-tab", "card-item", "download-btn", "header")
    cls = cases([(f"k % 7 = {i}", lit(x)) for i, x in enumerate(classes)], "''")
    return (
        f"SELECT event_id AS seq, concat('site', {string(d, 'user_id % 20')}) AS domain, event_type AS element_type, CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'dive' END AS action, {cls} AS class, "
        f"(event_type <> 'error') AS success, k % 4 AS urls_found FROM (SELECT *, {k} AS k FROM events) v_e"
    )


def engine_attempts(d: Dialect) -> str:
    """seq, provider, engine, phase, success, duration_ms, results."""
    return (
        f"SELECT event_id AS seq, concat('p', {string(d, 'user_id % 20')}) AS provider, CASE event_id % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' ELSE 'intelligent' END AS engine, "
        f"CASE event_id % 2 WHEN 0 THEN 'search' ELSE 'videos' END AS phase, (event_type <> 'error' AND user_id % 20 <> event_id % 7) AS success, {d.long('floor(value * 10)')} AS duration_ms, {d.long(d.extract('props', '([0-9]+)'))} % 5 AS results FROM events"
    )


def steps(d: Dialect) -> str:
    """user_id, step (from 1 by time), action, target, success, reasoning."""
    action = "CASE event_type WHEN 'view' THEN 'navigate' WHEN 'click' THEN 'group' WHEN 'purchase' THEN 'dive' WHEN 'signup' THEN 'search' ELSE 'content-servers' END"
    return (
        f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, {action} AS action, concat('http://u', {string(d, 'user_id')}, '.example.com/', {d.extract('props', '([0-9]+)')}) AS target, "
        f"(event_type <> 'error') AS success, {cases([(f'event_id % 6 = {i}', lit(x)) for i, x in enumerate(REASONS)], lit('next'))} AS reasoning FROM events"
    )


#: What steps say of the pages that they meet.
REASONS = ("listing with cards", "detail with episodes", "content: servers and player", "search results", "many-links")


def found(d: Dialect) -> str:
    """page_id, finding, score: a set of heuristic findings for each page, by the bits of its number."""
    kinds = (("card-grid", 40), ("search-input", 90), ("episode-list", 85), ("server-container", 80), ("video-player", 90), ("pagination", 95), ("tabs", 88))
    return " UNION ALL ".join(f"SELECT page_id, {lit(k)} AS finding, {s} AS score FROM pages WHERE {d.long(f'floor(page_id / {2**i})')} % 2 = 1" for i, (k, s) in enumerate(kinds)) + f" UNION ALL SELECT page_id, 'metadata' AS finding, 70 AS score FROM pages"


def page_elements(d: Dialect) -> str:
    """page_id, seq, tag, type, class, cls (first class), id, parent, selector, txt, href, e_text, e_class, e_attrs, n_urls, n_data.

    A dialect that names parsed elements has those; else links, h1 and ad blocks by pattern.
    """
    if d.elements:
        return f"SELECT * FROM {d.elements}"
    link = f"SELECT page_id, seq0 AS seq, 'a' AS tag, 'link' AS type, '' AS cls, 'li' AS parent, {d.extract('m.x', '>([^<]*)')} AS txt, {d.extract('m.x', 'href=.([^>]*).>')} AS href FROM pages {d.numbered(d.all('html', '(<a href=[^>]*>[^<]*)</a>'), 'm', 'x')}"
    head = f"SELECT page_id, 1000 AS seq, 'h1' AS tag, 'heading' AS type, '' AS cls, 'article' AS parent, {d.extract('html', '<h1>([^<]*)</h1>')} AS txt, '' AS href FROM pages"
    box = f"SELECT page_id, 1001 AS seq, 'div' AS tag, 'container' AS type, 'ad' AS cls, 'body' AS parent, {d.extract('html', '<div class=.ad.>([^<]*)</div>')} AS txt, '' AS href FROM pages"
    return (
        f"SELECT page_id, seq, tag, type, cls AS class, cls, '' AS id, parent, CASE WHEN cls <> '' THEN concat(tag, '.', cls) ELSE tag END AS selector, substr(trim(txt), 1, 60) AS txt, href, lower(substr(trim(txt), 1, 60)) AS e_text, lower(cls) AS e_class, lower(concat(href, ' ', cls, ' ', CASE WHEN href <> '' THEN 'href' ELSE 'class' END)) AS e_attrs, "
        f"CASE WHEN href <> '' AND NOT {d.like('href', '^(#|javascript:|about:blank$)')} THEN 1 ELSE 0 END AS n_urls, 0 AS n_data FROM ({link} UNION ALL {head} UNION ALL {box}) v_el"
    )


def class_members(d: Dialect) -> str:
    """page_id, seq, class, cls, e_text, type: a user's log as a page whose elements have the log's classes."""
    cls = "CASE WHEN class = '' THEN 'plain' ELSE class END"
    return f"SELECT e.user_id AS page_id, a.seq, {cls} AS class, {cls} AS cls, lower(concat(a.element_type, ' ', a.class)) AS e_text, CASE WHEN a.seq % 2 = 0 THEN 'link' ELSE 'clickable' END AS type FROM ({attempts(d)}) a JOIN events e ON e.event_id = a.seq"


def titles(d: Dialect) -> str:
    return "SELECT DISTINCT p_name AS title FROM part"


def candidates(d: Dialect) -> str:
    """source, title, results."""
    return "SELECT p_brand AS source, p_name AS title, count(*) AS results FROM part GROUP BY p_brand, p_name"


def page_host(d: Dialect) -> str:
    return f"SELECT page_id, url, {urls.domain(d, 'url')} AS host FROM pages"
