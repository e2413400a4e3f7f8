"""URL functions (U1-U28) as SQL text. Each takes SQL for its arguments and gives SQL for its result.

A URL parses if it has a scheme and a host; each function states what it gives otherwise.
"""

from __future__ import annotations

from pagemill.functions import rules as R
from pagemill.functions.dialect import Dialect, cases, lit

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host(d: Dialect, url: str) -> str:
    """U4: lower-case host; empty where the URL does not parse."""
    return f"lower({d.extract(url, _HOST)})"


def domain(d: Dialect, url: str) -> str:
    """Host less a leading www.; unparsed: up to the first of / ? #, or the first 40 characters when that is empty."""
    bare = d.extract(d.sub(url, r"^(.*?)https?://(.*)$", "<1><2>"), r"^([^/?#]*)")
    return f"CASE WHEN {host(d, url)} <> '' THEN {d.sub(host(d, url), r'^www\.')} ELSE coalesce(nullif({bare}, ''), substr({url}, 1, 40)) END"


def domain_any_www(d: Dialect, url: str) -> str:
    """Host less the first www. anywhere; unparsed: the first 40 characters."""
    return f"CASE WHEN {host(d, url)} <> '' THEN {d.sub(host(d, url), r'^(.*?)www\.', '<1>')} ELSE substr({url}, 1, 40) END"


def base_domain(d: Dialect, dom: str) -> str:
    """U5."""
    return d.sub(dom, r"^(ww[0-9]+|vww|www[0-9]*)\.")


def path(d: Dialect, url: str) -> str:
    """Path, at least /; unparsed: the whole URL."""
    return f"CASE WHEN {host(d, url)} <> '' THEN coalesce(nullif({d.extract(url, _PATH)}, ''), '/') ELSE {url} END"


def extension(d: Dialect, url: str) -> str:
    """File extension of the path; unparsed or none: empty."""
    return f"CASE WHEN {host(d, url)} <> '' THEN {d.extract(d.extract(url, _PATH), r'\.([a-zA-Z0-9]{2,5})($|\?)')} ELSE '' END"


def server_name(d: Dialect, dom: str) -> str:
    """One prefix off, the label before the last (or the only one), its first letter a capital, 25 characters at most."""
    bare = d.sub(dom, "(?i)" + R.SERVER_PREFIXES)
    main = f"CASE WHEN {d.like(bare, r'\.')} THEN {d.extract(bare, r'([^.]*)\.[^.]*$')} ELSE {bare} END"
    return f"concat(upper(substr({main}, 1, 1)), substr({main}, 2, 24))"


def is_direct_video(d: Dialect, url: str) -> str:
    """U8."""
    return d.like(f"lower({url})", R.DIRECT_VIDEO)


def clean_url(d: Dialect, url: str) -> str:
    """U9."""
    return f"CASE WHEN {d.like(url, '^//')} THEN concat('https:', {url}) ELSE {url} END"


def stream_type(d: Dialect, url: str) -> str:
    """The first matching type, else other."""
    return cases([(d.like(f"lower({url})", p), lit(t)) for t, p in R.STREAM_TYPES], "'other'")


def stream_fingerprint(d: Dialect, url: str) -> str:
    """Cut at the first ? or #, one trailing slash off, lower case."""
    return f"lower({d.sub(d.sub(url, r'[?#].*'), '/$')})"


def catalog_fingerprint(d: Dialect, url: str) -> str:
    """Host without www., path, ?, sorted parameters; unparsed: no scheme, up to ?, 60 characters."""
    query = d.extract(url, r"\?([^#]*)")
    parts = d.split(query, "&")
    ordered = d.join(f"array_sort({parts})" if d.spark else f"list_sort({parts})", "&")
    parsed = f"concat({d.sub(host(d, url), r'^www\.')}, {path(d, url)}, '?', {ordered})"
    return f"CASE WHEN {host(d, url)} <> '' THEN {parsed} ELSE substr({d.extract(d.sub(url, r'^https?://'), r'^([^?]*)')}, 1, 60) END"


def visited_fingerprint(d: Dialect, url: str) -> str:
    """Up to ?, trailing slashes off, a last numeric segment as X."""
    return d.sub(d.sub(d.extract(url, r"^([^?]*)"), "/+$"), r"/\d+$", "/X")


def path_pattern(d: Dialect, url: str) -> str:
    """/seg/number as {num}, the first NxM as {ep}, a last plain segment as {slug}; unparsed: empty."""
    p = d.sub(d.sub(path(d, url), r"/[^/]+/\d+$", "/{num}"), r"^(.*?)\d+x\d+", "<1>{ep}")
    segments = d.keep(d.split(p, "/"), "x <> ''")
    flat = f"concat('/', {d.join(segments, '/')}, '/')"
    last = d.extract(flat, r"/([^/]*)/$")
    plain = f"{last} <> '' AND NOT {d.like(last, '[{]')} AND NOT {d.like(last, r'^\d+$')}"
    empty = f"{d.size(segments)} = 0"
    return f"CASE WHEN {host(d, url)} = '' THEN '' WHEN {empty} THEN '//' WHEN {plain} THEN {d.sub(flat, r'/[^/]*/$', '/{slug}/')} ELSE {flat} END"


def profile_pattern(d: Dialect, url: str, least: int = 20) -> str:
    """U15, and U16 with least=10: every numeric segment start as {num}, long plain segments as {slug}; unparsed: empty."""
    return f"CASE WHEN {host(d, url)} = '' THEN '' ELSE {d.sub(d.sub(path(d, url), r'/\d+', '/{num}'), '/[a-z0-9-]{' + str(least) + ',}', '/{slug}')} END"


def pagination(d: Dialect, url: str, what: str) -> str:
    """One of pattern, base, page, template."""
    suffix, query, segment = r"(?i)^(.+?)(?:_(\d+))?\.html$", r"(?i)[?&]page=(\d+)", r"(?i)/page/(\d+)"
    stem = d.extract(url, suffix, 1)
    no_query = d.sub(d.sub(url, r"(?i)[?&]page=\d+"), "[?&]$")
    no_segment = d.sub(url, r"(?i)/page/\d+")
    values = {
        "pattern": ("'suffix-counter'", "'query-param'", "'path-segment'", "'none'"),
        "base": (f"CASE WHEN {d.extract(url, suffix, 2)} <> '' THEN concat({stem}, '.html') ELSE {url} END", no_query, no_segment, url),
        "page": (f"coalesce({d.try_long(d.extract(url, suffix, 2))}, 1)", d.try_long(d.extract(url, query)), d.try_long(d.extract(url, segment)), "1"),
        "template": (f"concat({stem}, '_{{page}}.html')", f"concat({no_query}, CASE WHEN {d.like(no_query, '[?]')} THEN '&page={{page}}' ELSE '?page={{page}}' END)", f"concat({no_segment}, '/page/{{page}}/')", url),
    }[what]
    return cases([(d.like(url, p), v) for p, v in zip((suffix, query, segment), values, strict=False)], values[3])


def total_pages(d: Dialect, pattern: str, body: str) -> str:
    """Largest _N.html for suffix counters, else M of the first "pagina N de M"; null without either."""
    numbers = d.all(body, r"(?i)_(\d+)\.html")
    most = f"array_max(transform({numbers}, x -> CAST(x AS BIGINT)))" if d.spark else f"list_max(list_transform({numbers}, lambda x: CAST(x AS BIGINT)))"
    text = d.try_long(d.extract(body, r"(?i)pagina\s*\d+\s*(?:de|of|/)\s*(\d+)"))
    return f"CASE WHEN {pattern} = 'suffix-counter' AND {d.size(numbers)} > 0 THEN {most} ELSE {text} END"


def page_url(d: Dialect, template: str, n: str) -> str:
    """The first {page} replaced."""
    return f"replace({template}, '{{page}}', CAST({n} AS {'STRING' if d.spark else 'VARCHAR'}))"


def identifiers(d: Dialect, url: str) -> tuple[str, str]:
    """(slug, title) from the last path segment."""
    slug = d.sub(d.extract(path(d, url), r"([^/]+)/*$"), r"(?i)\.html?$")
    return slug, d.sub(slug, "[-_]", " ")


def is_affiliate(d: Dialect, url: str) -> str:
    """Host is one of the domains or below one."""
    names = "|".join(x.replace(".", r"\.") for x in R.AFFILIATE_DOMAINS)
    return d.like(host(d, url), rf"(^|\.)({names})$")


def cookie_pair(d: Dialect, cookie: str) -> str:
    """The text before the first semicolon."""
    return f"trim({d.extract(cookie, '^([^;]*)')})"


def search_url(d: Dialect, template: str, query: str, base: str) -> str:
    """{query} filled percent-encoded, the base in front unless the template has a scheme."""
    coded = f"replace(url_encode({query}), '+', '%20')" if d.spark else f"url_encode({query})"
    filled = f"replace({template}, '{{query}}', {coded})"
    return f"CASE WHEN {d.like(template, '^http')} THEN {filled} ELSE concat({base}, {filled}) END"


def escape_html(d: Dialect, text: str) -> str:
    """U28."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = f"replace({text}, {d.text(raw)}, {d.text(safe)})"
    return text


def classified(d: Dialect, source: str, url: str = "url", context: str = "context") -> str:
    """U1 as a SELECT: all columns of ``source`` with type, confidence, is_container, signals (joined by commas).

    ``source`` must have one row for each URL, with the context of its first use:
    a URL's class is settled the first time it is seen.
    """
    a = f"SELECT *, lower({url}) AS c_low, {domain(d, url)} AS c_dom, lower({path(d, url)}) AS c_path, {extension(d, url)} AS c_ext, lower(coalesce({context}, '')) AS c_ctx FROM {source}"
    b = f"SELECT *, {d.extract('lower(c_dom)', r'^([^.]*)')} AS c_first, {d.like('lower(c_dom)', R.SUBDOMAINS)} AS c_sub, {d.try_long(d.extract('c_low', r':([0-9]{4,5})'))} AS c_port FROM ({a}) c_a"
    by_sub = [(f"c_sub AND {d.like('c_first', p)}", lit(t)) for t, p, _ in R.SUBDOMAIN_TYPES]
    sub_conf = [(f"c_sub AND {d.like('c_first', p)}", str(n)) for _, p, n in R.SUBDOMAIN_TYPES]
    c = f"SELECT *, {cases(by_sub, lit('unknown'))} AS c_t0, {cases(sub_conf, '20')} AS c_n0, coalesce(c_port BETWEEN 8000 AND 9999, false) AS c_media FROM ({b}) c_b"
    e = f"SELECT *, CASE WHEN c_t0 = 'unknown' AND c_media THEN 'embed' ELSE c_t0 END AS c_t1 FROM ({c}) c_c"
    ext = [(d.like("c_low", p), lit(t)) for t, p, _ in R.EXTENSION_TYPES]
    ext_conf = cases([(d.like("c_low", p), str(n)) for _, p, n in R.EXTENSION_TYPES], "0")
    f = f"SELECT *, {cases(ext, 'c_t1')} AS c_t2, {ext_conf} AS c_n2, (c_t1 = 'unknown' AND {d.like('lower(c_dom)', R.ALT_TLDS)}) AS c_tld FROM ({e}) c_e"
    found = [(sig, t, d.like("c_path", p), n, box) for sig, t, p, n, box in R.PATH_RULES] + [(sig, t, f"(c_ctx <> '' AND {d.like('c_ctx', p)})", n, box) for sig, t, p, n, box in R.CONTEXT_RULES]
    kind = cases([("c_t2 <> 'unknown'", "c_t2"), *((cond, lit(t)) for _, t, cond, _, _ in found if t)], lit("unknown"))
    tracking = d.like("lower(c_dom)", R.TRACKING_HOSTS)
    level = ", ".join(["c_n0", "c_n2", "CASE WHEN c_media THEN 60 ELSE 0 END", "CASE WHEN c_tld THEN 40 ELSE 0 END", *(f"CASE WHEN {cond} THEN {n} ELSE 0 END" for _, _, cond, n, _ in found)])
    boxes = " OR ".join(["c_t0 = 'embed'", *(cond for _, _, cond, _, box in found if box)])
    auth, redirect = d.like("c_low", R.QUERY_AUTH), d.like("c_low", R.QUERY_REDIRECT)
    signals = [
        "CASE WHEN c_sub THEN concat('subdomain:', c_first) END", f"CASE WHEN c_media THEN concat('port:', CAST(c_port AS {'STRING' if d.spark else 'VARCHAR'})) END", "CASE WHEN c_tld THEN 'tld:alt' END",
        "CASE WHEN c_n2 > 0 THEN concat('ext:', c_ext) END", *(f"CASE WHEN {cond} THEN {lit(sig)} END" for sig, _, cond, _, _ in found),
        f"CASE WHEN {auth} THEN 'query:auth' END", f"CASE WHEN {redirect} THEN 'query:redirect' END", f"CASE WHEN {tracking} THEN 'domain:tracking' END",
    ]
    drop = "c_low, c_dom, c_path, c_ext, c_ctx, c_first, c_sub, c_port, c_t0, c_n0, c_media, c_t1, c_t2, c_n2, c_tld"
    g = (
        f"SELECT *, CASE WHEN {tracking} THEN 'tracking' ELSE {kind} END AS type, CASE WHEN {tracking} THEN 80 ELSE least(100, greatest({level})) END AS confidence, "
        f"CASE WHEN {redirect} THEN true WHEN {auth} THEN false ELSE ({boxes}) END AS is_container, concat_ws(',', {', '.join(signals)}) AS signals FROM ({f}) c_f"
    )
    return f"SELECT * {'EXCEPT' if d.spark else 'EXCLUDE'} ({drop}) FROM ({g}) c_g"
