"""Named queries over the test tables: one SQL rule each, run by Spark and checked in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.functions import elements as E
from pagemill.functions import rules as R
from pagemill.functions import streams as S
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.functions.dialect import DUCK, SPARK, Dialect, cases, lit
from pagemill.sources import views as V

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
RULES: dict[str, Callable[[Dialect], str]] = {}


def rule(f: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    RULES[f.__name__] = f
    return f


def run(name: str, spark: SparkSession, sf_dir: str, d: Dialect = SPARK) -> DataFrame:
    """Run a rule over the Parquet tables of a folder."""
    body = RULES[name](d)
    used = [t for t in _TABLES if t in re.findall(r"\w+", body)]
    source = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in used} | ({"pages": d.pages} if d.pages else {})
    with_ = ", ".join(f"{t} AS (SELECT * FROM {source[t]})" for t in used)
    return spark.sql(f"WITH {with_} {body}" if used else body)


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(name, spark, sf_dir)


#: Sums of doubles; sums of anything else without a decimal literal are of whole numbers.
_DOUBLE_SUMS = ("won", "rate * n")


def _closing(sql: str, start: int) -> int:
    """Index past the parenthesis that closes the one before ``start``."""
    depth = 1
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[start], 0)
        start += 1
    return start


def whole_sums(sql: str) -> str:
    """DuckDB gives whole-number sums 128 bits; cast them to the 64 that Spark gives."""
    out, at = "", 0
    while (i := sql.find("sum(", at)) >= 0:
        end = _closing(sql, i + 4)
        inner = sql[i + 4 : end - 1]
        window = sql[end:].startswith(" OVER (")
        call = f"sum({whole_sums(inner)})"
        if window or inner in _DOUBLE_SUMS or re.search(r"\de-?\d", inner):
            out += sql[at:i] + call
        else:
            out += f"{sql[at:i]}CAST({call} AS BIGINT)"
        at = end
    return out + sql[at:]


def oracle(name: str) -> str:
    return whole_sums(RULES[name](DUCK))


# -- URLs -----------------------------------------------------------------------


def _first_urls(d: Dialect) -> str:
    """Distinct (page, url) at its first place, with the scan's context."""
    return f"SELECT page_id, url, min(seq) AS seq, 'static-scan' AS context FROM ({V.links(d)}) f_l GROUP BY page_id, url"


@rule
def static_catalog(d: Dialect) -> str:
    """Per page, URLs by server, the first eight of each, with their count; servers of most URLs first."""
    named = f"SELECT *, {U.domain(d, 'url')} AS dom FROM ({U.classified(d, f'({_first_urls(d)}) s_f')}) s_c"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY page_id, server ORDER BY seq) AS rn FROM (SELECT *, {U.server_name(d, 'dom')} AS server FROM ({named}) s_n) s_s"
    grouped = f"SELECT page_id, server, {d.first('dom', 'seq')} AS domain, count(*) AS n_urls, min(seq) AS first_seq, {d.joined('url', ' ', 'seq')} AS urls, {d.joined('type', ' ', 'seq')} AS types FROM ({ranked}) s_r WHERE rn <= 8 GROUP BY page_id, server"
    return f"SELECT page_id, server, domain, n_urls, urls, types, row_number() OVER (PARTITION BY page_id ORDER BY n_urls DESC, first_seq) AS rank FROM ({grouped}) s_g"


@rule
def url_classify(d: Dialect) -> str:
    """U1."""
    return U.classified(d, f"({V.urls_of_pages(d)}) u_p")


@rule
def url_class_counts(d: Dialect) -> str:
    """U1 A19."""
    return f"SELECT type, is_container, count(*) AS n, sum(confidence) AS confidence FROM ({url_classify(d)}) u_c GROUP BY type, is_container"


@rule
def url_server_name(d: Dialect) -> str:
    """U2 U3 U4 U5 U7."""
    return f"SELECT page_id, {U.domain(d, 'url')} AS domain, {U.domain_any_www(d, 'url')} AS crawl_domain, {U.host(d, 'url')} AS host, {U.base_domain(d, U.domain(d, 'url'))} AS base_domain, {U.server_name(d, U.domain(d, 'url'))} AS server FROM ({V.urls_of_pages(d)}) u_p"


@rule
def url_fingerprint(d: Dialect) -> str:
    """U6 U8 U9 U10 U11 U12 U13."""
    return (
        f"SELECT page_id, {U.path(d, 'url')} AS path, {U.extension(d, 'url')} AS ext, {U.is_direct_video(d, 'url')} AS direct_video, {U.clean_url(d, 'url')} AS clean_url, {U.stream_type(d, 'url')} AS stream_type, "
        f"{U.stream_fingerprint(d, 'url')} AS stream_fp, {U.catalog_fingerprint(d, 'url')} AS catalog_fp, {U.visited_fingerprint(d, 'url')} AS visited_fp FROM (SELECT page_id, url FROM ({V.urls_of_pages(d)}) u_p UNION ALL SELECT page_id + 1000000, url FROM pages) u_q"
    )


@rule
def url_path_pattern(d: Dialect) -> str:
    """U14 U15 U16."""
    return f"SELECT page_id, {U.path_pattern(d, 'url')} AS path_pattern, {U.profile_pattern(d, 'url')} AS profile_pattern, {U.profile_pattern(d, 'url', 10)} AS episode_pattern FROM pages"


@rule
def url_identifiers(d: Dialect) -> str:
    """U21 U25 U26 U28."""
    slug, title = U.identifiers(d, "url")
    return f"SELECT page_id, {slug} AS slug, {title} AS title, {U.cookie_pair(d, 'concat(url, {})'.format(lit('; Path=/')))} AS cookie, md5({U.escape_html(d, 'html')}) AS escaped FROM pages"


@rule
def url_pagination(d: Dialect) -> str:
    """U18 U19; 0 where the number of pages is unknown."""
    got = ", ".join(f"{U.pagination(d, 'url', w)} AS {n}" for w, n in (("pattern", "pattern"), ("base", "base_url"), ("page", "current_page"), ("template", "template")))
    return f"SELECT page_id, pattern, base_url, current_page, template, coalesce({U.total_pages(d, 'pattern', 'html')}, 0) AS total_pages FROM (SELECT page_id, html, {got} FROM pages) u_g"


@rule
def page_url_expand(d: Dialect) -> str:
    """The page URLs of each paginated page, fifty at most as the crawl sets; as many as it says, else up to the one it shows."""
    last = f"least({R.MOST_PAGES}, greatest(1, CASE WHEN total_pages > 0 THEN total_pages ELSE coalesce(current_page, 1) END))"
    numbers = f"LATERAL VIEW explode(sequence(1, last)) u_n AS n" if d.spark else ", LATERAL (SELECT unnest(range(1, last + 1)) AS n) u_n"
    return f"SELECT page_id, CAST(n AS INT) AS n, {U.page_url(d, 'template', 'n')} AS page_url FROM (SELECT *, CAST({last} AS INT) AS last FROM ({url_pagination(d)}) u_t WHERE pattern <> 'none') u_l {numbers}"


@rule
def url_chains(d: Dialect) -> str:
    """Chains of a domain's path patterns to result types."""
    kind = "CASE page_id % 3 WHEN 0 THEN 'servers' WHEN 1 THEN 'download' ELSE 'embed' END"
    rows = f"SELECT page_id AS seq, url, {U.domain_any_www(d, 'url')} AS domain, {U.path_pattern(d, 'url')} AS from_pattern, {kind} AS to_type FROM pages"
    return f"SELECT domain, from_pattern, to_type, least(100, 60 + 20 * (count(*) - 1)) AS confidence, substr({d.first('url', 'seq')}, 1, 80) AS sample_from FROM ({rows}) u_r WHERE length(from_pattern) >= 3 GROUP BY domain, from_pattern, to_type"


@rule
def url_candidates(d: Dialect) -> str:
    """Path templates of a host that occur twice or more, filled with a term's slug."""
    segments = d.keep(d.split(U.path(d, "url"), "/"), "x <> ''")
    rows = f"SELECT page_id, {U.host(d, 'url')} AS host, {segments} AS segs FROM pages"
    each = f"SELECT page_id, host, segs, s.seg AS seg, s.seq0 AS i FROM ({rows}) u_s {d.numbered('segs', 's', 'seg')}"
    masked = "CASE WHEN m.j = i THEN '{slug}' WHEN " + d.like("m.part", r"^\d+$") + " OR " + d.like("m.part", r"\d+x\d+") + " THEN '{num}' ELSE m.part END"
    if d.spark:
        parts = f"SELECT page_id, host, i, j, {masked.replace('m.', '')} AS part FROM ({each}) u_e LATERAL VIEW posexplode(segs) m AS j, part"
    else:
        parts = f"SELECT page_id, host, i, m.j AS j, {masked} AS part FROM ({each}) u_e, LATERAL (SELECT unnest(range(len(segs))) AS j, unnest(segs) AS part) m"
    made = f"SELECT page_id, host, i, concat('/', {d.joined('part', '/', 'j')}, '/') AS pattern FROM ({parts}) u_m GROUP BY page_id, host, i"
    counts = f"SELECT host, pattern, count(*) AS n FROM ({made}) u_k GROUP BY host, pattern HAVING count(*) >= 2"
    filled = d.sub("replace(pattern, '{slug}', 'naruto-shippuden')", "[{]num[}]")
    return f"SELECT host, pattern, n, least(100, n * 25) AS confidence, concat('http://', host, {filled}) AS candidate, row_number() OVER (PARTITION BY host ORDER BY least(100, n * 25) DESC, n DESC, pattern) AS rank FROM ({counts}) u_c"


@rule
def affiliate_flag(d: Dialect) -> str:
    """U23 J10."""
    names = cases([(f"page_id % {len(R.AFFILIATE_DOMAINS) + 4} = {i}", lit(x)) for i, x in enumerate(R.AFFILIATE_DOMAINS)], "'example.com'")
    rows = f"SELECT page_id, concat('https://', CASE WHEN page_id % 3 = 0 THEN 'go.' WHEN page_id % 3 = 1 THEN 'not' ELSE '' END, {names}, '/r') AS url FROM pages"
    return f"SELECT page_id, url, {U.is_affiliate(d, 'url')} AS affiliate FROM ({rows}) u_a"


@rule
def url_antijoin(d: Dialect) -> str:
    """Links that no earlier page of the scan had, without ads and static files."""
    known = f"SELECT url, min(page_id) AS first_page FROM ({V.links(d)}) u_k GROUP BY url"
    first = f"SELECT l.page_id, l.url, min(l.seq) AS seq FROM ({V.links(d)}) l JOIN ({known}) k ON l.url = k.url AND l.page_id = k.first_page GROUP BY l.page_id, l.url"
    return f"SELECT * FROM ({first}) u_f WHERE url <> '' AND NOT {d.like('lower(url)', R.AD_HOSTS)} AND NOT {d.like('lower(url)', R.STATIC_FILES)}"


@rule
def substring_join(d: Dialect) -> str:
    """Catalog entries whose URL holds a node's, or whose domain a node's URL holds, counted for each node."""
    nodes = f"SELECT DISTINCT {U.host(d, 'url')} AS node FROM ({V.urls_of_pages(d)}) j_n"
    entries = f"SELECT url, {U.domain(d, 'url')} AS domain FROM ({V.urls_of_pages(d)}) j_e"
    # Both ways of containing stand between hosts, of which there are few; URLs are counted by host first.
    hosts = f"SELECT {U.host(d, 'url')} AS host, domain, count(*) AS n FROM ({entries}) j_h GROUP BY {U.host(d, 'url')}, domain"
    return f"SELECT n.node, sum(h.n) AS hits FROM ({nodes}) n JOIN ({hosts}) h ON contains(h.host, n.node) OR contains(n.node, h.domain) GROUP BY n.node"


@rule
def known_servers(d: Dialect) -> str:
    """Labels that hold the name of a known server."""
    label = cases([(f"page_id % {len(R.KNOWN_SERVERS) + 6} = {i}", lit(f"Opcion {x} HD")) for i, x in enumerate(R.KNOWN_SERVERS)], "'server 1'")
    known = " OR ".join(f"contains(lower(label), {lit(x.lower())})" for x in R.KNOWN_SERVERS)
    return f"SELECT page_id, label, ({known}) AS known FROM (SELECT page_id, {label} AS label FROM pages) j_l"


@rule
def findings_buckets(d: Dialect) -> str:
    """A page's URLs by class."""
    kinds = (("video", "'direct-video', 'stream'"), ("download", "'download'"), ("server", "'embed'"), ("navigation", "'navigation'"))
    known = ", ".join(x for _, x in kinds)
    cols = ", ".join(f"sum(CASE WHEN type IN ({x}) THEN 1 ELSE 0 END) AS {n}_urls" for n, x in kinds)
    return f"SELECT context, {cols}, sum(CASE WHEN type NOT IN ({known}) THEN 1 ELSE 0 END) AS other_urls, {d.joined('url', ' ', 'seq')} AS urls FROM ({url_classify(d)}) u_c GROUP BY context"


# -- streams --------------------------------------------------------------------


def _normal(d: Dialect) -> str:
    return S.normalized(d, f"({V.streams(d)}) s_v")


@rule
def stream_normalize(d: Dialect) -> str:
    """X7 X8 X9 U10 N9."""
    return _normal(d)


@rule
def stream_rank(d: Dialect) -> str:
    """The fifty of highest priority, earlier first."""
    return f"SELECT page_id, priority, rank FROM (SELECT page_id, priority, row_number() OVER (ORDER BY priority DESC, seq) AS rank FROM ({_normal(d)}) s_n) s_r WHERE rank <= 50"


@rule
def stream_dedup(d: Dialect) -> str:
    """O2: the first of each fingerprint, server and quality."""
    key = f"concat({U.stream_fingerprint(d, 'CASE WHEN direct_url <> {e} THEN direct_url ELSE url END'.format(e=lit('')))}, server, quality)"
    return f"SELECT page_id, k, server, quality FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM (SELECT *, {key} AS k FROM ({_normal(d)}) s_n) s_k) s_r WHERE rn = 1"


@rule
def pipeline_dedup(d: Dialect) -> str:
    """O3: the first of each cut URL and server; case and slash stay."""
    key = f"concat({d.extract('url', '^([^?#]*)')}, '|', server)"
    return f"SELECT page_id, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM (SELECT *, {key} AS k FROM ({_normal(d)}) s_n) s_k) s_r WHERE rn = 1"


@rule
def catalog_dedup(d: Dialect) -> str:
    """Per server the first URL of each 30-letter fingerprint, eight at most, with label, type, quality and language, and the server's size."""
    one = f"SELECT *, row_number() OVER (PARTITION BY server, fp ORDER BY seq) AS rn FROM (SELECT *, substr({U.catalog_fingerprint(d, 'url')}, 1, 30) AS fp FROM ({_normal(d)}) s_n) s_f"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY server ORDER BY seq) AS rank FROM ({one}) s_o WHERE rn = 1"
    kept = f"SELECT server, page_id, rank, {d.extract('labels', '^([^|]*)')} AS label, type, quality, language FROM ({ranked}) s_r WHERE rank <= 8"
    return f"SELECT *, count(*) OVER (PARTITION BY server) AS size FROM ({kept}) s_k"


@rule
def stream_enrich(d: Dialect) -> str:
    """Resolved URLs joined to streams, the first of each."""
    resolved = f"SELECT url, {d.first('direct_url', 'seq')} AS direct FROM ({V.streams(d)}) s_v WHERE direct_url <> '' GROUP BY url"
    kind = f"CASE WHEN coalesce(r.direct, '') = '' THEN s.type WHEN {U.is_direct_video(d, 'r.direct')} THEN 'mp4' ELSE 'm3u8' END"
    return f"SELECT s.page_id, s.url, coalesce(r.direct, '') AS direct, {kind} AS final_type FROM ({_normal(d)}) s LEFT JOIN ({resolved}) r ON s.url = r.url"


# -- text and matching ------------------------------------------------------------


@rule
def text_similarity(d: Dialect) -> str:
    """X1 X2 X3."""
    return f"SELECT a.title AS a, b.title AS b, {X.similarity(d, 'a.title', 'b.title')} AS similarity FROM ({V.titles(d)}) a JOIN ({V.titles(d)}) b ON a.title <= b.title"


@rule
def title_similarity(d: Dialect) -> str:
    """X4 X5 X6."""
    return f"SELECT a.title AS a, b.title AS b, {X.title_similarity(d, 'a.title', 'b.title')} AS similarity FROM ({V.titles(d)}) a JOIN ({V.titles(d)}) b ON a.title <= b.title"


@rule
def cross_source_match(d: Dialect) -> str:
    """The best title of each source for a query, of 0.4 and more; every title is a query."""
    wanted = f"SELECT title AS query FROM ({V.titles(d)}) t_t"
    scored = f"SELECT q.query, c.source, c.title, c.results, {X.title_similarity(d, 'q.query', 'c.title')} AS score FROM ({V.candidates(d)}) c JOIN ({wanted}) q ON true"
    return f"SELECT query, source, title, results, score FROM (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, title) AS rn FROM ({scored}) t_s WHERE score >= 4e-1) t_k WHERE rn = 1"


@rule
def result_count_pick(d: Dialect) -> str:
    """The source of most results, five more from twenty on, then the score, then the name."""
    return f"SELECT query, source, title, results, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY results + CASE WHEN results >= 20 THEN 5 ELSE 0 END DESC, score DESC, source) AS rn FROM ({cross_source_match(d)}) t_m) t_p WHERE rn = 1"


# -- elements and pages -----------------------------------------------------------


def _elements(d: Dialect) -> str:
    return f"({V.page_elements(d)}) e_v"


@rule
def element_intent(d: Dialect) -> str:
    """E1 X15; one result for each selector and text."""
    return f"SELECT page_id, seq, action, intent_confidence FROM ({E.intents(d, _elements(d))}) e_i"


@rule
def element_score(d: Dialect) -> str:
    """E2 E1."""
    return f"SELECT page_id, seq, score, relevance FROM ({E.relevance(d, f'({E.intents(d, _elements(d))}) e_i')}) e_s"


@rule
def element_zone(d: Dialect) -> str:
    """E3."""
    return f"SELECT page_id, seq, zone, zone_confidence FROM ({E.zones(d, _elements(d))}) e_z"


@rule
def element_priority(d: Dialect) -> str:
    """Elements in order of relevance, without weak footers, weak headers, ads, social and login."""
    whole = E.zones(d, f"({E.relevance(d, f'({E.intents(d, _elements(d))}) e_i')}) e_s")
    # The window stands between the rules and the filter: else the filter is pushed down with all of them written out.
    marked = f"SELECT *, NOT (zone = 'footer' AND relevance <> 'high') AND NOT (zone = 'header' AND relevance = 'low') AND action NOT IN ('ad', 'social', 'login') AS keeps FROM ({whole}) e_w"
    ranked = f"SELECT page_id, seq, score, keeps, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN keeps THEN 0 ELSE 1 END, CASE WHEN relevance = 'skip' THEN 1 ELSE 0 END, score DESC, seq) AS rank FROM ({marked}) e_k"
    return f"SELECT page_id, seq, score, rank FROM ({ranked}) e_r WHERE keeps"


@rule
def dominant_zone(d: Dialect) -> str:
    """A page's most frequent zone, the first seen of equals."""
    return f"SELECT page_id, zone FROM (SELECT page_id, zone, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(seq)) AS rn FROM ({element_zone(d)}) e_z GROUP BY page_id, zone) e_r WHERE rn = 1"


@rule
def page_type(d: Dialect) -> str:
    """Additive scores for listing, detail, content, search; from 40 typed, from 20 to explore."""
    both = "concat(e_class, e_text)"
    text_class = "concat(e_text, e_class)"
    count = lambda cond: f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"
    aggs = {
        "links": "type = 'link' AND href <> '' AND NOT " + d.like("href", "^#"), "paged": d.like(both, "pagin|page|naveg"), "inputs": "type = 'input'", "frames": "type = 'iframe'", "media": "type = 'media'",
        "episodes": f"type = 'list-item' AND {d.like('e_text', '[0-9]')} AND " + d.like(text_class, r"episod|capitul|chapter|season|temporada|ep\.?\s*\d|cap\.?\s*\d"),
        "genres": f"{d.like('e_text', R.GENRES)} AND length(e_text) < 20", "seasons": d.like(text_class, r"season|temporada|temp\.?\s*\d"),
        "servers": "type = 'clickable' AND " + d.like(text_class, "server|servidor|opcion|mirror|source|fuente|calidad|quality|hd|sd|720|1080"), "downloads": "type = 'clickable' AND " + d.like(text_class, "download|descarg"),
        "langs": d.like(text_class, "idioma|language|lang|audio|dub|sub|latino|castellano|japones|english"), "embeds": "type = 'link' AND href <> '' AND " + d.like("lower(concat(href, e_text))", "embed|player|video|stream|watch|ver"),
    }
    sums = f"SELECT page_id, {', '.join(f'{count(c)} AS {n}' for n, c in aggs.items())} FROM {_elements(d)} GROUP BY page_id"
    cards = f"SELECT DISTINCT page_id, 1 AS cards FROM ({_repeating(_elements(d), 4)}) e_c"
    rows = f"SELECT s.*, coalesce(c.cards, 0) AS cards, lower(p.url) AS u FROM ({sums}) s JOIN pages p ON p.page_id = s.page_id LEFT JOIN ({cards}) c ON c.page_id = s.page_id"
    when = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
    listing = " + ".join([when("cards > 0", 30), when("links > 20", 15), when("paged > 0", 15), when("inputs > 0", 10), when(d.like("u", "catalogo|directory|browse|list|home|index|inicio"), 15)])
    detail = " + ".join([when("episodes >= 3", 40), when("genres >= 2", 15), when("seasons >= 1", 15), when(d.like("u", "/anime/|/ver/|/detail/|/show/|/series/") + " AND NOT " + d.like("u", "episode|capitulo"), 15)])
    content = " + ".join([
        when("frames > 0", 35), when("media > 0", 35), when("servers >= 2", 30), when("downloads > 0", 10), when("langs >= 1", 10), when(d.like("u", "episode|episodio|capitulo|chapter|ver/"), 20),
        when(d.like("u", "/(ver|watch|play|player|video|pelicula|movie)/"), 25), when("embeds >= 2", 20),
    ])
    watch = d.like("u", "/(ver|watch|play|player|video)/")
    search = when(d.like("u", "search|buscar|busqueda|find|query|q="), 30)
    scored = f"SELECT page_id, {listing} AS a, {detail} AS b, CASE WHEN {watch} THEN greatest(50, {content}) ELSE {content} END AS c, {search} AS s FROM ({rows}) e_r"
    best = "greatest(a, b, c, s)"
    kind = f"CASE WHEN {best} < 20 THEN 'unknown' WHEN a = {best} THEN 'listing' WHEN b = {best} THEN 'detail' WHEN c = {best} THEN 'content' ELSE 'search' END"
    plan = f"CASE WHEN {best} < 40 THEN 'explore' WHEN a = {best} THEN 'extract-links' WHEN b = {best} THEN 'find-episodes' WHEN c = {best} THEN 'click-servers' ELSE 'search-results' END"
    return f"SELECT page_id, a AS listing, b AS detail, c AS content, s AS search, {kind} AS type, CASE WHEN {best} >= 20 THEN least(100, {best}) ELSE 0 END AS confidence, {plan} AS strategy FROM ({scored}) e_k"


def _repeating(source: str, least: int) -> str:
    """A page's five most repeated first classes of 3 to 39 letters, the first seen of equals."""
    counts = f"SELECT page_id, cls, count(*) AS n, min(seq) AS seen FROM {source} WHERE length(cls) BETWEEN 3 AND 39 GROUP BY page_id, cls HAVING count(*) >= {least}"
    return f"SELECT page_id, cls, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, seen) AS rank FROM ({counts}) e_c) e_k WHERE rank <= 5"


def _class_source(d: Dialect) -> str:
    return f"({V.page_elements(d) if d.elements else V.class_members(d)}) e_m"


@rule
def repeating_classes(d: Dialect) -> str:
    """Repeated classes, from four on, and the elements whose classes hold the name."""
    top = _repeating(_class_source(d), 4)
    return f"SELECT r.page_id, r.cls, r.n, r.rank, count(*) AS holding FROM ({top}) r JOIN {_class_source(d)} ON e_m.page_id = r.page_id AND contains(e_m.class, r.cls) GROUP BY r.page_id, r.cls, r.n, r.rank"


@rule
def card_classes(d: Dialect) -> str:
    """Class names of 3 to 40 letters with a card's keyword on 3 to 500 elements of a page, the five most frequent."""
    words = "|".join(R.CARD_WORDS)
    tokens = f"SELECT page_id, seq, t.tok AS tok FROM {_class_source(d)} {d.numbered(d.keep(d.split('class', R.SPACES), 'length(x) BETWEEN 3 AND 40'), 't', 'tok')}"
    counts = f"SELECT page_id, tok AS cls, count(*) AS n, min(seq) AS seen FROM ({tokens}) e_t WHERE {d.like('lower(tok)', words)} GROUP BY page_id, tok HAVING count(*) BETWEEN 3 AND 500"
    return f"SELECT page_id, cls, n, least(5 * n, 100) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, seen, cls) AS rank FROM ({counts}) e_c) e_k WHERE rank <= 5"


@rule
def page_goal(d: Dialect) -> str:
    """X10."""
    return f"SELECT page_id, {X.goal(d, 'lower(t)', 'false')} AS goal FROM (SELECT page_id, {d.joined('txt', ' ', 'seq')} AS t FROM {_elements(d)} GROUP BY page_id) e_g"


@rule
def element_groups(d: Dialect) -> str:
    """A parent's 2 to 20 clickable children of three first classes at most, two of them and more without login and social words."""
    own = f"type IN ('clickable', 'link') AND length(txt) > 1"
    valid = f"NOT {d.like('e_text', R.GROUP_SKIP)}"
    one = lambda x: f"CASE WHEN {valid} THEN {x} END"
    rows = f"SELECT *, CASE WHEN coalesce(parent, '') = '' THEN 'root' ELSE parent END AS grp FROM {_elements(d)} WHERE {own}"
    labels = f"SELECT page_id, grp, seq, txt FROM ({rows}) e_l WHERE {valid}"
    sums = f"SELECT page_id, grp, sum(CASE WHEN {valid} THEN 1 ELSE 0 END) AS members, count(DISTINCT nullif(cls, '')) AS classes, min({one('seq')}) AS first_seq FROM ({rows}) e_r GROUP BY page_id, grp HAVING count(*) BETWEEN 2 AND 20 AND count(DISTINCT nullif(cls, '')) <= 3"
    joined = f"SELECT page_id, grp, {d.joined('substr(txt, 1, 30)', '|', 'seq')} AS labels FROM ({labels}) e_j GROUP BY page_id, grp"
    return f"SELECT s.page_id, s.grp, s.members, s.classes, s.first_seq, j.labels FROM ({sums}) s JOIN ({joined}) j ON j.page_id = s.page_id AND j.grp = s.grp WHERE s.members >= 2"


@rule
def search_ranking(d: Dialect) -> str:
    """Per page the two links most like the page's first one, with points for content words and half the class's boost, and fewer for login and social ones."""
    sim = X.similarity(d, "q.term", "e_text")
    usable = f"type IN ('link', 'clickable') AND length(txt) > 3 AND href <> '' AND NOT {d.like('href', '^(#|javascript:)')}"
    boosts = f"SELECT name, boost FROM ({session_boosts(d)}) e_b WHERE kind = 'class'"
    terms = f"SELECT page_id, {d.first('e_text', 'seq')} AS term FROM {_elements(d)} WHERE {usable} GROUP BY page_id"
    rows = f"SELECT e.page_id, e.seq, e.e_text, e.href, e.e_class, coalesce(b.boost, 0) AS boost, {sim} AS sim FROM {_elements(d).replace(') e_v', ') e')} JOIN ({terms}) q ON q.page_id = e.page_id LEFT JOIN ({boosts}) b ON b.name = e.cls WHERE {usable}"
    score = f"60 * sim + CASE WHEN {d.like('lower(concat(e_text, href, e_class))', R.RANK_WORDS)} THEN 20 ELSE 0 END + 5e-1 * boost - CASE WHEN {d.like('e_text', R.RANK_SKIP)} THEN 50 ELSE 0 END"
    scored = f"SELECT page_id, seq, e_text, sim, {d.half_up(score, 6)} AS score FROM ({rows}) e_m"
    return f"SELECT page_id, seq, e_text, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS rank FROM ({scored}) e_s WHERE score > 15 AND sim > 15e-2) e_k WHERE rank <= 2"


@rule
def content_score_memory(d: Dialect) -> str:
    """Relevance with the memory's type and class boosts and its prediction."""
    base = E.relevance(d, f"({E.intents(d, _elements(d))}) e_i")
    boosts = session_boosts(d)
    typed = "CASE type WHEN 'link' THEN 'click' WHEN 'heading' THEN 'view' ELSE 'purchase' END"
    known = "CASE WHEN seq % 3 = 0 THEN 'btn-server' WHEN seq % 3 = 1 THEN 'card-item' ELSE 'header' END"
    rows = f"SELECT page_id, seq, score AS base, {typed} AS mem_type, {known} AS mem_class FROM ({base}) e_b"
    met = f"SELECT r.page_id, r.seq, r.base, coalesce(t.boost, 0) AS tb, coalesce(c.boost, 0) AS cb FROM ({rows}) r LEFT JOIN ({boosts}) t ON t.kind = 'type' AND t.name = r.mem_type LEFT JOIN ({boosts}) c ON c.kind = 'class' AND c.name = r.mem_class"
    weight = "(CASE WHEN tb > 0 THEN 1e0 ELSE 0e0 END + CASE WHEN cb > 0 THEN 15e-1 ELSE 0e0 END)"
    estimate = f"(CASE WHEN {weight} > 0 THEN least(1e0, (tb / 25e0 + cb / 20e0) / {weight}) ELSE 5e-1 END)"
    points = f"CASE WHEN {weight} / 3e0 > 3e-1 AND {estimate} > 5e-1 THEN {d.half_up(estimate + ' * 15')} ELSE 0 END"
    total = f"least(100, greatest(0, {d.long(f'base + least(tb, 20) + least(cb, 15) + {points}')}))"
    return f"SELECT page_id, seq, base, tb, cb, {total} AS score FROM ({met}) e_m"


@rule
def page_report(d: Dialect) -> str:
    """E5: a page's elements by action and relevance; where a selector repeats, the last one's zone counts."""
    whole = E.zones(d, f"({E.relevance(d, f'({E.intents(d, _elements(d))}) e_i')}) e_s")
    last = f"SELECT page_id, zone, seq, row_number() OVER (PARTITION BY page_id, selector ORDER BY seq DESC) AS back, min(seq) OVER (PARTITION BY page_id, selector) AS seen FROM ({whole}) e_w"
    zones = f"SELECT page_id, zone, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(seen)) AS rn FROM ({last}) e_l WHERE back = 1 GROUP BY page_id, zone"
    count = lambda cond: f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"
    acts = ", ".join(f"{count(f'action = {lit(a)}')} AS {n}" for a, n in (("switch-server", "servers"), ("play-video", "videos"), ("download", "downloads"), ("navigate-episode", "episodes")))
    sums = f"SELECT page_id, count(DISTINCT selector) AS selectors, {count(lit('high') + ' = relevance')} AS high, {count('relevance <> ' + lit('skip'))} AS content, {acts} FROM ({whole}) e_t GROUP BY page_id"
    return f"SELECT s.*, z.zone AS dominant_zone FROM ({sums}) s JOIN ({zones}) z ON z.page_id = s.page_id AND z.rn = 1"


@rule
def semantic_tree(d: Dialect) -> str:
    """Types of thirty elements at most, the first fifteen of each, with the intent as role."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY page_id, type ORDER BY seq) AS rn, count(*) OVER (PARTITION BY page_id, type) AS n FROM ({E.intents(d, _elements(d))}) e_i"
    return f"SELECT page_id, seq, type, action AS role, CASE WHEN txt <> '' THEN txt ELSE tag END AS label, intent_confidence AS confidence, type IN ('clickable', 'link') AS clicks FROM ({ranked}) e_r WHERE n <= 30 AND rn <= 15"


@rule
def site_analysis(d: Dialect) -> str:
    """Page type with identifiers, protection by status, pagination by URL or element, and server elements."""
    slug, title = U.identifiers(d, "p.url")
    paged = " OR ".join(d.like("lower(p.url)", x) for x in (r"_\d+\.html$", r"[?&]page=\d+", r"/page/\d+"))
    sums = f"SELECT page_id, max(CASE WHEN {d.like('concat(e_class, e_text)', 'pagin|page|naveg|pagina')} THEN 1 ELSE 0 END) AS paged, sum(CASE WHEN type IN ('clickable', 'link') AND {d.like('concat(e_text, e_class)', R.SERVER_WORDS)} THEN 1 ELSE 0 END) AS servers FROM {_elements(d)} GROUP BY page_id"
    status = "CASE p.page_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 503 ELSE 200 END"
    return f"SELECT p.page_id, t.type, t.confidence, {slug} AS slug, {title} AS title, {status} IN (403, 503) AS protected, (({paged}) OR s.paged = 1) AS paginated, s.servers >= 2 AS has_servers FROM pages p JOIN ({page_type(d)}) t ON t.page_id = p.page_id JOIN ({sums}) s ON s.page_id = p.page_id"


@rule
def reader_pages(d: Dialect) -> str:
    """Chapter pages by URL whose elements name a way on."""
    texts = f"SELECT page_id, {d.joined('e_text', ' ', 'seq')} AS t FROM {_elements(d)} GROUP BY page_id"
    url = "p.url" if d.pages else f"concat(p.url, CASE WHEN p.page_id % 3 = 0 THEN '/chapter/' WHEN p.page_id % 3 = 1 THEN '/ver/' ELSE '/x/' END)"
    more = "t.t" if d.pages else "concat(t.t, CASE WHEN p.page_id % 2 = 0 THEN ' Siguiente' ELSE '' END)"
    return f"SELECT p.page_id, ({d.like(f'lower({url})', R.READER_URL)} AND {d.like(f'lower({more})', R.READER_TEXT)}) AS reader FROM pages p JOIN ({texts}) t ON t.page_id = p.page_id"


@rule
def content_goal(d: Dialect) -> str:
    """The best of the additive and fixed signals of a page's goal, and the words that the goal then looks for."""
    texts = f"SELECT page_id, lower({d.joined('concat(txt, {}, class)'.format(lit(' ')), ' ', 'seq')}) AS t, lower({d.joined('href', ' ', 'seq')}) AS u, max(CASE WHEN type IN ('iframe', 'media') THEN 1 ELSE 0 END) AS media, sum(CASE WHEN type = 'image' THEN 1 ELSE 0 END) AS images, sum(CASE WHEN type = 'link' THEN 1 ELSE 0 END) AS links FROM {_elements(d)} GROUP BY page_id"
    rows = f"SELECT *, concat(t, ' ', u) AS w FROM ({texts}) e_t"
    add = lambda goal: " + ".join(f"CASE WHEN {d.like('u' if url else 'w', p)} THEN {n} ELSE 0 END" for g, p, url, n in R.GOAL_SIGNALS if g == goal)
    pics = d.like("u", r"\.(jpg|jpeg|png|webp|avif)(\?|$)")
    # Signals in the order in which they are found: an earlier one wins a tie.
    signals = [("manga", f"{add('manga')} + CASE WHEN {pics} AND images > 10 THEN 15 ELSE 0 END"), ("video", add("video"))]
    signals += [(g, f"CASE WHEN {d.like('w', p)} THEN {n} ELSE 0 END") for g, p, n in R.GOAL_WORDS]
    files = d.like("u", r"/descargar/|/download/|\.zip|\.rar|\.pdf")
    signals += [("video", "CASE WHEN media = 1 THEN 20 ELSE 0 END"), ("image", "CASE WHEN images > 15 THEN 15 ELSE 0 END"), ("manga", "CASE WHEN images > 5 AND media = 0 THEN 10 ELSE 0 END"), ("download", "CASE WHEN links > 40 THEN 10 ELSE 0 END"), ("download", f"CASE WHEN {files} THEN 20 ELSE 0 END")]
    cols = ", ".join(f"{x} AS g_{i}" for i, (_, x) in enumerate(signals))
    best = f"greatest({', '.join(f'g_{i}' for i in range(len(signals)))})"
    goal = cases([(f"{best} = 0", "'video'"), *((f"g_{i} = {best}", lit(g)) for i, (g, _) in enumerate(signals))], "'video'")
    words = cases([(f"goal = {lit(g)}", d.text(p)) for g, p in R.GOAL_FILTERS], d.text(dict(R.GOAL_FILTERS)["video"]))
    return f"SELECT page_id, goal, score, {words} AS words FROM (SELECT page_id, {goal} AS goal, {best} AS score FROM (SELECT page_id, {cols} FROM ({rows}) e_r) e_s) e_g"


@rule
def universal_skeleton(d: Dialect) -> str:
    """Elements that any site has, by selector and text."""
    text = [d.like("e_text", p) for p in R.SKELETON_TEXT]
    sel = [d.like("lower(selector)", p) for p in R.SKELETON_SELECTOR]
    both = d.like("concat(lower(selector), e_text)", R.SKELETON_BOTH)
    rows = _elements(d) if d.elements else f"(SELECT page_id, seq, concat('div.', class) AS selector, concat(e_text, CASE WHEN seq % 7 = 0 THEN ' login' WHEN seq % 11 = 0 THEN ' cookie' ELSE '' END) AS e_text FROM ({V.class_members(d)}) e_c) e_v"
    return f"SELECT page_id, seq, ({' OR '.join([*text, *sel, both])}) AS skeleton FROM {rows}"


# -- skeletons ----------------------------------------------------------------------


@rule
def skeleton_selectors(d: Dialect) -> str:
    """Selectors on all pages of a host of two pages and more."""
    sel = "CASE WHEN cls <> '' THEN concat(tag, '.', cls) ELSE tag END"
    rows = f"SELECT DISTINCT h.host, e.page_id, {sel} AS selector FROM ({V.page_elements(d)}) e JOIN ({V.page_host(d)}) h ON h.page_id = e.page_id"
    hosts = f"SELECT host, count(*) AS n_pages FROM ({V.page_host(d)}) k_h GROUP BY host HAVING count(*) >= 2"
    return f"SELECT r.host, r.selector, n.n_pages FROM ({rows}) r JOIN ({hosts}) n ON r.host = n.host GROUP BY r.host, r.selector, n.n_pages HAVING count(*) = n.n_pages"


@rule
def skeleton_texts(d: Dialect) -> str:
    """Texts of 2 to 40 letters that all members of a domain show."""
    rows = f"SELECT DISTINCT user_id % 20 AS domain, user_id AS page, event_type AS txt FROM events"
    pages_ = "SELECT domain, count(DISTINCT page) AS n FROM (" + rows + ") k_r GROUP BY domain HAVING count(DISTINCT page) >= 2"
    return f"SELECT r.domain, r.txt FROM ({rows}) r JOIN ({pages_}) p ON r.domain = p.domain WHERE length(r.txt) BETWEEN 2 AND 40 GROUP BY r.domain, r.txt, p.n HAVING count(*) = p.n"


@rule
def skeleton_filter(d: Dialect) -> str:
    """Elements that are not part of a host's skeleton."""
    sel = "CASE WHEN cls <> '' THEN concat(tag, '.', cls) ELSE tag END"
    rows = f"SELECT h.host, e.page_id, e.seq, e.tag, {sel} AS selector FROM ({V.page_elements(d)}) e JOIN ({V.page_host(d)}) h ON h.page_id = e.page_id"
    return f"SELECT r.page_id, r.seq, r.tag FROM ({rows}) r WHERE NOT EXISTS (SELECT 1 FROM ({skeleton_selectors(d)}) s WHERE s.host = r.host AND s.selector = r.selector)"


# -- learning -------------------------------------------------------------------------

_WON = "success AND urls_found > 0"


def _class_facts(d: Dialect) -> str:
    """domain, class, won, lost: classes and their general names; a general name weighs half."""
    rows = f"SELECT *, {X.general_classes(d, 'class')} AS general FROM ({V.attempts(d)}) l_a"
    own = f"SELECT domain, class, CASE WHEN {_WON} THEN urls_found * 1e0 ELSE 0e0 END AS won, CASE WHEN {_WON} THEN 0 ELSE 1 END AS lost FROM ({rows}) l_o"
    wide = f"SELECT domain, g.name AS class, CASE WHEN {_WON} THEN urls_found * 5e-1 ELSE 0e0 END AS won, CASE WHEN {_WON} THEN 0 ELSE 1 END AS lost FROM ({rows}) l_w {d.numbered('general', 'g', 'name')}"
    return f"{own} UNION ALL {wide}"


def _mean(won: str, lost: str) -> str:
    return f"(({won} + 1e0) / ({won} + {lost} + 2e0))"


@rule
def session_boosts(d: Dialect) -> str:
    """Posterior means and boosts of types, actions and classes."""
    kinds = f"SELECT 'type' AS kind, element_type AS name, CASE WHEN {_WON} THEN urls_found * 1e0 ELSE 0e0 END AS won, CASE WHEN {_WON} THEN 0 ELSE 1 END AS lost FROM ({V.attempts(d)}) l_t"
    acts = f"SELECT 'action' AS kind, action AS name, CASE WHEN {_WON} THEN 1e0 ELSE 0e0 END AS won, CASE WHEN {_WON} THEN 0 ELSE 1 END AS lost FROM ({V.attempts(d)}) l_c"
    classes = f"SELECT 'class' AS kind, class AS name, won, lost FROM ({_class_facts(d)}) l_f WHERE class <> ''"
    sums = f"SELECT kind, name, sum(won) AS won, sum(lost) AS lost FROM ({kinds} UNION ALL {acts} UNION ALL {classes}) l_u GROUP BY kind, name"
    cap = "CASE kind WHEN 'type' THEN 25 WHEN 'action' THEN 15 ELSE 20 END"
    return f"SELECT kind, name, won, lost, {d.half_up(_mean('won', 'lost'), 6)} AS mean, {d.long(d.half_up(_mean('won', 'lost') + ' * ' + cap))} AS boost, least((won + lost + 2e0) / 10, 1e0) AS confidence FROM ({sums}) l_s"


@rule
def domain_fingerprint(d: Dialect) -> str:
    """Per domain and class the successes and failures, and the domain's rate."""
    sums = f"SELECT domain, class, sum(CASE WHEN {_WON} THEN urls_found ELSE 0 END) AS won, sum(CASE WHEN {_WON} THEN 0 ELSE 1 END) AS lost, count(*) AS visits FROM ({V.attempts(d)}) l_a GROUP BY domain, class"
    return f"SELECT domain, class, won, lost, visits, {d.half_up('coalesce(sum(won) OVER (PARTITION BY domain) * 1e0 / nullif(sum(won + lost) OVER (PARTITION BY domain), 0), 1e0)', 6)} AS domain_rate FROM ({sums}) l_s"


@rule
def predict_success(d: Dialect) -> str:
    """A4 A5: estimates for each type and class."""
    boosts = session_boosts(d)
    pairs = f"SELECT DISTINCT element_type, class, domain FROM ({V.attempts(d)}) l_a WHERE class <> ''"
    rate = f"SELECT DISTINCT domain, domain_rate FROM ({domain_fingerprint(d)}) l_d"
    gen = f"SELECT p.element_type, p.class, p.domain, sum(CASE WHEN b.boost > 5 THEN b.boost / 40e0 ELSE 0e0 END) AS gs, sum(CASE WHEN b.boost > 5 THEN 3e-1 ELSE 0e0 END) AS gw FROM (SELECT element_type, class, domain, g.name AS gen FROM (SELECT *, {X.general_classes(d, 'class')} AS general FROM ({pairs}) l_p) l_q {d.numbered('general', 'g', 'name')}) p JOIN ({boosts}) b ON b.kind = 'class' AND b.name = p.gen GROUP BY p.element_type, p.class, p.domain"
    rows = (
        f"SELECT p.element_type, p.class, p.domain, coalesce(t.boost, 0) AS tb, coalesce(c.boost, 0) AS cb, r.domain_rate AS dr, coalesce(g.gs, 0e0) AS gs, coalesce(g.gw, 0e0) AS gw FROM ({pairs}) p LEFT JOIN ({boosts}) t ON t.kind = 'type' AND t.name = p.element_type "
        f"LEFT JOIN ({boosts}) c ON c.kind = 'class' AND c.name = p.class LEFT JOIN ({rate}) r ON r.domain = p.domain LEFT JOIN ({gen}) g ON g.element_type = p.element_type AND g.class = p.class AND g.domain = p.domain"
    )
    score = "(CASE WHEN tb > 0 THEN tb / 25e0 ELSE 0e0 END + CASE WHEN cb > 0 THEN cb / 20e0 ELSE 0e0 END + coalesce(dr, 0e0) + gs)"
    weight = "(CASE WHEN tb > 0 THEN 1e0 ELSE 0e0 END + CASE WHEN cb > 0 THEN 15e-1 ELSE 0e0 END + CASE WHEN dr IS NOT NULL THEN 5e-1 ELSE 0e0 END + gw)"
    return f"SELECT element_type, class, domain, {d.half_up(f'CASE WHEN {weight} > 0 THEN least(1e0, {score} / {weight}) ELSE 5e-1 END', 4)} AS estimate, {d.half_up(f'least(1e0, {weight} / 3e0)', 4)} AS confidence FROM ({rows}) l_r"


@rule
def skip_classes(d: Dialect) -> str:
    """classes of a domain that failed three times and more and never succeeded; names of the rarer ones carry the domain's number."""
    rows = f"SELECT domain, CASE WHEN seq % 5 = 0 THEN concat(class, '-', {V.string(d, 'seq % 40')}) ELSE class END AS class, {_WON} AS won FROM ({V.attempts(d)}) l_a"
    sums = f"SELECT domain, class, sum(CASE WHEN won THEN 1 ELSE 0 END) AS won, sum(CASE WHEN won THEN 0 ELSE 1 END) AS lost FROM ({rows}) l_r WHERE class <> '' GROUP BY domain, class"
    return f"SELECT domain, class, lost FROM ({sums}) l_s WHERE won = 0 AND lost >= 3"


@rule
def skipped_elements(d: Dialect) -> str:
    """Elements that are passed over: of a failed class, or of one that failed three times as often as it succeeded, five times and more, and whose boost is at most five."""
    sums = f"SELECT domain, class, sum(CASE WHEN {_WON} THEN urls_found ELSE 0 END) AS won, sum(CASE WHEN {_WON} THEN 0 ELSE 1 END) AS lost FROM ({V.attempts(d)}) l_a WHERE class <> '' GROUP BY domain, class"
    boost = f"SELECT name, boost FROM ({session_boosts(d)}) l_b WHERE kind = 'class'"
    rule_ = "(s.lost >= 3 AND s.won = 0) OR (b.boost > 0 AND b.boost <= 5 AND s.lost > 3 * s.won AND s.lost >= 5)"
    seen = f"SELECT seq, domain, class, row_number() OVER (PARTITION BY domain, element_type, class ORDER BY seq) AS turn FROM ({V.attempts(d)}) l_e"
    return f"SELECT e.seq, e.domain, e.class, (coalesce({rule_}, false) OR e.turn > 1) AS skipped FROM ({seen}) e LEFT JOIN ({sums}) s ON s.domain = e.domain AND s.class = e.class LEFT JOIN ({boost}) b ON b.name = e.class"


@rule
def top_classes(d: Dialect) -> str:
    """A domain's five classes of most URLs, and whether the class has the domain's best posterior mean; what is meant, not the unreachable original."""
    sums = f"SELECT domain, class, sum(CASE WHEN {_WON} THEN urls_found ELSE 0 END) * 1e0 AS won, sum(CASE WHEN {_WON} THEN 0 ELSE 1 END) AS lost, min(seq) AS seen FROM ({V.attempts(d)}) l_a WHERE class <> '' GROUP BY domain, class"
    ranked = f"SELECT domain, class, won, {d.half_up(_mean('won', 'lost'), 6)} AS mean, row_number() OVER (PARTITION BY domain ORDER BY won DESC, seen) AS rank, row_number() OVER (PARTITION BY domain ORDER BY {d.half_up(_mean('won', 'lost'), 6)} DESC, seen) AS best FROM ({sums}) l_s"
    return f"SELECT domain, class, won, mean, rank, best = 1 AS is_best FROM ({ranked}) l_r WHERE rank <= 5"


@rule
def adaptive_report(d: Dialect) -> str:
    """Boosts, best predictions and top patterns in one table of (section, name, value)."""
    boosts = f"SELECT concat(kind, 'Boosts') AS section, name, boost * 1e0 AS value FROM ({session_boosts(d)}) l_b"
    preds = f"SELECT 'predictions' AS section, element_type AS name, max(estimate) AS value FROM ({predict_success(d)}) l_p GROUP BY element_type"
    tops = f"SELECT 'topPatterns' AS section, concat(class, '#', {V.string(d, 'seq')}) AS name, urls_found * 1e0 AS value FROM ({top_patterns(d)}) l_t WHERE rank <= 5"
    return f"{boosts} UNION ALL {preds} UNION ALL {tops}"


@rule
def selector_stats(d: Dialect) -> str:
    """A provider's ten selectors of best rate, the first seen of equals."""
    rows = f"SELECT seq, provider, concat('.', CASE event_id % 12 WHEN 0 THEN 'good-btn' WHEN 1 THEN 'bad-btn' ELSE concat('btn-', {V.string(d, 'event_id % 12')}) END) AS selector, success FROM (SELECT *, seq AS event_id FROM ({V.engine_attempts(d)}) l_e) l_f"
    sums = f"SELECT provider, selector, count(*) AS attempts, sum(CASE WHEN success THEN 1 ELSE 0 END) AS won, min(seq) AS seen FROM ({rows}) l_r GROUP BY provider, selector"
    return f"SELECT provider, selector, attempts, {d.half_up('won * 1e0 / attempts', 6)} AS rate, rank FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY won * 1e0 / attempts DESC, seen) AS rank FROM ({sums}) l_s) l_k WHERE rank <= 10"


@rule
def top_patterns(d: Dialect) -> str:
    """The twenty successful attempts of most URLs."""
    return f"SELECT seq, class, urls_found, rank FROM (SELECT *, row_number() OVER (ORDER BY urls_found DESC, seq) AS rank FROM ({V.attempts(d)}) l_a WHERE {_WON}) l_r WHERE rank <= 20"


@rule
def kb_selectors(d: Dialect) -> str:
    """Success rate, attempts and capped confidence of each action."""
    return f"SELECT action, {d.half_up('avg(CASE WHEN success THEN 1e0 ELSE 0e0 END)', 6)} AS rate, count(*) AS attempts, least(1e0, 5e-1 + 1e-1 * (count(DISTINCT target) - 1)) AS confidence FROM ({V.steps(d)}) l_s GROUP BY action"


@rule
def profile_merge(d: Dialect) -> str:
    """Two profiles' selectors joined, rates weighted by attempts, the twenty of best rate."""
    half = lambda k: f"SELECT action, count(*) AS n, avg(CASE WHEN success THEN 1e0 ELSE 0e0 END) AS rate FROM ({V.steps(d)}) l_h WHERE user_id % 2 = {k} GROUP BY action"
    return f"SELECT action, sum(n) AS attempts, {d.half_up('sum(rate * n) / sum(n)', 6)} AS rate FROM (({half(0)}) UNION ALL ({half(1)})) l_m GROUP BY action"


# -- providers ------------------------------------------------------------------------


@rule
def engine_phase_stats(d: Dialect) -> str:
    """Counters of provider, engine and phase; the last duration that is not zero."""
    last = d.last("CASE WHEN duration_ms > 0 THEN duration_ms END", "CASE WHEN duration_ms > 0 THEN seq END")
    return f"SELECT provider, engine, phase, sum(CASE WHEN success THEN 1 ELSE 0 END) AS successes, sum(CASE WHEN success THEN 0 ELSE 1 END) AS failures, sum(duration_ms) AS total_ms, {d.long(d.half_up('avg(duration_ms * 1e0)'))} AS avg_ms, {last} AS last_ms, sum(results) AS results FROM ({V.engine_attempts(d)}) p_a GROUP BY provider, engine, phase"


@rule
def provider_stats(d: Dialect) -> str:
    """Rates, confidence, posterior and prediction of each provider."""
    sums = f"SELECT provider, count(*) AS n, sum(CASE WHEN success THEN 1 ELSE 0 END) AS won, count(DISTINCT phase) AS phases FROM ({V.engine_attempts(d)}) p_a GROUP BY provider"
    post = "((won + 1e0) / (n + 2e0))"
    return f"SELECT provider, n, won, phases, {d.long(d.half_up('100e0 * won / n'))} AS success_pct, least(n / 5e0, 1e0) AS confidence, {d.half_up(post, 6)} AS posterior, {d.half_up(f'({post} + least(n / 5e0, 1e0)) / 2', 6)} AS prediction FROM ({sums}) p_s"


@rule
def provider_health(d: Dialect) -> str:
    """Healthy from 60 percent, degraded from 30."""
    return f"SELECT provider, success_pct, CASE WHEN success_pct >= 60 THEN 'healthy' WHEN success_pct >= 30 THEN 'degraded' ELSE 'failed' END AS status FROM ({provider_stats(d)}) p_p"


@rule
def health_summary(d: Dialect) -> str:
    """A18 A41."""
    count = lambda s: f"sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END)"
    return f"SELECT healthy, degraded, failed, CASE WHEN failed > healthy THEN 'critical' WHEN failed > 0 OR degraded > healthy THEN 'degraded' ELSE 'healthy' END AS overall FROM (SELECT {count('healthy')} AS healthy, {count('degraded')} AS degraded, {count('failed')} AS failed FROM ({provider_health(d)}) p_h) p_c"


@rule
def failing_providers(d: Dialect) -> str:
    """Providers of three attempts and more, the best first, and whether they fail: under 30 percent."""
    return f"SELECT provider, success_pct, success_pct < {R.FAILING_RATE} AS failing, rank FROM (SELECT *, row_number() OVER (ORDER BY success_pct DESC, provider) AS rank FROM ({provider_stats(d)}) p_p WHERE n >= 3) p_r"


@rule
def engine_order(d: Dialect) -> str:
    """Engines by rate times confidence less a penalty, missing ones after."""
    dim = "SELECT 'static' AS engine, 0 AS place, 0e0 AS penalty UNION ALL SELECT 'dynamic', 1, 6e-2 UNION ALL SELECT 'intelligent', 2, 3e-2"
    stats = f"SELECT provider, engine, count(*) AS n, sum(CASE WHEN success THEN 1 ELSE 0 END) AS won, min(seq) AS seen FROM ({V.engine_attempts(d)}) p_a GROUP BY provider, engine"
    grid = f"SELECT p.provider, g.engine, g.place, s.seen, CASE WHEN s.n IS NULL THEN NULL ELSE s.won * 1e0 / s.n * least(s.n / 5e0, 1e0) - g.penalty END AS score FROM (SELECT DISTINCT provider FROM ({stats}) p_d) p JOIN ({dim}) g ON true LEFT JOIN ({stats}) s ON s.provider = p.provider AND s.engine = g.engine"
    return f"SELECT provider, engine, {d.half_up('score', 6)} AS score, row_number() OVER (PARTITION BY provider ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, score DESC, CASE WHEN score IS NULL THEN place ELSE seen END) AS rank FROM ({grid}) p_g"


@rule
def bench_percentiles(d: Dialect) -> str:
    """Nearest-rank percentiles by index, not interpolated."""
    ranked = f"SELECT engine, duration_ms, row_number() OVER (PARTITION BY engine ORDER BY duration_ms, seq) - 1 AS i, count(*) OVER (PARTITION BY engine) AS n FROM ({V.engine_attempts(d)}) p_a"
    pick = lambda p: f"max(CASE WHEN i = floor(n * {p}) THEN duration_ms END)"
    return f"SELECT engine, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, {d.half_up('avg(duration_ms * 1e0)', 3)} AS avg_ms, {pick('5e-1')} AS p50_ms, {pick('95e-2')} AS p95_ms, count(*) AS n FROM ({ranked}) p_r GROUP BY engine"


# -- navigation -----------------------------------------------------------------------


def _walk(d: Dialect) -> str:
    """Steps with the page they start from: the target of the last earlier navigate or dive."""
    moved = "CASE WHEN action IN ('navigate', 'dive') THEN target END"
    ignore = f"last_value({moved}) IGNORE NULLS" if d.spark else f"last_value({moved} IGNORE NULLS)"
    return f"SELECT *, coalesce({ignore} OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), concat('http://u', {V.string(d, 'user_id')}, '.example.com/')) AS here FROM ({V.steps(d)}) g_s"


@rule
def nav_edges(d: Dialect) -> str:
    """Edges of each user's walk, at their first step."""
    label = f"CASE WHEN action = 'navigate' THEN substr(target, 1, 40) WHEN action = 'dive' THEN 'dive: container' ELSE action END"
    return f"SELECT user_id, here AS from_url, target AS to_url, min(step) AS seq, {d.first(label, 'step')} AS label FROM ({_walk(d)}) g_w WHERE here <> target GROUP BY user_id, here, target"


@rule
def nav_counts(d: Dialect) -> str:
    """Out-degree, in-degree and server steps of each page."""
    out = f"SELECT user_id, from_url AS url, count(*) AS n_out, 0 AS n_in, 0 AS servers FROM ({nav_edges(d)}) g_o GROUP BY user_id, from_url"
    inn = f"SELECT user_id, to_url AS url, 0, count(*), 0 FROM ({nav_edges(d)}) g_i GROUP BY user_id, to_url"
    srv = f"SELECT user_id, here AS url, 0, 0, count(*) FROM ({_walk(d)}) g_w WHERE action = 'content-servers' GROUP BY user_id, here"
    return f"SELECT user_id, url, sum(n_out) AS n_out, sum(n_in) AS n_in, sum(servers) AS servers FROM ({out} UNION ALL {inn} UNION ALL {srv}) g_u GROUP BY user_id, url"


from pagemill.plans import records  # noqa: E402, F401  adds its rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query(name) for name in RULES}
ORACLE_SQL: dict[str, str] = {name: oracle(name) for name in RULES}
