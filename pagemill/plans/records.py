"""Further rules: records, stores, registries, heuristics, policies. Importing adds them to the named queries."""

from __future__ import annotations

from pagemill.functions import rules as R
from pagemill.functions import streams as S
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.functions.dialect import Dialect, cases, lit
from pagemill.plans import queries as Q
from pagemill.plans.queries import rule
from pagemill.sources import views as V

#: Resource types that are not fetched.
BLOCKED_TYPES = ("image", "media", "font", "stylesheet", "ping")
_MIME = (("text/html", ".html"), ("video/mp4", ".mp4"), ("image/png", ".png"))


@rule
def server_records(d: Dialect) -> str:
    """Name, URL and status from the first field that is filled; empty where none is."""
    return "SELECT s_suppkey AS id, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, ''), concat('server-', s_suppkey % 7), '') AS name, coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'http://a.com' END, ''), nullif('', ''), '') AS url, (s_suppkey % 4 > 0) AS has_data FROM supplier"


@rule
def registry_filters(d: Dialect) -> str:
    """Active providers of a language with their names; inactive ones go."""
    return f"SELECT s.s_suppkey AS provider, n.n_name AS language, s.s_acctbal > 0 AS active FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0 AND n.n_regionkey IN (1, 3)"


@rule
def provider_priority(d: Dialect) -> str:
    """Providers by priority, those without one at 99."""
    return "SELECT provider, priority, row_number() OVER (ORDER BY priority, provider) AS rank FROM (SELECT s_suppkey AS provider, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END, 99) AS priority FROM supplier) r_p"


@rule
def cdn_cache(d: Dialect) -> str:
    """File name from the URL's MD5 and its extension, else the type's, else .bin."""
    ext = d.extract("lower(url)", r"\.([a-z0-9]{3,5})(\?|$)")
    mime = "CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'image/png' ELSE 'x/y' END"
    by_mime = cases([(f"mime = {lit(m)}", lit(e)) for m, e in _MIME], "'.bin'")
    return f"SELECT page_id, concat(substr(md5(url), 1, 12), CASE WHEN ext <> '' THEN concat('.', ext) ELSE {by_mime} END) AS file FROM (SELECT page_id, url, {ext} AS ext, {mime} AS mime FROM ({V.urls_of_pages(d)}) r_u) r_e"


@rule
def cdn_batch(d: Dialect) -> str:
    """K8: the third page of twenty entries, in order."""
    return "SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS rn FROM pages) r_b WHERE rn > 40 AND rn <= 60"


@rule
def saved_patterns(d: Dialect) -> str:
    """The last two hundred attempts, with the number of the save that holds each."""
    total = f"SELECT count(*) AS n FROM ({V.attempts(d)}) r_n"
    return f"SELECT r.seq, r.class, floor((t.n - r.back) / 10) AS save FROM (SELECT seq, class, row_number() OVER (ORDER BY seq DESC) AS back FROM (SELECT seq, class FROM ({V.attempts(d)}) r_a ORDER BY seq DESC LIMIT 200) r_l) r CROSS JOIN ({total}) t"


@rule
def cross_feed(d: Dialect) -> str:
    """Successful engine attempts also count as attempts of type provider."""
    fed = f"SELECT seq, provider AS domain, 'provider' AS element_type, phase AS action FROM ({V.engine_attempts(d)}) r_e WHERE success"
    return f"SELECT element_type, action, count(*) AS n, count(DISTINCT domain) AS domains FROM (SELECT seq, domain, element_type, action FROM ({V.attempts(d)}) r_a UNION ALL {fed}) r_u GROUP BY element_type, action"


@rule
def retry_schedule(d: Dialect) -> str:
    """Delay before each of four tries, doubled each time."""
    tries = "SELECT explode(sequence(0, 3)) AS attempt" if d.spark else "SELECT unnest(range(4)) AS attempt"
    return f"SELECT r_regionkey AS region, attempt, CAST(100 * (r_regionkey + 1) * power(2, attempt) AS BIGINT) AS delay_ms FROM region, ({tries}) r_t"


@rule
def memory_watchdog(d: Dialect) -> str:
    """Critical from 90 percent, warning from 70."""
    return "SELECT level, count(*) AS n FROM (SELECT CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'warning' ELSE 'ok' END AS level FROM events) r_m GROUP BY level"


@rule
def proxy_rotation(d: Dialect) -> str:
    """Requests dealt in turn to the proxies that failed less than three times since their last success."""
    fails = f"SELECT provider, count(*) AS n, sum(CASE WHEN NOT success AND seq > last_ok THEN 1 ELSE 0 END) AS fails FROM (SELECT *, coalesce(max(CASE WHEN success THEN seq END) OVER (PARTITION BY provider), -1) AS last_ok FROM ({V.engine_attempts(d)}) r_e) r_l GROUP BY provider"
    return f"SELECT provider, n, fails, fails < 3 AS available, row_number() OVER (ORDER BY CASE WHEN fails < 3 THEN 0 ELSE 1 END, provider) - 1 AS turn FROM ({fails}) r_f"


@rule
def blocked_resources(d: Dialect) -> str:
    """Requests let through by kind, and protected answers counted."""
    kind = "CASE event_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'media' WHEN 2 THEN 'document' WHEN 3 THEN 'script' WHEN 4 THEN 'font' ELSE 'xhr' END"
    status = "CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 503 ELSE 200 END"
    return f"SELECT kind, count(*) AS n, sum(CASE WHEN status IN (403, 503) THEN 1 ELSE 0 END) AS protected FROM (SELECT {kind} AS kind, {status} AS status FROM events) r_k WHERE kind NOT IN ({', '.join(map(lit, BLOCKED_TYPES))}) GROUP BY kind"


@rule
def link_sets(d: Dialect) -> str:
    """Links of even and odd pages in common, and of one side alone."""
    side = lambda k: f"SELECT DISTINCT url FROM ({V.links(d)}) r_l WHERE page_id % 2 = {k}"
    return f"SELECT 'both' AS part, url FROM (({side(0)}) INTERSECT ({side(1)})) r_b UNION ALL SELECT 'even' AS part, url FROM (({side(0)}) EXCEPT ({side(1)})) r_e UNION ALL SELECT 'odd' AS part, url FROM (({side(1)}) EXCEPT ({side(0)})) r_o"


@rule
def dom_snapshots(d: Dialect) -> str:
    """Node, link, frame and text counts of a page, and their change from the host's page before; text changes over 50 only."""
    counts = f"SELECT page_id, {U.host(d, 'url')} AS host, {d.size(d.all('html', '(<iframe)'))} AS frames, {d.size(d.all('html', '(<[a-z])'))} AS nodes, {d.size(d.all('html', '(<a )'))} AS links, length({d.sub('html', '<[^>]*>')}) AS letters FROM pages"
    diff = "SELECT *, letters - lag(letters, 1, 0) OVER (PARTITION BY host ORDER BY page_id) AS dl, nodes - lag(nodes, 1, 0) OVER (PARTITION BY host ORDER BY page_id) AS dn, links - lag(links, 1, 0) OVER (PARTITION BY host ORDER BY page_id) AS dk, frames - lag(frames, 1, 0) OVER (PARTITION BY host ORDER BY page_id) AS df FROM (" + counts + ") r_c"
    return f"SELECT page_id, nodes, links, letters, dn AS node_diff, dk AS link_diff, df AS frame_diff, CASE WHEN abs(dl) > 50 THEN dl ELSE 0 END AS text_diff FROM ({diff}) r_d"


def diagnosis(d: Dialect, source: str) -> str:
    """E18 E19 E20 over (page_id, finding, score): kind of page by what was found, counts by confidence, advice."""
    has = lambda k: f"max(CASE WHEN finding = {lit(k)} THEN 1 ELSE 0 END)"
    kinds = ("card-grid", "search-input", "episode-list", "server-container", "video-player", "pagination", "tabs")
    sums = f"SELECT page_id, count(*) AS findings, sum(CASE WHEN score >= 80 THEN 1 ELSE 0 END) AS high, sum(CASE WHEN score BETWEEN 50 AND 79 THEN 1 ELSE 0 END) AS medium, sum(CASE WHEN score < 50 THEN 1 ELSE 0 END) AS low, {', '.join(f'{has(k)} AS h_{i}' for i, k in enumerate(kinds))} FROM {source} GROUP BY page_id"
    h = {k: f"h_{i} = 1" for i, k in enumerate(kinds)}
    cards = h["card-grid"]
    kind = cases([(h["video-player"], "'video-player-page'"), (h["episode-list"], "'anime-detail-page'"), (f"{cards} AND {h['search-input']}", "'catalog-page'"), (cards, "'listing-page'"), (h["server-container"], "'server-selection-page'")], "'generic'")
    when = {"card-grid+search-input": f"{cards} AND {h['search-input']}", "video-player-server-container": f"{h['video-player']} AND NOT {h['server-container']}"} | h
    advice = d.join(d.keep(d.array(*(f"CASE WHEN {when[k]} THEN {lit(x)} ELSE '' END" for k, x in R.RECOMMENDATIONS)), "x <> ''"), "; ")
    return f"SELECT page_id, findings, high, medium, low, {kind} AS page_kind, coalesce(nullif({advice}, ''), {lit(R.NO_RECOMMENDATION)}) AS advice FROM ({sums}) r_d"


@rule
def heuristic_findings(d: Dialect) -> str:
    """E18 E19 E20."""
    return diagnosis(d, f"({V.found(d)}) r_f")


@rule
def page_tests(d: Dialect) -> str:
    """Title, and whether it or a challenge form says that the page is withheld."""
    title = d.extract("html", "<title>([^<]*)</title>")
    shown = "CASE WHEN page_id % 10 = 0 THEN 'Just a moment...' ELSE {} END".format(title)
    form = d.like("concat(html, CASE WHEN page_id % 15 = 1 THEN '<form id=\"challenge-form\">' ELSE '' END)", "id=.challenge-form|cf-browser-verify|<iframe[^>]*src=[^>]*cloudflare")
    return f"SELECT page_id, title, ({d.like('lower(title)', R.CHALLENGE)} OR form) AS challenge FROM (SELECT page_id, {shown} AS title, {form} AS form FROM pages) r_t"


@rule
def container_selection(d: Dialect) -> str:
    """The two containers of each context to dive into, players first; the site's own pages go, known container hosts stay."""
    boxes = f"SELECT * FROM ({U.classified(d, f'({V.urls_of_pages(d)}) r_u')}) r_c"
    known = f"SELECT DISTINCT {U.domain(d, 'url')} AS domain FROM ({V.urls_of_pages(d)}) r_k WHERE {d.like('url', '/player|//player')}"
    chrome = f"{U.host(d, 'url')} = 'host3.com' AND {d.like(U.path(d, 'url'), '^/(login|emision|catalogo|comunidad|peticiones|inicio|registro|profile|cuenta|x)')}"
    fits = f"((b.is_container AND b.type IN ('embed', 'navigation')) OR k.domain IS NOT NULL) AND NOT b.chrome AND NOT {d.like('lower(b.url)', R.AD_HOSTS)} AND NOT {d.like('lower(b.url)', R.STATIC_FILES)}"
    met = f"SELECT b.page_id, b.url, b.context, b.type, b.seq, {fits} AS fits FROM (SELECT *, {U.domain(d, 'url')} AS dom, ({chrome}) AS chrome FROM ({boxes}) r_b) b LEFT JOIN ({known}) k ON k.domain = b.dom"
    player = d.like("lower(url)", "/online/|/watch/|/play/|/player/|/embed/|embed|player|reproductor|stream|video")
    # The window stands between the rules and the filter: else the filter is pushed down with all of them written out.
    ranked = f"SELECT page_id, url, context, type, fits, row_number() OVER (PARTITION BY context ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN {player} THEN 0 ELSE 1 END, seq) AS rank FROM ({met}) r_m"
    return f"SELECT page_id, url, context, type, rank FROM ({ranked}) r_r WHERE rank <= 2 AND fits"


@rule
def item_selectors(d: Dialect) -> str:
    """The three most used classes of selectors."""
    cls = X.selector_class(d, "concat('div.', class, ' > a')")
    return f"SELECT cls, n, rank FROM (SELECT cls, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cls) AS rank FROM (SELECT {cls} AS cls FROM ({V.attempts(d)}) r_a WHERE class <> '') r_c GROUP BY cls) r_k WHERE rank <= 3"


def _tried(d: Dialect) -> str:
    """user_id, selector, attempts, won, phase: navigations that succeeded, groups and dives by target; a group or dive wins only where it comes first."""
    rows = f"SELECT user_id, target, step, action, CASE WHEN action = 'navigate' THEN 1 ELSE 0 END AS nav FROM ({V.steps(d)}) r_s WHERE action IN ('group', 'dive') OR (action = 'navigate' AND success)"
    return f"SELECT user_id, target AS selector, count(*) AS attempts, sum(nav) + CASE WHEN {d.first('nav', 'step')} = 0 THEN 1 ELSE 0 END AS won, CASE WHEN {d.first('nav', 'step')} = 1 THEN 'navigation' ELSE {d.first('action', 'step')} END AS phase, min(step) AS seen FROM ({rows}) r_t GROUP BY user_id, target"


@rule
def profile_selectors(d: Dialect) -> str:
    """A site's twenty selectors of best rate among those tried twice and more."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY won * 1e0 / attempts DESC, seen) AS rank FROM ({_tried(d)}) r_t WHERE attempts >= 2"
    return f"SELECT user_id, selector, attempts, {d.half_up('won * 1e0 / attempts', 6)} AS rate, phase, rank FROM ({ranked}) r_r WHERE rank <= 20"


def _profile(d: Dialect) -> str:
    kind = d.extract("lower(reasoning)", "(listing|detail|content|search)")
    count = lambda k: f"sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS {k}"
    sums = f"SELECT user_id, count(*) AS steps, {', '.join(map(count, ('listing', 'detail', 'content')))}, sum(CASE WHEN kind = 'search' THEN 1 ELSE 0 END) AS searches, sum(CASE WHEN action = 'content-servers' THEN 1 ELSE 0 END) AS servers, count(*) * 700 AS duration_ms, max(step) AS last_step FROM (SELECT *, {kind} AS kind FROM ({V.steps(d)}) r_s) r_k GROUP BY user_id"
    best = f"SELECT user_id, count(*) AS selectors FROM ({_tried(d)}) r_t WHERE attempts >= 2 GROUP BY user_id"
    return f"SELECT s.*, coalesce(b.selectors, 0) AS selectors FROM ({sums}) s LEFT JOIN ({best}) b ON b.user_id = s.user_id"


@rule
def site_profile(d: Dialect) -> str:
    """Page types of a user's site, selectors, servers, strategy: static when quick with servers, intelligent with over ten selectors and over two servers."""
    return f"SELECT user_id, steps, listing, detail, content, searches, servers, selectors, CASE WHEN duration_ms < 10000 AND servers > 0 THEN 'static' WHEN selectors > 10 AND servers > 2 THEN 'intelligent' ELSE 'dynamic' END AS strategy FROM ({_profile(d)}) r_p"


@rule
def embed_domains(d: Dialect) -> str:
    """A host's URL patterns with what they lead to and their counts, thirty at most, and its embed URLs."""
    rows = f"SELECT seq, {U.host(d, 'url')} AS host, {U.profile_pattern(d, 'url')} AS pattern, type FROM (SELECT * FROM ({U.classified(d, f'({V.urls_of_pages(d)}) r_u')}) r_c) r_r"
    leads = "CASE WHEN type IN ('embed', 'stream') THEN 'servers' WHEN type = 'download' THEN 'download' ELSE 'navigation' END"
    sums = f"SELECT host, pattern, {d.first(leads, 'seq')} AS leads_to, count(*) AS n, sum(CASE WHEN type = 'embed' THEN 1 ELSE 0 END) AS embeds, min(seq) AS seen FROM ({rows}) r_s GROUP BY host, pattern"
    return f"SELECT host, pattern, leads_to, n, embeds FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seen) AS rank FROM ({sums}) r_k) r_m WHERE rank <= 30"


def _config(d: Dialect) -> str:
    container = "CASE WHEN servers > 0 THEN '.u' ELSE '[class*=\"player\"], [class*=\"server\"]' END"
    return f"SELECT user_id, concat('u', {V.string(d, 'user_id')}, '.example.com') AS name, concat('U', {V.string(d, 'user_id')}, '.example.com') AS title, 'auto' AS language, true AS active, '/search?q={{query}}' AS search_url, CASE WHEN searches > 0 THEN 'h3, .title, a' ELSE 'h2, h3, .title, a' END AS title_selector, CASE WHEN servers > 0 THEN 'iframe' ELSE 'none' END AS video_type, {container} AS container FROM ({_profile(d)}) r_p WHERE selectors > 0 OR servers > 0"


@rule
def provider_config(d: Dialect) -> str:
    """A provider's configuration from a site's profile; none without selectors and servers."""
    return _config(d)


@rule
def process_result(d: Dialect) -> str:
    """What one result adds: its profile, edges of its map, its configuration if there are servers, and the steps fed to the knowledge base."""
    edges = f"SELECT user_id, count(*) AS n_edges FROM ({Q.RULES['nav_edges'](d)}) r_e GROUP BY user_id"
    fed = f"SELECT user_id, count(*) AS fed, count(DISTINCT target) AS kb_selectors FROM ({V.steps(d)}) r_s WHERE action IN ('navigate', 'group', 'dive') GROUP BY user_id"
    return f"SELECT p.user_id, p.steps, p.servers, coalesce(e.n_edges, 0) AS n_edges, coalesce(f.fed, 0) AS fed, coalesce(f.kb_selectors, 0) AS kb_selectors, (p.servers > 0 AND c.user_id IS NOT NULL) AS new_config FROM ({_profile(d)}) p LEFT JOIN ({edges}) e ON e.user_id = p.user_id LEFT JOIN ({fed}) f ON f.user_id = p.user_id LEFT JOIN ({_config(d)}) c ON c.user_id = p.user_id"


def _resolutions(d: Dialect) -> str:
    """seq, domain, direct, method: outcomes of embed resolutions."""
    direct = "CASE page_id % 4 WHEN 0 THEN 'https://cdn.com/a.m3u8' WHEN 1 THEN 'https://cdn.com/a.mp4' WHEN 2 THEN 'https://cdn.com/a' ELSE '' END"
    return f"SELECT page_id AS seq, {U.host(d, 'url')} AS domain, {direct} AS direct, CASE page_id % 3 WHEN 0 THEN 'generic' WHEN 1 THEN 'direct' ELSE 'cache' END AS method FROM ({V.urls_of_pages(d)}) r_u"


@rule
def kb_domains(d: Dialect) -> str:
    """A domain's first resolution sets type and confidence (0.6 or 0.2), each later one adds 0.05 up to one."""
    kind = "CASE WHEN contains(direct, '.m3u8') THEN 'stream' WHEN contains(direct, '.mp4') THEN 'direct-video' ELSE 'embed' END"
    first = f"{d.first('CASE WHEN direct <> {} THEN 1 ELSE 0 END'.format(lit('')), 'seq')}"
    named = "CASE WHEN method <> 'generic' THEN {} END"
    return f"SELECT domain, {d.first(kind, 'seq')} AS type, coalesce({d.first(named.format('method'), named.format('seq'))}, '') AS resolver, {d.half_up(f'least(1e0, CASE WHEN {first} = 1 THEN 6e-1 ELSE 2e-1 END + 5e-2 * (count(*) - 1))', 6)} AS confidence, {first} + count(*) - 1 AS successes FROM ({_resolutions(d)}) r_r GROUP BY domain"


@rule
def kb_merge(d: Dialect) -> str:
    """Two knowledge bases merged: of a domain the surer entry, the own one of equals; selectors and patterns of the other only where they are new."""
    dom = lambda k: f"SELECT domain AS name, type AS info, confidence, {k} AS store FROM ({kb_domains(d)}) r_d"
    other = f"SELECT domain AS name, concat(type, '+') AS info, {d.half_up('confidence * CASE WHEN length(domain) % 2 = 0 THEN 11e-1 ELSE 9e-1 END', 6)} AS confidence, 1 AS store FROM ({kb_domains(d)}) r_o WHERE domain <> 'host1.com'"
    sel = lambda k: f"SELECT selector AS name, phase AS info, {d.half_up('won * 1e0 / attempts', 6)} AS confidence, {k} AS store, user_id FROM ({_tried(d)}) r_t WHERE user_id % 2 = {k}"
    pick = lambda kind, rows, order: f"SELECT '{kind}' AS kind, name, info, confidence, store FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {order}) AS rn FROM ({rows}) r_u) r_v WHERE rn = 1"
    sels = f"SELECT regexp_replace(name, '^http://u[0-9]+', 'http://u') AS name, info, confidence, store, user_id FROM (({sel(0)}) UNION ALL ({sel(1)})) r_w"
    return f"{pick('domain', f'({dom(0)}) UNION ALL ({other})', 'confidence DESC, store')} UNION ALL {pick('selector', sels, 'store, user_id, confidence')}"


@rule
def nav_nodes(d: Dialect) -> str:
    """Pages of a walk with the kind that the step which found them tells."""
    kind = cases([(d.like("lower(reasoning)", "listing|cards|many-links"), "'listing'"), (d.like("lower(reasoning)", "detail|episodes|synopsis|genres"), "'detail'"), (d.like("lower(reasoning)", "content|servers|player|iframe"), "'content'")], "'unknown'")
    return f"SELECT user_id, target AS url, min(step) AS first_step, {d.first(kind, 'step')} AS page_type, count(*) AS seen FROM ({V.steps(d)}) r_s GROUP BY user_id, target"


@rule
def nav_merge(d: Dialect) -> str:
    """Maps of a site's even and odd users merged: an edge once for each action, the first map's first; out-degrees over both."""
    site = "regexp_replace({}, '^http://u[0-9]+', 'http://u')"
    rows = f"SELECT user_id % 2 AS map, {site.format('from_url')} AS from_url, {site.format('to_url')} AS to_url, label, seq, user_id FROM ({Q.RULES['nav_edges'](d)}) r_e"
    edges = f"SELECT from_url, to_url, label, min(map) AS map, count(*) AS n FROM ({rows}) r_r GROUP BY from_url, to_url, label"
    return f"SELECT from_url, count(*) AS n_edges, count(DISTINCT to_url) AS n_children, sum(CASE WHEN map = 0 THEN 1 ELSE 0 END) AS from_first, sum(n) AS steps FROM ({edges}) r_g GROUP BY from_url"


def _catalog_streams(d: Dialect) -> str:
    """Normalised streams of a catalog: the label is the URL's own, its server and its type."""
    typed = f"SELECT page_id, seq, url, context, type AS class_type, {U.server_name(d, U.domain(d, 'url'))} AS own FROM ({U.classified(d, f'({V.urls_of_pages(d)}) r_u')}) r_c"
    rows = f"SELECT page_id, seq, url, concat(context, ' ', own, ' ', class_type) AS labels, '' AS direct_url FROM ({typed}) r_t"
    return S.normalized(d, f"({rows}) r_v")


@rule
def stream_list(d: Dialect) -> str:
    """A catalog's streams, normalised, the first of each fingerprint, server and quality, by priority."""
    one = f"SELECT *, row_number() OVER (PARTITION BY concat({U.stream_fingerprint(d, 'url')}, server, quality) ORDER BY seq) AS rn FROM ({_catalog_streams(d)}) r_n"
    return f"SELECT page_id, url, server, quality, language, type, priority FROM ({one}) r_o WHERE rn = 1"


@rule
def pipeline_streams(d: Dialect) -> str:
    """providers' streams end to end: open circuits and late answers left out, normalised, first ten embeds resolved, first of each URL and server, fifty by priority."""
    took = "page_id * 37 % 400"
    rows = f"SELECT page_id, seq, url, concat('p', {V.string(d, 'page_id % 20')}, ' ', labels) AS labels, '' AS direct_url FROM ({V.streams(d)}) r_s WHERE page_id % 20 <> 7 AND {took} * 100 <= 30000"
    embeds = f"SELECT url, row_number() OVER (ORDER BY seq) AS turn FROM ({S.normalized(d, f'({rows}) r_v')}) r_n WHERE type = 'embed'"
    direct = f"SELECT s.url, {d.first('s.direct_url', 's.seq')} AS direct FROM ({V.streams(d)}) s JOIN (SELECT DISTINCT url FROM ({embeds}) r_e WHERE turn <= 10) t ON t.url = s.url WHERE s.direct_url <> '' GROUP BY s.url"
    met = f"SELECT n.page_id, n.seq, n.url, n.server, n.priority, coalesce(r.direct, '') AS direct, CASE WHEN coalesce(r.direct, '') = '' THEN n.type WHEN {U.is_direct_video(d, 'r.direct')} THEN 'mp4' ELSE 'm3u8' END AS type FROM ({S.normalized(d, f'({rows}) r_v')}) n LEFT JOIN ({direct}) r ON r.url = n.url"
    cut = d.extract("url", "^([^?#]*)")
    one = f"SELECT *, row_number() OVER (PARTITION BY concat({cut}, '|', server) ORDER BY seq) AS rn FROM ({met}) r_m"
    return f"SELECT page_id, url, server, direct, type, priority, rank FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, seq) AS rank FROM ({one}) r_o WHERE rn = 1) r_r WHERE rank <= 50"


@rule
def engine_results(d: Dialect) -> str:
    """A provider's first engine in order that gave results; none gave any: exhausted."""
    got = f"SELECT provider, engine, max(CASE WHEN success THEN results ELSE 0 END) AS results FROM ({V.engine_attempts(d)}) r_a WHERE seq % 11 = 0 GROUP BY provider, engine"
    rows = f"SELECT o.provider, o.engine, o.rank, coalesce(g.results, 0) AS results FROM ({Q.RULES['engine_order'](d)}) o LEFT JOIN ({got}) g ON g.provider = o.provider AND g.engine = o.engine"
    hit = "CASE WHEN results > 0 THEN {} END"
    return f"SELECT provider, coalesce({d.first(hit.format('engine'), hit.format('rank'))}, 'exhausted') AS engine, coalesce({d.first(hit.format('results'), hit.format('rank'))}, 0) AS results, max(results) > 0 AS success FROM ({rows}) r_r GROUP BY provider"


@rule
def strategy_cascade(d: Dialect) -> str:
    """The first strategy that gave servers, in the set order; else a failure under the last one's name."""
    return f"SELECT page_id, CASE WHEN static > 0 THEN 'static' WHEN browser > 0 THEN 'browser' ELSE 'browser' END AS strategy, greatest(CASE WHEN static > 0 THEN static ELSE browser END, 0) AS servers, (static > 0 OR browser > 0) AS success, CASE WHEN static > 0 OR browser > 0 THEN '' ELSE 'All strategies failed' END AS error FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {d.size(d.all('html', V.HREF))} ELSE 0 END AS static, CASE WHEN page_id % 4 = 1 THEN page_id % 5 ELSE 0 END AS browser FROM pages) r_s"


@rule
def server_types(d: Dialect) -> str:
    """URLs of a server by type, and the first three shortened, for the ten servers of most URLs."""
    rows = f"SELECT seq, url, type, {U.server_name(d, U.domain(d, 'url'))} AS server FROM ({U.classified(d, f'({V.urls_of_pages(d)}) r_u')}) r_c"
    top = f"SELECT server, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS rank FROM ({rows}) r_t GROUP BY server"
    kinds = f"SELECT server, type, count(*) AS k, min(seq) AS seen FROM ({rows}) r_k GROUP BY server, type"
    named = f"SELECT server, {d.joined('concat({}, {}, type)'.format(V.string(d, 'k'), lit('x ')), ', ', 'seen')} AS types FROM ({kinds}) r_n GROUP BY server"
    shown = f"SELECT server, {d.joined('substr(url, 1, 60)', ' ', 'seq')} AS urls FROM (SELECT *, row_number() OVER (PARTITION BY server ORDER BY seq) AS rn FROM ({rows}) r_w) r_x WHERE rn <= 3 GROUP BY server"
    return f"SELECT t.rank, t.server, t.n, n.types, s.urls FROM ({top}) t JOIN ({named}) n ON n.server = t.server JOIN ({shown}) s ON s.server = t.server WHERE t.rank <= 10"


@rule
def domain_chains(d: Dialect) -> str:
    """Chains whose key begins with a domain, the surest first."""
    keyed = f"SELECT concat(domain, '|', from_pattern) AS k, to_type, confidence FROM ({Q.RULES['url_chains'](d)}) r_c"
    split = f"SELECT {d.extract('k', '^([^|]*)')} AS domain, k, to_type, confidence FROM ({keyed}) r_k"
    asked = f"SELECT DISTINCT {U.domain_any_www(d, 'url')} AS domain FROM pages WHERE page_id % 2 = 0"
    return f"SELECT s.domain, s.k, s.to_type, s.confidence, row_number() OVER (PARTITION BY s.domain ORDER BY s.confidence DESC, s.k, s.to_type) AS rank FROM ({split}) s JOIN ({asked}) a ON a.domain = s.domain"


@rule
def captured_urls(d: Dialect) -> str:
    """URLs that a click let through: http, neither search engine nor analytics; and those of media answers, each once."""
    host = "CASE event_id % 6 WHEN 0 THEN 'www.google.com' WHEN 1 THEN 'analytics.x.com' WHEN 2 THEN 'cdn.x.com' WHEN 3 THEN 'embed.x.com' ELSE 'x.com' END"
    tail = "CASE event_id % 4 WHEN 0 THEN '.m3u8' WHEN 1 THEN '.mp4' WHEN 2 THEN '/embed/' ELSE '' END"
    scheme = "CASE WHEN event_id % 9 = 0 THEN 'blob:' ELSE 'https://' END"
    rows = f"SELECT event_id, user_id, concat({scheme}, {host}, '/', {V.string(d, 'user_id % 13')}, {tail}) AS url FROM events"
    return f"SELECT user_id, url, min(event_id) AS seq, {d.like('url', 'embed|player|stream|video|m3u8|mp4')} AS media FROM ({rows}) r_c WHERE url LIKE 'http%' AND NOT contains(url, 'google') AND NOT contains(url, 'analytics') GROUP BY user_id, url"


@rule
def search_urls(d: Dialect) -> str:
    """A provider's search address with the query filled in and the base before it, unless it is whole."""
    template = "CASE WHEN s_suppkey % 3 = 0 THEN 'https://x.com/?s={query}' ELSE '/search?q={query}&again={query}' END"
    name = "replace(n_name, ' ', '%20')"
    filled = f"concat({d.extract('t', '^([^{]*)')}, {name}, {d.sub('t', '^[^{]*[{]query[}]')})"
    return f"SELECT s_suppkey AS provider, CASE WHEN t LIKE 'http%' THEN {filled} ELSE concat('https://p.com', {filled}) END AS url FROM (SELECT s_suppkey, s_nationkey, {template} AS t FROM supplier) s JOIN nation n ON n.n_nationkey = s.s_nationkey"


@rule
def request_budget(d: Dialect) -> str:
    """What a walk got done within its budget of a hundred steps and its time, and whether it is partial."""
    rows = f"SELECT user_id, step, sum(350 + step % 7 * 100) OVER (PARTITION BY user_id ORDER BY step) AS spent FROM ({V.steps(d)}) r_s"
    return f"SELECT user_id, count(*) AS steps, sum(CASE WHEN spent <= 45000 AND step <= 100 THEN 1 ELSE 0 END) AS within, max(spent) > 45000 OR max(step) > 100 AS partial FROM ({rows}) r_b GROUP BY user_id"


@rule
def event_log(d: Dialect) -> str:
    """A run's events as messages of name, data and time."""
    name = "CASE WHEN action = 'content-servers' THEN 'url-found' ELSE 'step' END"
    return f"SELECT user_id, step AS seq, {name} AS event, concat(action, ' ', target) AS data, step * 1000 AS ts FROM ({V.steps(d)}) r_s UNION ALL SELECT user_id, max(step) + 1 AS seq, 'complete' AS event, {V.string(d, 'count(*)')} AS data, max(step) * 1000 + 1 AS ts FROM ({V.steps(d)}) r_t GROUP BY user_id"


@rule
def kb_import(d: Dialect) -> str:
    """Entries of confidence 70 and more, the first of each host."""
    rows = f"SELECT *, {U.host(d, 'url')} AS host FROM ({U.classified(d, f'({V.urls_of_pages(d)}) r_u')}) r_c"
    sure = "CASE WHEN confidence >= 70 THEN {} END"
    # A sum decides, not a filter on the class: the filter would be pushed down with all rules written out.
    sums = f"SELECT host, {d.first(sure.format('type'), sure.format('seq'))} AS first_type, max({sure.format('confidence')}) AS confidence, sum(CASE WHEN confidence >= 70 THEN 1 ELSE 0 END) AS n FROM ({rows}) r_h GROUP BY host"
    return f"SELECT host, first_type, confidence, n FROM ({sums}) r_k WHERE n > 0"


@rule
def paginated_totals(d: Dialect) -> str:
    """Items, pages fetched and failed of each host."""
    return f"SELECT host, count(*) AS fetched, sum(n) AS items, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS failed FROM (SELECT {U.host(d, 'url')} AS host, {d.size(d.all('html', V.HREF))} AS n FROM pages) r_p GROUP BY host"


@rule
def health_prune(d: Dialect) -> str:
    """F16: providers whose last timed attempt is old; counted, not removed."""
    last = f"SELECT provider, max(seq) AS last_seq, {d.last('duration_ms', 'seq')} AS last_ms FROM ({V.engine_attempts(d)}) r_e GROUP BY provider"
    now = f"SELECT max(seq) AS now FROM ({V.engine_attempts(d)}) r_n"
    return f"SELECT count(*) AS providers, sum(CASE WHEN last_ms > 0 AND now - last_seq > 20 THEN 1 ELSE 0 END) AS stale FROM ({last}) r_h CROSS JOIN ({now}) r_w"


@rule
def limited_urls(d: Dialect) -> str:
    """five URLs of a domain at most, in order."""
    return f"SELECT domain, page_id, rank FROM (SELECT {U.domain(d, 'url')} AS domain, page_id, row_number() OVER (PARTITION BY {U.domain(d, 'url')} ORDER BY seq) AS rank FROM ({V.urls_of_pages(d)}) r_u) r_r WHERE rank <= 5"
