"""Scans of parsed pages, element rules on them, embeds, redirects, exploration, stores, by golden rows."""

import datetime
import json

import pytest

from pagemill import config
from pagemill.operators import graph, state
from pagemill.plans import queries as Q
from pagemill.plans import records, scans
from pagemill.functions.dialect import SPARK, Dialect
from pagemill.sources import dom, media, stores

PAGE = """<html><head><title>Film</title><meta property="og:title" content="T"><script type="application/ld+json">{"@type": "Movie"}</script></head><body>
<div class="card"><a href="/1" class="t">Uno</a></div><div class="card"><a href="/2" class="t">Dos</a></div><div class="card"><a href="/3" class="t">Tres</a></div>
<ul class="episodios"><li><a class="epi" href="/e1">Episodio 1</a><li><a class="epi" href="/e2">Episodio 2</a></ul>
<div class="box player-area"><iframe src="https://e.com/1" width="640"></iframe><button>Server 1</button><iframe src="about:blank"></iframe></div>
<div class="pagination big"><a href="?p=1" class="current">1</a><a href="?p=2">2</a></div>
<input type="text" id="q"><div class="filter-bar"><select></select><input></div><div class="tabs"><button>A</button><button>B</button></div></body></html>"""


def rows(name, html=PAGE, url=""):
    return dom.SCANS[name][0](html, url)


def test_findings():
    got = [(f["type"], f["selector"], f["score"], f["count"]) for f in rows("findings")]
    assert got[0] == ("pagination", ".pagination", 95, 2)
    assert set(got) == {
        ("pagination", ".pagination", 95, 2), ("video-player", "iframe", 90, 1), ("search-input", "#q", 90, 1), ("tabs", ".tabs", 88, 2), ("filter-group", ".filter-bar", 85, 2),
        ("server-container", ".box\\ player-area", 80, 2), ("metadata", 'meta, script[type="application/ld+json"]', 70, 1), ("card-grid", ".card", 15, 3), ("episode-list", ".epi", 6, 2),
    }
    assert [f["score"] for f in rows("findings")] == sorted((f["score"] for f in rows("findings")), reverse=True)
    assert rows("findings", "") == rows("findings", None) == []


def test_one_class_must_have_seven_links_in_ten():
    mixed = "<div class='result-box'>" + "<a class='x1z' href='/'>a</a>" * 6 + "<a class='y' href='/'>b</a>" * 4 + "</div>"
    assert [f["type"] for f in rows("findings", mixed) if f["selector"] != ".result-box"] == []
    whole = mixed.replace("'y'", "'x1z'")
    assert ("search-results", ".x1z", 30) in [(f["type"], f["selector"], f["score"]) for f in rows("findings", whole)]


def test_extraction_by_kind():
    assert rows("episode_list") == [{"seq": 0, "text": "Episodio 1", "href": "/e1"}, {"seq": 1, "text": "Episodio 2", "href": "/e2"}]
    assert rows("video_player") == [{"seq": 0, "src": "https://e.com/1", "width": "640", "height": "", "parent_class": "box player-area"}]
    assert rows("server_container") == [{"seq": 0, "class_name": "box player-area", "iframes": ["https://e.com/1", "about:blank"], "tabs": ["Server 1"]}]
    assert [(r["text"], r["is_current"], r["total"]) for r in rows("pagination")] == [("1", True, 2), ("2", False, 2)]
    cards = "<div class='card' data-item='{\"a\": 1}'></div><div class='item' data-json='no'></div><div class='card'></div>"
    assert [json.loads(r["data"]) for r in rows("card_grid", cards)] == [{"a": 1}, {"raw": "no"}]
    assert dom.EXTRACTORS.get("tabs") is None


def test_page_data_and_schema():
    assert rows("page_data") == [{"meta": {"og:title": "T"}, "structured": '{"@type": "Movie"}'}]
    assert rows("page_data", "<script type='application/ld+json'>{bad</script>") == []
    item = "<div itemscope itemtype='M'><b itemprop='name'> N </b><meta itemprop='year' content='1999'><a itemprop='link' href='/l'></a></div><div itemscope itemtype='P'></div>"
    assert {r["name"]: r["value"] for r in rows("schema_org", item)} == {"@type": "P", "name": "N", "year": "1999", "link": "/l"}


def test_server_blocks():
    page = "<title> T </title><ul id='player'><li><b data-key='name'>Uno</b></li><li>Dos</li><li></li></ul><div class='Server-x'>Tres</div><p data-global='site'>S</p>"
    got = rows("server_blocks", page)
    assert [r["server"] for r in got] == [{"name": "Uno"}, {"text": "Dos"}, {}, {"text": "Tres"}] and got[0]["title"] == "T" and got[0]["global"] == {"site": "S"}
    assert [r["server"] for r in rows("first_server_block", page)] == [{"name": "Uno"}, {"text": "Dos"}]
    assert rows("wrapped_frame", "<div class='reproductor-wrapper x'><p><iframe src='/f'></iframe></p></div>") == [{"src": "/f"}] and rows("wrapped_frame") == []


def test_live_elements():
    got = rows("live_elements", "<div><div class='solo'></div><p>text</p><textarea></textarea><h4>H</h4><a class='zz btn' href='/a'>A</a><a class='zz' href='/b' name='n'>B</a><i onclick='x()'>c</i><table></table></div>")
    assert [(e["tag"], e["type"], e["selector"]) for e in got] == [
        ("DIV", "container", "div"), ("P", "text", "div > p:nth-child(2)"), ("TEXTAREA", "input", "div > textarea:nth-child(3)"), ("H4", "heading", "div > h4:nth-child(4)"),
        ("A", "link", "a.btn"), ("A", "link", "div > a:nth-child(6)"), ("I", "clickable", "div > i:nth-child(7)"), ("TABLE", "table", "div > table:nth-child(8)"),
    ]
    assert got[5]["attr"] == {"class": "zz", "href": "/b", "name": "n"} and len(rows("live_elements", "<p>x</p>" * 400)) == 300


def test_live_urls_and_final_urls():
    page = """<iframe src="about:blank"></iframe><iframe data-src="https://f.com/1"></iframe><video><source src="https://v.com/a.mp4"></video><a href="#x"></a><a href="/rel"></a>
    <b onclick="go('https://o.com/1'); x('https:\\/\\/j.com\\/2')"></b><i data-link="https://d.com/3"></i><script>var u = "https://cdn.com/player.js", w = "https://other.com/xxxxxxxx";</script><img src="https://i.com/p.png">"""
    assert [r["url"] for r in rows("live_urls", page)] == ["https://f.com/1", "https://v.com/a.mp4", "/rel", "https://o.com/1", "https://j.com", "https://d.com/3", "https://cdn.com/player.js"]
    assert [r["url"] for r in rows("final_urls", page)] == ["https://cdn.com/player.js", "https://other.com/xxxxxxxx", "https://i.com/p.png"]


def test_live_images():
    page = "<img src='https://a.com/1.jpg'><img src='https://a.com/lazy.jpg' data-lazy-src='https://a.com/2.jpg'><img src='https://a.com/1.jpg'><div style=\"background-image: url('https://a.com/bg.png')\"></div>"
    assert [(r["url"], r["attribute"]) for r in rows("live_images", page)] == [("https://a.com/1.jpg", "src"), ("https://a.com/2.jpg", "data-lazy-src"), ("https://a.com/bg.png", "background-image")]


def test_batch_reader():
    page = "<select><option value=''>Cargar imágenes: 1</option><option value='-3-1.html'>3</option><option value='-10-1.html'>10</option></select><select><option value='/c-10-1.html'>1</option><option value='/c-10-2.html'>2</option></select>"
    assert rows("batch_reader", page, "https://r.com/c/") == [{"batch_size": 10, "batch_url": "https://r.com/c-10-1.html", "page_urls": ["/c-10-1.html", "/c-10-2.html"]}]
    assert rows("batch_reader", "<select><option>1</option></select>") == []


def test_player_source():
    assert dom.player_source('<script>var a = {"file": "https://c.com/x.m3u8?t=1"}; jwplayer</script>') == "https://c.com/x.m3u8?t=1"
    assert dom.player_source("<script>jwplayer('p').setup({'file': 'https://c.com/x.mp4'});</script>") == "https://c.com/x.mp4"
    assert dom.player_source("<script>jwplayer('p').setup({sources: [{file: '/lo', label: '360p'}, {file: '/hi', label: '1080p'}, {file: '/mid', label: '720p'}]});</script>") == "/hi"
    assert dom.player_source("<script>no player at all here</script>") is None
    assert rows("embed_step", "<p>'https://c.com/a.mp4' then https://c.com/b.m3u8</p>")[0]["direct_url"] == "https://c.com/b.m3u8"
    assert rows("embed_step", "<iframe src='//n.com/e'></iframe>") == [{"direct_url": None, "frame_url": "https://n.com/e"}]


def test_urls_of_an_element(spark):
    e = spark.createDataFrame([({"src": "about:blank", "data-url": "https://d.com", "data-n": "https://n.com", "onclick": "x('https://o.com/1')"},), ({"href": "#a"},), ({"href": "/r"},)], "attr map<string,string>")
    assert [r["urls"] for r in scans.element_urls(e).collect()] == [["https://d.com", "https://o.com/1"], [], ["/r"]]
    assert [r["urls"] for r in scans.element_urls(e, model=True).collect()] == [["about:blank", "https://o.com/1"], [], ["/r"]]


@pytest.fixture(scope="module")
def over(spark, sf_dir):
    """A rule over the parsed elements of one page."""

    def run(name, html, url="https://h.com/x"):
        pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
        return [r.asDict() for r in Q.run(name, spark, sf_dir, scans.parsed(spark, pages)).collect()]

    return run


def test_groups_are_by_parent(over):
    links = "".join(f"<a class='c{i % 2}' href='/{i}'>Link {i}</a>" for i in range(3))
    page = f"<div id='Nav'>{links}<a href='/l'>Login</a></div><div class='one'><a href='/'>Alone</a></div><p class='many'>" + "<a href='/m'>Many</a>" * 21 + "</p>"
    assert over("element_groups", page) == [{"page_id": 1, "grp": "nav", "members": 3, "classes": 2, "first_seq": 1, "labels": "Link 0|Link 1|Link 2"}]


def test_repeating_and_card_classes(over):
    page = "<div class='card big'>a</div>" * 4 + "<div class='ab'>b</div>" * 5 + "<div class='thing-card'>c</div>" * 3
    assert [(r["cls"], r["n"], r["holding"]) for r in over("repeating_classes", page)] == [("card", 4, 7)]
    assert {(r["cls"], r["n"], r["score"]) for r in over("card_classes", page)} == {("card", 4, 20), ("thing-card", 3, 15)}


def test_ranking_has_penalty_and_content_points(over):
    page = "<a href='/ver/1'>one piece</a><a href='/2'>one piece login</a><a href='#'>one piece</a><a href='/x'>one piece</a>"
    got = over("search_ranking", page)
    assert [r["seq"] for r in got] == [0, 3] and float(got[0]["score"]) == float(got[1]["score"]) + 20


def test_readers_goals_and_sites(over):
    assert over("reader_pages", "<a href='/n'>Siguiente</a>", "https://h.com/chapter/3") == [{"page_id": 1, "reader": True}]
    assert over("reader_pages", "<a href='/n'>Siguiente</a>", "https://h.com/x")[0]["reader"] is False
    assert over("reader_pages", "<a href='/n'>der the</a>", "https://h.com/chapter/3")[0]["reader"] is False
    assert over("content_goal", "<a href='/manga/x'>Manga capitulo 3</a>")[0]["goal"] == "manga"
    got = over("site_analysis", "<a href='/s'>Server 1</a><button>Opcion 2</button>", "https://h.com/my-film_2.html")[0]
    assert (got["slug"], got["title"], got["has_servers"], got["paginated"]) == ("my-film_2", "my film 2", True, True)
    assert over("site_analysis", "<a href='/s'>the</a><a href='/t'>the</a>")[0]["has_servers"] is False


def test_universal_skeleton(over):
    page = "<a href='/'>Iniciar sesion</a><a class='menu' href='/'>x</a><a href='/'>Favoritos</a><a href='/'>Naruto</a>"
    assert [r["skeleton"] for r in sorted(over("universal_skeleton", page), key=lambda r: r["seq"])] == [True, True, True, False]


def test_page_type_over_real_elements(over):
    player = "<iframe src='https://e.com'></iframe><video src='x'></video><button>Server 1</button><button>Opcion 2</button>"
    got = over("page_type", player, "https://h.com/watch/1")[0]
    assert (got["type"], got["strategy"], got["content"]) == ("content", "click-servers", 125)
    assert over("semantic_tree", "<a href='/'>x</a>" * 31 + "<button>Play</button>") == [{"page_id": 1, "seq": 31, "type": "clickable", "role": "play-video", "label": "Play", "confidence": 45, "clicks": True}]


def test_diagnosis(spark):
    def kind(*found):
        spark.createDataFrame([(1, f, s) for f, s in found], "page_id long, finding string, score int").createOrReplaceTempView("some_findings")
        r = spark.sql(records.diagnosis(SPARK, "some_findings")).first()
        return r["page_kind"], r["advice"], (r["high"], r["medium"], r["low"])

    assert kind(("card-grid", 40), ("search-input", 90)) == ("catalog-page", "Catalogo detectado: usar filtro de busqueda para encontrar item", (1, 0, 1))
    assert kind(("metadata", 70)) == ("generic", "Estructura no reconocida: usar analisis manual de DOM", (0, 1, 0))
    assert kind(("video-player", 90), ("episode-list", 80))[0] == "video-player-page" and kind(("server-container", 80))[0] == "server-selection-page"
    assert kind(("card-grid", 40))[0] == "listing-page" and kind(("episode-list", 6))[0] == "anime-detail-page"


def test_page_diagnosis_has_several_kinds(spark, sf_dir):
    got = {r["page_kind"] for r in scans.page_diagnosis(spark, sf_dir).collect()}
    assert {"video-player-page", "catalog-page", "anime-detail-page", "generic"} <= got


# -- events as fixtures ---------------------------------------------------------


@pytest.fixture
def tables(spark, tmp_path, sf_dir):
    """A folder of tables whose events are given: (event_id, user_id, event_type, value, k)."""

    def make(events):
        t = datetime.datetime(2024, 1, 1)
        made = [(e, t + datetime.timedelta(seconds=e), u, kind, float(v), json.dumps({"k": k})) for e, u, kind, v, k in events]
        spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    return make


def test_failing_providers_at_thirty_percent(spark, tables):
    # Provider pU succeeds unless the event is an error or U equals event_id modulo 7; U from 10 never does.
    events = [(i, 10, "error" if i < 3 else "view", 1, 0) for i in range(4)] + [(10 + i, 11, "error" if i < 2 else "view", 1, 0) for i in range(3)] + [(20, 12, "view", 1, 0)]
    got = [(r["provider"], r["success_pct"], r["failing"]) for r in Q.run("failing_providers", spark, tables(events)).orderBy("rank").collect()]
    assert got == [("p11", 33, False), ("p10", 25, True)]


def test_skip_classes_are_by_domain_and_class(spark, tables):
    # Class btn-server (k % 7 = 0) fails once each for three kinds of element; no type alone has three failures.
    events = [(1, 1, "view", 1, 0), (2, 1, "click", 1, 0), (3, 1, "signup", 1, 28), (4, 2, "view", 1, 1)]
    got = [tuple(r) for r in Q.run("skip_classes", spark, tables(events)).collect()]
    assert got == [("site1", "btn-server", 3)]


def test_strategies(spark, tables):
    servers = lambda u, n, first: [(first + i, u, "error", 1, 100 + i) for i in range(n)]  # noqa: E731  content-servers steps
    views = lambda u, n, first, twice: [(first + i, u, "view", 1, i // 2 if twice else i) for i in range(n)]  # noqa: E731  navigations
    events = servers(1, 1, 0) + views(1, 5, 10, False) + views(2, 20, 100, False) + servers(3, 3, 200) + views(3, 24, 300, True) + servers(4, 3, 400) + views(4, 24, 500, False)
    got = {r["user_id"]: (r["strategy"], r["selectors"]) for r in Q.run("site_profile", spark, tables(events)).collect()}
    assert got == {1: ("static", 0), 2: ("dynamic", 0), 3: ("intelligent", 12), 4: ("dynamic", 0)}
    configs = {r["user_id"]: r["video_type"] for r in Q.run("provider_config", spark, tables(events)).collect()}
    assert configs == {1: "iframe", 3: "iframe", 4: "iframe"}


def test_known_servers_and_static_files(spark, sf_dir):
    from pagemill.functions import rules as R

    got = Q.run("known_servers", spark, sf_dir).collect()
    assert len(R.KNOWN_SERVERS) == 44 and all(r["known"] == (r["label"] != "server 1") for r in got)
    for url, static in (("a.eot", True), ("a.woff2?x", True), ("a.jpg", False), ("a.gif", False), ("/favicon.ico", True)):
        assert spark.sql(f"SELECT {SPARK.like(repr(url), R.STATIC_FILES)} AS v").first()["v"] is static


# -- graphs ---------------------------------------------------------------------


def test_redirects(spark):
    hops = [("https://ouo.io/1", "https://go.adf.ly/2", False), ("https://go.adf.ly/2", "https://site.com/3", False), ("https://site.com/3", "https://site.com/3", False), ("https://bc.vc/1", "https://ouo.io/x", True), ("https://exe.io/1", "https://exe.io/2", False)]
    table = spark.createDataFrame([(u, t, 200, b) for u, t, b in hops], "url string, to_url string, status int, blocked boolean")
    starts = spark.createDataFrame([("https://ouo.io/1",), ("https://bc.vc/1",), ("https://exe.io/1",), ("https://site.com/3",)], "url string")
    got = {r["start"]: (r["url"], r["hops"], r["blocked"], r["error"]) for r in graph.redirect_chains(table, starts, ("ouo.io", "adf.ly", "bc.vc", "exe.io")).collect()}
    assert got == {
        "https://ouo.io/1": ("https://site.com/3", 2, False, False), "https://bc.vc/1": ("https://ouo.io/x", 1, True, False), "https://exe.io/1": ("https://exe.io/2", 2, False, True),
        "https://site.com/3": ("https://site.com/3", 2, False, False),
    }


def test_embeds(spark):
    steps = spark.createDataFrame([("a", None, "b"), ("b", "f.mp4", None), ("c", None, "d"), ("d", None, "c"), ("e", None, None)], "url string, direct_url string, frame_url string")
    got = {r["embed_url"]: tuple(r)[1:] for r in graph.resolve_embeds(steps, spark.createDataFrame([(x,) for x in "acez"], "url string")).collect()}
    assert got == {"a": ("f.mp4", "direct", 2, ""), "c": (None, "generic", 2, "not_found"), "e": (None, "generic", 1, "not_found"), "z": (None, "fetch", 1, "fetch_failed")}


def test_exploration(spark):
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(6)] + [(2, f"n{i}", f"n{i + 1}") for i in range(6)] + [(1, "n0", "p/7"), (1, "p/8", "q")], "graph long, from_url string, to_url string")
    roots = spark.createDataFrame([(1, "n0"), (2, "n0")], "graph long, url string")
    servers = spark.createDataFrame([(1, "n1"), (1, "n2"), (1, "n3"), (2, "n1")], "graph long, url string")
    got = {(r["graph"], r["key"]): r["depth"] for r in graph.explore(edges, roots, servers).collect()}
    assert got == {(1, "n0"): 0, (1, "n1"): 1, (1, "n2"): 2, (1, "n3"): 3, (1, "n4"): 4, (1, "p/X"): 1, (1, "q"): 2, (2, "n0"): 0, (2, "n1"): 1, (2, "n2"): 2, (2, "n3"): 3}


# -- stores, settings -----------------------------------------------------------


@pytest.mark.parametrize("name", list(stores.STORES))
def test_stores_round_trip(spark, sf_dir, tmp_path, name):
    store = stores.STORES[name](spark, sf_dir)
    stores.write_store(store, str(tmp_path / "s"))
    got = stores.read_store(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in store.collect()} and all(json.loads(r["data"]) for r in got.limit(20).collect())


def test_store_versions(spark, tmp_path):
    spark.createDataFrame([(0, "s", "old", "{}"), (1, "s", "one", "{}"), (2, "s", "two", "{}")], stores._ENTRY).write.json(str(tmp_path / "v"))
    assert {r["name"] for r in stores.read_store(spark, str(tmp_path / "v")).collect()} == {"one", "two"}
    patterns = stores.session_memory(spark, "/root/testdata/sf0.001").where("section = 'patterns'")
    assert patterns.count() == 200


def test_json_sources(spark, tmp_path):
    (tmp_path / "u.json").write_text('["https://a.com/1", "ftp://x", "http://b.com"]')
    assert [tuple(r) for r in stores.read_urls(spark, str(tmp_path / "u.json")).collect()] == [(0, "https://a.com/1"), (2, "http://b.com")]
    (tmp_path / "p.json").write_text('[{"name": "a", "baseUrl": "https://a.com", "videos": {"type": "iframe"}}, {"name": "b"}]')
    new = stores.read_providers(spark, str(tmp_path / "p.json"))
    assert [(r["name"], r["videos"]["type"]) for r in new.collect()] == [("a", "iframe")]
    old = spark.createDataFrame([("a", "old"), ("c", "kept"), ("d", "gone")], "name string, title string")
    got = stores.register(old, new, spark.createDataFrame([("d",)], "name string"))
    assert {(r["name"], r["title"]) for r in got.collect()} == {("a", None), ("c", "kept")}


def test_settings():
    got = config.load({"retry": {"max": 7}, "strategies": None}, {"PAGEMILL_RETRY_MAX": "5", "PAGEMILL_RETRY_DELAY_MS": "9", "PAGEMILL_STRATEGIES": "a, b", "PAGEMILL_BLOCK_RESOURCES": "false", "PAGEMILL_CONCURRENCY": "x"})
    assert got["retry"] == {"max": 7, "delay_ms": 9} and got["strategies"] == ["a", "b"] and got["block_resources"] is False and got["concurrency"] == 3


def test_circuit_reset(spark):
    states = spark.createDataFrame([("a", "open", 5, 1, 2, 10), ("b", "open", 5, 1, 2, 10)], state.CIRCUIT_SCHEMA)
    got = {r["provider"]: (r["state"], r["failures"]) for r in state.reset(states, states.where("provider = 'a'")).collect()}
    assert got == {"a": ("closed", 0), "b": ("open", 5)} and {r["state"] for r in state.reset(states).collect()} == {"closed"}


@pytest.mark.parametrize("name", [n for n in scans.QUERIES if n.startswith(("scan_", "url_", "resolved", "redirect", "exploration", "extracted", "quick"))])
def test_scan_queries_find_something(spark, sf_dir, name):
    assert scans.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_media_pages_are_as_many(spark, sf_dir):
    assert media.media_pages(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert isinstance(scans.parsed(spark, media.media_pages(spark, sf_dir)), Dialect)
