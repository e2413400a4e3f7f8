"""State machines, HTML scans, graphs, streams."""

from pagemill.operators import graph, state
from pagemill.operators.state import Circuit, Throttle
from pagemill.session import ship
from pagemill.sources import html
from pagemill.streaming.circuit import circuit_stream


def test_circuit_opens_probes_and_closes():
    c = Circuit()
    for t in range(3):
        c.step(t, False, 3, 1000, 2)
    assert c.state == "open" and not c.step(500, True, 3, 1000, 2)
    c.step(2000, True, 3, 1000, 2)
    assert c.state == "half-open"
    c.step(2001, True, 3, 1000, 2)
    assert c.state == "closed"


def test_circuit_success_resets_and_probe_failure_reopens():
    c = Circuit()
    c.step(0, False, 2, 10, 2)
    c.step(1, True, 2, 10, 2)
    c.step(2, False, 2, 10, 2)
    assert c.state == "closed"
    c.step(3, False, 2, 10, 2)
    c.step(100, False, 2, 10, 2)
    assert c.state == "open" and c.opened_at == 100


def test_throttle():
    t = Throttle()
    t.step(429)
    assert t.delay == 2000
    for _ in range(5):
        t.step(200)
    assert t.delay == 1800
    for _ in range(5):
        t.step(0)
    assert t.stopped


def test_elements_and_urls():
    page = "<html><body><ul><li><a href='/x' class='btn big'>Hi  there</a><li><a href='#'>no</a></ul><div></div><iframe src='http://e.com/1'></iframe><img data-src='http://i.com/a.jpg' src='blank.gif'><meta name='k' content='v'></body></html>"
    got = list(html.elements(page))
    assert [(e["tag"], e["text"]) for e in got[:4]] == [("li", "Hi there"), ("a", "Hi there"), ("li", "no"), ("a", "no")]
    assert got[1]["selector"] == "a.btn" and got[1]["parent"] == "li"
    assert not any(e["tag"] == "div" for e in got)
    assert html.page_urls(page)[:2] == [("http://e.com/1", "iframe"), ("/x", "link")]
    assert html.images(page) == [("http://i.com/a.jpg", "data-src")]
    assert html.metadata(page) == {"k": "v"}
    assert html.page_urls(None) == [] and list(html.elements("")) == []


def test_page_queries_return_every_row(spark, tmp_path):
    from pagemill.plans import stateful

    page = "<head><meta name='k' content='v'></head><body><h1 id='t'>Title</h1><form class='f'><input name='q'><button>Go</button></form><a href='/x' class='btn'>Hi</a><img data-src='http://i.com/a.jpg'></body>"
    spark.createDataFrame([(7, "http://e.com/", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = stateful.page_elements(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["tag"], r["type"], r["text"], r["class"], r["id"], r["href"]) for r in got] == [
        ("h1", "heading", "Title", "", "t", None), ("form", "form", "Go", "f", "", None), ("input", "input", "", "", "", None),
        ("button", "clickable", "Go", "", "", None), ("a", "link", "Hi", "btn", "", "/x"), ("img", "image", "", "", "", None),
    ]
    assert [tuple(r) for r in stateful.page_images(spark, str(tmp_path)).collect()] == [(7, 1, "http://i.com/a.jpg", "data-src")]
    assert [tuple(r) for r in stateful.page_metadata(spark, str(tmp_path)).collect()] == [(7, "k", "v")]


def test_element_cap():
    assert len(list(html.elements("<a>x</a>" * 400))) == html.MOST_ELEMENTS


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, "r", "a", 1), (1, "r", "b", 2), (1, "b", "c", 3), (1, "a", "c", 4), (1, "c", "r", 5)], "graph long, from_url string, to_url string, seq long")
    roots = spark.createDataFrame([(1, "r")], "graph long, url string")
    got = {r["url"]: (r["depth"], r["path"]) for r in graph.shortest_paths(edges, roots).collect()}
    assert got == {"r": (0, ["r"]), "a": (1, ["r", "a"]), "b": (1, ["r", "b"]), "c": (2, ["r", "a", "c"])}


def test_nav_depth_has_no_bound(spark, sf_dir):
    from pagemill.plans import queries, stateful

    out = {}
    for e in sorted(queries.run("nav_edges", spark, sf_dir).collect(), key=lambda r: r["seq"]):
        out.setdefault((e["user_id"], e["from_url"]), []).append(e["to_url"])
    want = {}
    for (user,) in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().collect():
        root = f"http://u{user}.example.com/"
        want[user, root] = (0, [root])
        queue = [root]
        for url in queue:
            for to in out.get((user, url), []):
                if (user, to) not in want:
                    depth, path = want[user, url]
                    want[user, to] = (depth + 1, [*path, to])
                    queue.append(to)
    assert max(d for d, _ in want.values()) > 3
    rows = stateful.nav_depth(spark, sf_dir).collect()
    got = {(r["graph"], r["url"]): (r["depth"], r["path"]) for r in rows}
    assert got == want | {k: (0, None) for k in got.keys() - want.keys()}
    assert all(r["reliability"] == (None if r["path"] is None else max(0.5, round(1 - 0.1 * len(r["path"]), 6))) for r in rows)


def test_shortest_paths_of_a_long_chain(spark):
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}", i) for i in range(20)] + [(1, "n20", "n0", 20)], "graph long, from_url string, to_url string, seq long")
    got = {r["url"]: (r["depth"], len(r["path"])) for r in graph.shortest_paths(edges, spark.createDataFrame([(1, "n0")], "graph long, url string")).collect()}
    assert got == {f"n{i}": (i, i + 1) for i in range(21)}


def test_stream_equals_batch(spark, tmp_path):
    ship(spark)
    rows = [(f"p{i % 3}", i, i * 100, i % 4 == 0 or i % 7 == 0) for i in range(120)]
    events = spark.createDataFrame(rows, "provider string, seq long, ts_ms long, success boolean").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    want = {r["provider"]: r for r in state.circuit_states(events, 3, 1000, 2).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = circuit_stream(stream, 3, 1000, 2).writeStream.outputMode("update").format("memory").queryName("circuits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["provider"]: r for r in spark.table("circuits").collect()} == want


def test_messages_of_a_stream(spark, tmp_path):
    import json

    from pagemill.streaming import events

    steps = spark.createDataFrame([("navigate", "http://a", 1), ("content-servers", "http://b", 3), ("done", "", 5), ("dive", "http://c", 2)], "action string, target string, ts long").coalesce(1)
    steps.write.parquet(str(tmp_path / "in"))
    sent = []
    q = events.broadcast(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in")), sent.extend, str(tmp_path / "cp"), most=3)
    q.processAllAvailable()
    q.stop()
    assert [json.loads(m)["event"] for m in sent] == ["step", "step", "url-found", "complete"]
    assert json.loads(json.loads(sent[0])["data"]) == {"action": "navigate", "target": "http://a"}


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
