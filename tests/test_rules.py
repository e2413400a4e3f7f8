"""Golden values of the rule functions, and every rule query against DuckDB."""

import duckdb
import pytest

from pagemill.functions import streams as S
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.functions.dialect import DUCK, SPARK, lit
from pagemill.plans import queries as Q


def value(spark, expr):
    return spark.sql(f"SELECT {expr} AS v").first()["v"]


@pytest.mark.parametrize(
    ("url", "context", "kind", "confidence", "box"),
    [
        ("https://embed.host.com/abc", "", "embed", 75, True),
        ("https://cdn.host.com/video.mp4", "", "direct-video", 95, False),
        ("https://host.com/a.m3u8", "", "stream", 90, False),
        ("https://host.com/a.zip", "", "download", 80, False),
        ("https://host.com/e/abc", "", "navigation", 60, True),
        ("https://host.com/x", "server 1", "embed", 65, True),
        ("https://analytics.host.com/a.mp4", "", "tracking", 80, False),
        ("https://host.tv/x", "", "unknown", 40, False),
        ("https://host.com:8080/x", "", "embed", 60, False),
        ("/The", "static-scan", "unknown", 20, False),
    ],
)
def test_url_classes(spark, url, context, kind, confidence, box):
    got = spark.sql(U.classified(SPARK, f"(SELECT {lit(url)} AS url, {lit(context)} AS context) t")).first()
    assert (got["type"], got["confidence"], got["is_container"]) == (kind, confidence, box)


@pytest.mark.parametrize(("domain", "name"), [("embed.host.com", "Host"), ("www.foo.co.uk", "Co"), ("localhost", "Localhost"), ("/The", "/The")])
def test_server_names(spark, domain, name):
    assert value(spark, U.server_name(SPARK, lit(domain))) == name


@pytest.mark.parametrize(
    ("url", "labels", "direct", "quality", "language", "kind", "priority"),
    [
        ("https://host.com/video.mp4", "4K Latino", "", "4K", "ES", "mp4", 100),
        ("https://host.com/video.mp4", "1080p FHD", "", "1080p", "ES", "mp4", 100),
        ("https://host.com/hd.mp4", "HD", "", "HD", "ES", "mp4", 95),
        ("https://host.com/cam.mp4", "CAM", "", "CAM", "ES", "mp4", 65),
        ("https://host.com/video.mp4", "server 1", "", "unknown", "ES", "mp4", 88),
        ("https://host.com/video.mp4", "ad publicidad", "", "unknown", "ES", "mp4", 55),
        ("https://host.com/video.mp4", "download", "", "unknown", "ES", "mp4", 60),
        ("https://host.com/video.mp4", "English sub", "", "unknown", "EN", "mp4", 73),
        ("https://host.com/embed/abc", "", "", "unknown", "ES", "embed", 65),
        ("magnet:?xt=urn:btih:abc123", "", "", "unknown", "ES", "torrent", 60),
        ("https://streamwish.to/e/abc", "server 1", "https://cdn.com/video.mp4", "unknown", "ES", "mp4", 68),
    ],
)
def test_streams(spark, url, labels, direct, quality, language, kind, priority):
    got = spark.sql(S.normalized(SPARK, f"(SELECT {lit(url)} AS url, {lit(labels)} AS labels, {lit(direct)} AS direct_url) t")).first()
    assert (got["quality"], got["language"], got["type"], got["priority"]) == (quality, language, kind, priority)


@pytest.mark.parametrize(
    ("a", "b", "x3", "x6"),
    [
        ("naruto", "naruto", 0.85, 1.0),
        ("naruto", "xyzxyz", 0.0, 0.0),
        ("naruto", "narutoo", 0.30, 0.95),
        ("naruto shippuden", "Naruto Shippuden - Episodio 1", 0.70, 0.95),
        ("capítulo", "capitulo", 0.31, 1.0),
        ("naruto", "boruto", 0.23, 0.23),
        ("attack on titan", "titan attack", 0.59, 0.80),
        ("", "naruto", 0.0, 0.0),
    ],
)
def test_similarity(spark, a, b, x3, x6):
    assert value(spark, X.similarity(SPARK, lit(a), lit(b))) == pytest.approx(x3)
    assert value(spark, X.title_similarity(SPARK, lit(a), lit(b))) == pytest.approx(x6)


def test_direct_video(spark):
    for url, want in (("https://a.com/v.mp4", True), ("https://a.com/hls/x", True), ("https://a.com/embed/x", False), ("https://a.com/v.mp4?t=1", True)):
        assert value(spark, U.is_direct_video(SPARK, lit(url))) is want


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in Q._TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(table):
    cols = sorted(table)
    norm = lambda v: None if v is None else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return cols, sorted(str([norm(table[c][i]) for c in cols]) for i in range(len(table[cols[0]])))


@pytest.mark.parametrize("name", list(Q.RULES))
def test_rule_against_duckdb(spark, duck, sf_dir, name):
    got = Q.QUERIES[name](spark, sf_dir).toArrow().to_pydict()
    want = duck.sql(Q.ORACLE_SQL[name]).to_arrow_table().to_pydict()
    assert rows(got) == rows(want)


def test_every_title_is_a_query(spark, duck, sf_dir):
    score = X.title_similarity(DUCK, "q.title", "c.p_name")
    every = f"SELECT q.title AS query, c.p_brand AS source, max({score}) AS score FROM (SELECT DISTINCT p_name AS title FROM part) q, (SELECT DISTINCT p_brand, p_name FROM part) c GROUP BY ALL HAVING max({score}) >= 0.4"
    want = {(q, s): float(x) for q, s, x in duck.sql(every).fetchall()}
    assert len({q for q, _ in want}) > 12
    got = Q.QUERIES["cross_source_match"](spark, sf_dir).collect()
    assert {(r["query"], r["source"]): float(r["score"]) for r in got} == pytest.approx(want) and len(got) == len(want)
    assert {r["query"] for r in Q.QUERIES["result_count_pick"](spark, sf_dir).collect()} == {q for q, _ in want}
