"""Queries over parsed pages: every scan, the element rules on what the parser gives, embeds, redirects, exploration, stores.

HTML can't be parsed in SQL: these have no DuckDB SQL and are tested by golden rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import rules as R
from pagemill.functions import urls as U
from pagemill.functions.dialect import SPARK, Dialect
from pagemill.operators import graph
from pagemill.plans import queries as Q
from pagemill.plans import records
from pagemill.session import ship
from pagemill.sources import dom, html, media, stores

Query = Callable[[SparkSession, str], DataFrame]
_VIEWS = count()


def element_urls(elements: DataFrame, model: bool = False) -> DataFrame:
    """S7, with ``model`` S8: ``elements`` (attr: map) with ``urls``: source or address, data attributes that hold URLs, URLs in onclick."""
    bad = "^(#|javascript:)" if model else "^(#|javascript:|about:blank$)"
    src = "coalesce(nullif(attr['src'], ''), nullif(attr['href'], ''), '')"
    own = f"CASE WHEN {src} <> '' AND NOT ({src} RLIKE '{bad}') THEN array({src}) ELSE array() END"
    data = "transform(filter(map_entries(attr), e -> e.key LIKE 'data-%' AND e.key RLIKE 'url|src|href|link|video|embed' AND e.value LIKE 'http%'), e -> e.value)"
    code = f"regexp_extract_all(coalesce(attr['onclick'], ''), {SPARK.text(R.QUOTED_URL)}, 0)"
    return elements.withColumn("urls", F.expr(f"concat({', '.join([own, *([] if model else [data]), code])})"))


def relation(elements: DataFrame) -> DataFrame:
    """Scanned elements with the columns that the element rules read."""
    first = F.element_at(F.split(F.trim("class"), r"\s+"), 1)
    values = F.concat_ws(" ", F.array_join(F.map_values("attr"), " "), F.array_join(F.map_keys("attr"), " "))
    return element_urls(elements).select(
        "page_id", "seq", F.lower("tag").alias("tag"), "type", "class", first.alias("cls"), "id", "parent", "selector", F.col("text").alias("txt"), F.coalesce(F.col("attr")["href"], F.lit("")).alias("href"),
        F.lower("text").alias("e_text"), F.lower("class").alias("e_class"), F.lower(values).alias("e_attrs"), F.size("urls").alias("n_urls"), F.size(F.filter(F.map_keys("attr"), lambda k: k.startswith("data-"))).alias("n_data"),
    )


def parsed(spark: SparkSession, pages: DataFrame, live: bool = False) -> Dialect:
    """Spark's dialect over the elements and pages of ``pages`` (page_id, url, html)."""
    ship(spark)
    names = f"parsed_elements_{(n := next(_VIEWS))}", f"parsed_pages_{n}"
    relation(dom.scan(pages, "live_elements") if live else html.scan_elements(pages)).createOrReplaceTempView(names[0])
    pages.createOrReplaceTempView(names[1])
    return Dialect("spark", *names)


def _parsed_rule(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.run(name, spark, sf_dir, parsed(spark, media.media_pages(spark, sf_dir)))

    run.__doc__ = f"{name} over parsed elements of media pages."
    return run


def _scanned(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return dom.scan(media.media_pages(spark, sf_dir), name)

    run.__doc__ = dom.SCANS[name][0].__doc__
    return run


def url_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that each element names, with and without data attributes."""
    ship(spark)
    rows = html.scan_elements(media.media_pages(spark, sf_dir))
    both = element_urls(element_urls(rows).withColumnRenamed("urls", "all_urls"), model=True).withColumnRenamed("urls", "model_urls")
    return both.where("size(all_urls) > 0").select("page_id", "seq", "all_urls", "model_urls")


def page_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of page and advice from what the heuristics find in it."""
    ship(spark)
    view = f"parsed_findings_{next(_VIEWS)}"
    dom.scan(media.media_pages(spark, sf_dir), "findings").withColumnRenamed("type", "finding").createOrReplaceTempView(view)
    return spark.sql(records.diagnosis(SPARK, view))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is extracted for each kind of finding, as JSON."""
    ship(spark)
    pages = media.media_pages(spark, sf_dir)
    parts = []
    for kind in dom.EXTRACTORS:
        got = dom.extract(pages, kind)
        parts.append(got.select("page_id", F.lit(kind).alias("finding"), "seq", F.to_json(F.struct(*(c for c in got.columns if c not in ("page_id", "seq")))).alias("data")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolved_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeds of the media pages followed from frame to frame to a file."""
    ship(spark)
    pages = media.embed_pages(spark, sf_dir)
    steps = dom.scan(pages.withColumn("page_id", F.xxhash64("url")), "embed_step").withColumnRenamed("page_id", "k")
    frames = dom.scan(media.media_pages(spark, sf_dir), "video_player").select(F.regexp_replace("src", "^//", "https://").alias("url")).distinct()
    return graph.resolve_embeds(pages.select("url", F.xxhash64("url").alias("k")).join(steps, "k").drop("k"), frames)


def _hops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Where each address leads, with status and whether it is withheld; and addresses to start from: affiliates lead on, one in nine is withheld, one in eleven missing."""
    n = F.col("page_id")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    host = lambda k: F.element_at(F.array(*map(F.lit, R.AFFILIATE_DOMAINS)), (k % len(R.AFFILIATE_DOMAINS) + 1).cast("int"))
    start = F.concat(F.lit("https://"), host(n), F.lit("/a"), n.cast("string"))
    middle = F.concat(F.lit("https://go."), host(n + 3), F.lit("/b"), n.cast("string"))
    end = F.concat(F.lit("https://site.com/c"), n.cast("string"))
    blocked = n % 9 == 0
    one = rows.select(start.alias("url"), F.when(n % 3 == 0, end).otherwise(middle).alias("to_url"), F.lit(200).alias("status"), F.lit(False).alias("blocked"))
    two = rows.where(n % 11 != 0).select(middle.alias("url"), end.alias("to_url"), F.lit(200).alias("status"), blocked.alias("blocked"))
    three = rows.select(end.alias("url"), end.alias("to_url"), F.lit(200).alias("status"), F.lit(False).alias("blocked"))
    return one.unionByName(two).unionByName(three), rows.select(start.alias("url"))


def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of redirects to the first address that is no affiliate's, that withholds itself, or that fails."""
    return graph.redirect_chains(*_hops(spark, sf_dir), R.AFFILIATE_DOMAINS)


def exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages met from a root in three steps, in four where three server pages are among them; addresses that differ in a last number are one."""
    edges = Q.run("nav_edges", spark, sf_dir).withColumnRenamed("user_id", "graph")
    servers = Q.run("nav_counts", spark, sf_dir).where("servers > 0").select(F.col("user_id").alias("graph"), "url")
    roots = edges.select("graph", F.concat(F.lit("http://u"), F.col("graph").cast("string"), F.lit(".example.com/")).alias("url")).distinct()
    return graph.explore(edges, roots, servers)


def quick_investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's live URLs without ads, as a server catalog: of each server the first eight that differ in thirty letters of their fingerprint."""
    ship(spark)
    view = f"quick_urls_{next(_VIEWS)}"
    dom.scan(media.media_pages(spark, sf_dir), "live_urls").withColumn("context", F.lit("")).createOrReplaceTempView(view)
    d = SPARK
    named = f"SELECT *, {U.server_name(d, U.domain(d, 'url'))} AS server FROM ({U.classified(d, f'(SELECT * FROM {view} WHERE NOT {d.like("lower(url)", R.AD_HOSTS)}) q_u')}) q_c"
    one = f"SELECT *, row_number() OVER (PARTITION BY page_id, server, fp ORDER BY seq) AS rn FROM (SELECT *, substr({U.catalog_fingerprint(d, 'url')}, 1, 30) AS fp FROM ({named}) q_n) q_f"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY page_id, server ORDER BY seq) AS rank FROM ({one}) q_o WHERE rn = 1"
    kind = "CASE WHEN type = 'unknown' THEN 'other' ELSE type END"
    return spark.sql(f"SELECT page_id, server, count(*) AS n_urls, {d.joined('url', ' ', 'seq')} AS urls, {d.joined(kind, ' ', 'seq')} AS types FROM ({ranked}) q_r WHERE rank <= 8 GROUP BY page_id, server")


def _store(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stores.STORES[name](spark, sf_dir)

    run.__doc__ = stores.STORES[name].__doc__
    return run


#: Element rules that also run on parsed elements.
PARSED = (
    "element_intent", "element_score", "element_zone", "element_priority", "dominant_zone", "page_type", "repeating_classes", "card_classes", "page_goal", "element_groups", "search_ranking", "page_report",
    "semantic_tree", "site_analysis", "reader_pages", "content_goal", "universal_skeleton",
)

QUERIES: dict[str, Query] = {
    **{f"scan_{name}": _scanned(name) for name in dom.SCANS if name != "embed_step"},
    **{f"parsed_{name}": _parsed_rule(name) for name in PARSED},
    "url_elements": url_elements,
    "page_diagnosis": page_diagnosis,
    "extracted": extracted,
    "resolved_embeds": resolved_embeds,
    "redirect_chains": redirect_chains,
    "exploration": exploration,
    "quick_investigation": quick_investigation,
    **{f"store_{name}": _store(name) for name in stores.STORES},
}
