"""Queries of the operators that need Python or iteration: HTML scans, graphs, state machines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.dialect import DUCK, SPARK, Dialect
from pagemill.operators import graph, state
from pagemill.plans import queries as Q
from pagemill.session import ship
from pagemill.sources import html
from pagemill.sources import views as V


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("p"), F.col("user_id") % 20).alias("provider"), F.col("event_id").alias("seq"), (F.col("event_id") * 60_000).alias("ts_ms"), ((F.col("event_type") != "error") & (F.col("user_id") % 3 != F.col("event_id") % 3)).alias("success"),
        F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 503).otherwise(200).alias("status"),
    )


def circuit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    ship(spark)
    return state.circuit_states(_events(spark, sf_dir))


def throttle_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    ship(spark)
    return state.throttle_delays(_events(spark, sf_dir))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned element, with its type, text, class, id, selector and attributes."""
    ship(spark)
    return html.scan_elements(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("href", F.col("attr")["href"])


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lazy images of a page in order."""
    ship(spark)
    return html.scan_images(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meta tags of S16: one row for each name."""
    ship(spark)
    return html.scan_metadata(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct URLs of a page in order."""
    ship(spark)
    return html.scan_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def circuit_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider's circuit, closed where none is known, and whether it is failing (open) or healthy (closed)."""
    known = circuit_states(spark, sf_dir).where("provider <> 'p3'").select("provider", "state")
    rows = Q.run("provider_stats", spark, sf_dir).select("provider", "success_pct").join(known, "provider", "left").withColumn("state", F.coalesce("state", F.lit("closed")))
    return rows.withColumn("failing", F.col("state") == "open").withColumn("healthy", F.col("state") == "closed")


def circuit_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuits after those of every fourth provider are reset."""
    states = circuit_states(spark, sf_dir)
    return state.reset(states, states.select("provider").where("CAST(substr(provider, 2) AS INT) % 4 = 0"))


def _roots(d: Dialect) -> str:
    return f"SELECT DISTINCT user_id AS graph, concat('http://u', {V.string(d, 'user_id')}, '.example.com/') AS url FROM events"


def nav_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least depth of each page, 0 where the root doesn't reach it; the first shortest path, and its reliability."""
    edges = Q.run("nav_edges", spark, sf_dir).withColumnRenamed("user_id", "graph")
    roots = spark.sql(f"WITH events AS (SELECT * FROM parquet.`{sf_dir}/events.parquet`) {_roots(SPARK)}")
    nodes = edges.select("graph", F.col("from_url").alias("url")).unionByName(edges.select("graph", F.col("to_url").alias("url"))).distinct()
    got = nodes.join(graph.shortest_paths(edges, roots), ["graph", "url"], "left")
    return got.select("graph", "url", F.coalesce("depth", F.lit(0)).alias("depth"), "path", F.when(F.col("path").isNotNull(), F.greatest(F.lit(0.5), F.round(1 - 0.1 * F.size("path"), 6))).alias("reliability"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "circuit_states": circuit_states,
    "circuit_health": circuit_health,
    "circuit_reset": circuit_reset,
    "throttle_delay": throttle_delay,
    "page_elements": page_elements,
    "page_images": page_images,
    "page_metadata": page_metadata,
    "page_urls": page_urls,
    "nav_depth": nav_depth,
}

ORACLE_SQL: dict[str, str] = {
    "page_urls": f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS seq, url, 'link' AS kind FROM (SELECT page_id, url, min(seq) AS seq FROM ({V.links(DUCK)}) l WHERE url LIKE 'http%' OR url LIKE '/%' GROUP BY page_id, url) u",
}
