"""Stores of learned knowledge as JSON lines: one folder a store, one line an entry, each with the store's version.

Writing is a plain DataFrame write, so a store may be of any size; reading
checks the version.  Lists of URLs and providers are read from JSON arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.plans import queries as Q

#: Versions that a store may have; others are not read.
VERSIONS = (1, 2)
#: Patterns that session memory keeps.
KEPT_PATTERNS = 200
_ENTRY = "version int, section string, name string, data string"


def entries(section: str, rows: DataFrame, name: str, version: int) -> DataFrame:
    """Rows as entries of a store: section, name, and the other columns as JSON."""
    return rows.select(F.lit(version).alias("version"), F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.to_json(F.struct(*(c for c in rows.columns if c != name))).alias("data"))


def write_store(store: DataFrame, path: str) -> None:
    """K1 K2 K3 K4: write entries, in place of what is there."""
    store.write.mode("overwrite").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a store; those of unknown versions are left out."""
    return spark.read.schema(_ENTRY).json(path).where(F.col("version").isin(*VERSIONS))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(seq, url) of a JSON array of addresses; anything else in it is left out."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>")
    return whole.select(F.posexplode(items).alias("seq", "url")).where("url RLIKE '^https?://'")


PROVIDER = "name string, title string, baseUrl string, language string, categories array<string>, active boolean, search struct<url: string, itemSelector: string, titleSelector: string, linkSelector: string>, videos struct<type: string>"


def read_providers(spark: SparkSession, path: str) -> DataFrame:
    """Providers of a JSON file, one or an array of them; those without a name or a base address are left out."""
    return spark.read.schema(PROVIDER).json(path, multiLine=True).where("name IS NOT NULL AND baseUrl IS NOT NULL")


def register(registry: DataFrame, providers: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """A registry (name, ...) with providers added or put in place of those of their name, and the removed (name) gone."""
    out = providers.unionByName(registry.join(providers.select("name"), "name", "left_anti"), allowMissingColumns=True)
    return out if removed is None else out.join(removed.select("name"), "name", "left_anti")


def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session memory, version 2: domains, boosts, chains and the last two hundred patterns."""
    run = lambda name: Q.run(name, spark, sf_dir)
    domains = run("domain_fingerprint").groupBy("domain").agg(F.max("domain_rate").alias("rate"), F.sum("visits").alias("visits"), F.sort_array(F.collect_list(F.struct("class", "won", "lost"))).alias("classes"))
    boosts = run("session_boosts").withColumn("key", F.concat_ws(":", "kind", "name"))
    chains = run("url_chains").withColumn("key", F.concat_ws("|", "domain", "from_pattern", "to_type"))
    out = [entries("domains", domains, "domain", 2), entries("boosts", boosts, "key", 2), entries("urlChains", chains, "key", 2), entries("patterns", run("saved_patterns"), "seq", 2)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def provider_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider memory: a provider's counts, engines with their phases, order, and best selectors."""
    run = lambda name: Q.run(name, spark, sf_dir)
    phases = run("engine_phase_stats").groupBy("provider", "engine").agg(F.sum("successes").alias("successes"), F.sum("failures").alias("failures"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", F.struct("successes", "failures", "avg_ms").alias("stats"))))).alias("phases"))
    engines = phases.groupBy("provider").agg(F.sort_array(F.collect_list(F.struct("engine", "successes", "failures", F.to_json("phases").alias("phases")))).alias("engines"))
    order = run("engine_order").groupBy("provider").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "engine"))), lambda x: x["engine"]).alias("order"))
    selectors = run("selector_stats").groupBy("provider").agg(F.array_sort(F.collect_list(F.struct("rank", "selector", "rate", "attempts"))).alias("selectors"))
    return entries("providers", run("provider_stats").join(engines, "provider").join(order, "provider").join(selectors, "provider", "left"), "provider", 1)


def learned_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge base: domains and selectors after a merge, and patterns."""
    merged = Q.run("kb_merge", spark, sf_dir)
    return entries("knowledge", merged, "name", 1).unionByName(entries("patterns", Q.run("kb_selectors", spark, sf_dir), "action", 1))


def profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: a portable profile: providers, site profiles, navigation maps, knowledge base."""
    run = lambda name: Q.run(name, spark, sf_dir)
    maps = run("nav_edges").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "from_url", "to_url", "label"))).alias("edges"))
    out = entries("providers", run("provider_config"), "user_id", 1).unionByName(entries("siteProfiles", run("site_profile"), "user_id", 1))
    return out.unionByName(entries("navigationMaps", maps, "user_id", 1)).unionByName(learned_kb(spark, sf_dir))


STORES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"session_memory": session_memory, "provider_memory": provider_memory, "learned_kb": learned_kb, "profile_export": profile_export}
