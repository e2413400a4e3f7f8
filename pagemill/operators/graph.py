"""Graphs by frontier joins: depths and shortest paths (G4, G5), redirect chains (G8), exploration (G9), embeds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import staged


#: Rounds between two writes of all pages seen so far.
_GATHERED_ROUNDS = 16


def shortest_paths(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(graph, url, depth, path) of every page reachable from its graph's root, in ``most_depth`` steps if that is given.

    ``edges``: graph, from_url, to_url, seq; ``roots``: graph, url.  Among paths
    of equal length the one whose edges come first is taken: by the sequence of
    their edge numbers.  Pages out of reach have no row.  Each round is written
    to the shared folder; the search ends when a round finds no new page.
    """
    seen = roots.select("graph", "url", F.lit(0).alias("depth"), F.array("url").alias("path"), F.array().cast("array<bigint>").alias("order"))
    frontier = seen = staged(seen, "paths")
    steps = staged(edges.select("graph", "from_url", "to_url", F.col("seq").cast("long").alias("seq")), "steps")
    for depth in count(1) if most_depth is None else range(1, most_depth + 1):
        nxt = frontier.join(steps, (frontier["graph"] == steps["graph"]) & (frontier["url"] == steps["from_url"])).select(
            frontier["graph"], F.col("to_url").alias("url"), F.lit(depth).alias("depth"), F.concat("path", F.array("to_url")).alias("path"), F.concat("order", F.array("seq")).alias("order")
        )
        best = nxt.groupBy("graph", "url").agg(F.min_by(F.struct("depth", "path", "order"), "order").alias("b")).select("graph", "url", "b.*")
        frontier = staged(best.join(seen.select("graph", "url"), ["graph", "url"], "left_anti"), "paths")
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
        if depth % _GATHERED_ROUNDS == 0:
            seen = staged(seen, "paths")
    return seen.select("graph", "url", "depth", "path")


def redirect_chains(hops: DataFrame, starts: DataFrame, affiliates: tuple[str, ...], most_hops: int = 10) -> DataFrame:
    """(start, url, hops, blocked, error, chain) at the end of each start's redirects.

    ``hops``: url, to_url, status, blocked, each url once; ``starts``: url.  A
    chain ends where a page is withheld, where after the first hop an address
    leads to itself or to no affiliate's (a name in ``affiliates`` or below it),
    where an address leads nowhere (an error), or after ``most_hops``.  Each hop
    is written to the shared folder.
    """
    known = staged(hops.select("url", "to_url", "blocked"), "hops")
    host = F.regexp_extract("to_url", "^[a-z]+://([^/?#:]+)", 1)
    theirs = F.exists(F.array(*map(F.lit, affiliates)), lambda a: (host == a) | host.endswith(F.concat(F.lit("."), a)))
    done = []
    cur = starts.select(F.col("url").alias("start"), F.col("url").alias("at"), F.array().cast("array<string>").alias("chain"))
    for hop in range(most_hops):
        met = cur.join(known, cur["at"] == known["url"], "left").withColumn("error", F.col("to_url").isNull()).withColumn("withheld", F.coalesce("blocked", F.lit(False)))
        met = met.withColumn("chain", F.concat("chain", F.array(F.coalesce("to_url", "at"))))
        ends = F.col("error") | F.col("withheld") | (F.lit(hop > 0) & ((F.col("to_url") == F.col("at")) | ~theirs)) | F.lit(hop == most_hops - 1)
        met = staged(met.select("start", F.coalesce("to_url", "at").alias("at"), "chain", "error", "withheld", ends.alias("ends")), "chains")
        done.append(met.where("ends").select("start", F.col("at").alias("url"), F.size("chain").alias("hops"), F.col("withheld").alias("blocked"), "error", "chain"))
        cur = met.where("NOT ends").select("start", "at", "chain")
        if not cur.head(1):
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def resolve_embeds(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(embed_url, direct_url, method, hops, error) of each start: frames are followed until a page names a media file.

    ``steps``: url, direct_url, frame_url of each page; ``starts``: url.  A page
    that is missing gives ``fetch_failed``, one that leads nowhere or back
    ``not_found``.  Each round is written to the shared folder.
    """
    known = staged(steps, "embeds")
    cur = starts.select(F.col("url").alias("embed_url"), F.col("url").alias("at"), F.array("url").alias("trail"))
    done = []
    for _ in count():
        met = cur.join(known.withColumn("here", F.lit(True)), cur["at"] == known["url"], "left")
        onward = F.col("direct_url").isNull() & F.col("frame_url").isNotNull() & ~F.array_contains("trail", F.coalesce("frame_url", F.lit("")))
        met = staged(met.select("embed_url", "trail", "here", "direct_url", "frame_url", onward.alias("onward")), "embeds")
        hops = F.size("trail")
        method = F.when(F.col("here").isNull() & (hops == 1), "fetch").when(F.col("direct_url").isNotNull(), "direct").otherwise("generic")
        error = F.when(F.col("direct_url").isNotNull(), "").when(F.col("here").isNull() & (hops == 1), "fetch_failed").otherwise("not_found")
        done.append(met.where("NOT onward").select("embed_url", "direct_url", method.alias("method"), hops.alias("hops"), error.alias("error")))
        cur = met.where("onward").select("embed_url", F.col("frame_url").alias("at"), F.concat("trail", F.array("frame_url")).alias("trail"))
        if not cur.head(1):
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def visited_key(url: Column) -> Column:
    """An address without query and last slashes, its last number as X."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[?].*$", ""), "/+$", ""), r"/\d+$", "/X")


def explore(edges: DataFrame, roots: DataFrame, servers: DataFrame, depth: int = 3, enough: int = 3) -> DataFrame:
    """(graph, key, depth, has_servers) of pages met from a root within ``depth`` steps, one more in graphs where ``enough`` server pages were met.

    ``edges``: graph, from_url, to_url; ``roots`` and ``servers``: graph, url.
    Addresses are one page by ``visited_key``.
    """
    key = lambda c: visited_key(F.col(c))
    steps = staged(edges.select("graph", key("from_url").alias("src"), key("to_url").alias("dst")).distinct(), "steps")
    known = staged(servers.select("graph", key("url").alias("key"), F.lit(True).alias("served")).distinct(), "servers")
    seen = frontier = staged(roots.select("graph", key("url").alias("key"), F.lit(0).alias("depth")), "met")
    for d in range(1, depth + 2):
        if d > depth:
            rich = seen.join(known, ["graph", "key"]).groupBy("graph").count().where(F.col("count") >= enough)
            frontier = frontier.join(rich.select("graph"), "graph", "left_semi")
        nxt = frontier.select("graph", F.col("key").alias("src")).join(steps, ["graph", "src"]).select("graph", F.col("dst").alias("key")).distinct()
        frontier = staged(nxt.join(seen, ["graph", "key"], "left_anti").withColumn("depth", F.lit(d)), "met")
        seen = seen.unionByName(frontier)
    return seen.join(known, ["graph", "key"], "left").select("graph", "key", "depth", F.coalesce("served", F.lit(False)).alias("has_servers"))
