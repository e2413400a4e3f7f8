"""Connected components by alternating star contractions, without collecting the graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import staged


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` with the parts of each i and j joined; every entry is the smallest index of its part.

    Only roots are hooked, to smaller roots, so nothing that was joined before comes apart.
    """
    while True:
        while (label[label] != label).any():
            label = label[label]
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: long); component is the smallest node reachable.

    Large-star and small-star steps by turns: each replaces edges by as many or
    fewer that point to smaller nodes, and no step needs a node's neighbours in
    one place: the minimum is an aggregate, the rest a join that adaptive
    execution can split.  Each round is written to the shared folder.  Self
    loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    cur = staged(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    for _ in range(most_rounds):
        if not state["n"]:
            break
        # Large star: neighbours larger than u join the smallest of u's closed neighbourhood.
        both = cur.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(cur.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours join the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        cur = staged(nxt, "edges")
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
