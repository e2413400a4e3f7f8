"""Sharding by balanced label propagation.

Every document starts on a shard dealt by a hash of its id.  In each round half
of the documents that have links, chosen by a hash, look at the shards of their
neighbours and, where another shard holds more of them than their own, ask to
move there.  Between two shards as many moves one way are granted as the other
way, and more while the shard's quota lasts, those of most gain first.
Documents without links are indifferent and fill what is left, so shard sizes
end at most one row apart.

All steps are joins and aggregates over ids.  Quotas and row numbers are dealt
out per hash bucket of bounded size, so no shard is ever gathered in one task;
only the row counts of the shards themselves come to the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import partitions_for, staged

SHARDS = 8
ROUNDS = 10
#: Rows of a bucket in which moves are ranked and slots numbered.
BUCKET_ROWS = 5_000


def _pick(values: list[int], index: Column) -> Column:
    """The value for a shard number; null without one."""
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), index)


def _numbered(rows: DataFrame, group: str, bucket: str, order: list[str]) -> DataFrame:
    """``rank`` from 0 within ``group``, by way of the buckets' counts."""
    sizes = rows.groupBy(group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, bucket).orderBy(*order)
    return rows.withColumn("_own", F.row_number().over(own)).join(starts, [group, bucket]).withColumn("rank", F.col("_start") + F.col("_own") - 1).drop("_own", "_start")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, label) for the nodes that have links, after ``rounds`` of moves under the shards' capacities.

    ``nodes`` has columns node (long), label (int, at the start); ``links`` a, b (long).
    A repeated link counts each time; links to unknown nodes and to oneself count nothing.
    """
    pairs = links.where("a <> b")
    both = staged(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "links")
    cur = staged(nodes.join(both.select(F.col("dst").alias("node")).distinct(), "node", "left_semi"), "labels")
    count = cur.count()
    buckets = partitions_for(nodes.sparkSession, count, BUCKET_ROWS)
    for turn in range(rounds):
        sizes = {r["label"]: r["count"] for r in cur.groupBy("label").count().collect()}  # a row for each shard
        votes = both.join(cur.select(F.col("node").alias("src"), F.col("label").alias("to")), "src").groupBy("dst", "to").agg(F.count("*").alias("votes"))
        best = votes.groupBy("dst").agg(F.max(F.struct("votes", (-F.col("to")).alias("low"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("to", "votes"))).alias("all"))
        wish = cur.join(best, F.col("node") == F.col("dst")).select(
            "node", "label", (-F.col("best.low")).alias("to"), (F.col("best.votes") - F.coalesce(F.try_element_at("all", F.col("label")), F.lit(0))).alias("gain")
        )
        # Half of the nodes ask in a round, else two linked nodes swap places for ever.
        wish = wish.where(F.col("gain") > 0).where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
        wish = staged(wish.withColumn("way", F.col("label") * shards + F.col("to")).withColumn("bucket", F.struct((-F.col("gain")).alias("loss"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(buckets)).alias("part"))), "wishes")
        asked = {r["way"]: r["count"] for r in wish.groupBy("way").count().collect()}  # a row for each two shards
        if not asked:
            break
        grants = _grants(asked, [capacity[s] - sizes.get(s, 0) for s in range(shards)])
        moves = _numbered(wish, "way", "bucket", ["node"]).where(F.col("rank") < _pick(grants, F.col("way"))).select("node", "to")
        cur = staged(cur.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return cur


def _grants(asked: dict[int, int], room: list[int]) -> list[int]:
    """Moves granted from each shard to each other: as many as come back, and what the room left in a shard admits."""
    shards = len(room)
    out = [min(asked.get(s * shards + t, 0), asked.get(t * shards + s, 0)) for s in range(shards) for t in range(shards)]
    left = [max(0, r) for r in room]
    for way in sorted(asked, key=lambda w: (out[w] - asked[w], w)):
        more = min(asked[way] - out[way], left[way % shards])
        out[way] += more
        left[way % shards] -= more
        left[way // shards] += more if room[way // shards] >= 0 else 0
    return out


def shard_documents(docs: DataFrame, links: DataFrame | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null).

    Shards' row counts differ by one at most; slots number a shard's rows from 0
    without gaps.  Without ``links`` (columns a, b of ids) documents of equal
    texts are linked, by way of the smallest id of each group.  A null text has
    size 1 and the checksum of the empty text, and is in a group with the
    other null texts.  Null ids are placed like any other unlinked row; repeated ids give a row
    each.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("text_key"),
    )
    rows = staged(rows, "rows")  # about 60 bytes a document
    total = rows.count()
    if links is None:
        groups = rows.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("text_key", "a")
        links = rows.join(groups, "text_key").select("a", F.col("doc_id").alias("b"))
    nodes = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node")).distinct().select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("label"))
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(nodes, links, shards, capacity, rounds)
    buckets = partitions_for(docs.sparkSession, total, BUCKET_ROWS)
    placed = rows.join(labels, rows["doc_id"] == labels["node"], "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("label", F.lit(shards)).cast("int").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(buckets)).cast("int").alias("bucket")
    )
    placed = staged(_numbered(placed, "label", "bucket", ["doc_id", "size", "text_crc32"]), "placed")
    held = {r["label"]: r["count"] for r in placed.groupBy("label").count().collect()}  # a row for each shard, and the rest
    fixed = [min(held.get(s, 0), capacity[s]) for s in range(shards)]
    over = [held.get(s, 0) - fixed[s] for s in range(shards)]
    first_over = [0, *accumulate(over)]
    # Rows beyond a shard's capacity, then the unlinked ones, fill the free slots of all shards in turn.
    rest = F.when(F.col("label") < shards, _pick(first_over, F.col("label")) + F.col("rank") - _pick(fixed, F.col("label"))).otherwise(F.lit(first_over[-1]) + F.col("rank"))
    free = [capacity[s] - fixed[s] for s in range(shards)]
    ends = list(accumulate(free))
    stays = (F.col("label") < shards) & (F.col("rank") < F.coalesce(_pick(fixed, F.col("label")), F.lit(0)))
    target = F.lit(0)
    for s in range(shards - 1):
        target = target + F.when(F.col("rest") >= ends[s], 1).otherwise(0)
    out = placed.withColumn("stays", stays).withColumn("rest", rest).withColumn("shard", F.when(F.col("stays"), F.col("label")).otherwise(target).cast("int"))
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(_pick(fixed, F.col("shard")) + F.col("rest") - (_pick(ends, F.col("shard")) - _pick(free, F.col("shard"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links (a, b) in all, and those whose ends are on different shards of ``assigned`` (doc_id, shard)."""
    ends = links.join(assigned.select(F.col("doc_id").alias("a"), F.col("shard").alias("sa")), "a").join(assigned.select(F.col("doc_id").alias("b"), F.col("shard").alias("sb")), "b")
    return ends.agg(F.count("*").alias("links"), F.count_if(F.col("sa") != F.col("sb")).alias("cut"))
