"""Approximate nearest neighbours by vantage-point trees per shard.

Rows are dealt to shards by the nearest of some sampled directions, and each
shard's tree is built where its queries are searched.  Trees stand over
directions, and each subtree, like each shard, knows its greatest length: a row
of at most that length reaches the query's present k-th inner product only
within some distance of the query's direction.  A subtree is skipped where the
triangle inequality shows that it lies beyond ``factor`` times that distance;
factor one restores exact search, smaller factors skip more.  Lengths may
differ as they like.

A query is searched in its own shard first.  With the k-th product found there
it goes on only to shards that the same inequality, relaxed by the same factor,
doesn't rule out.  The factor is the smallest of a few whose measured recall on
a sample of the queries, against brute force over all rows, is high enough.

Rows are sent once a search, but for shards with more queries than a block
holds; a shard with too many rows is split by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import partitions_for, ship, staged
from pagemill.llm.vectors import dimension, matrix, unit, usable

#: Relaxations that are tried, and the recall that the chosen one has on the sample of queries; one is exact.
FACTORS = (0.2, 0.35, 0.5, 0.75, 1.0)
FACTOR = FACTORS[0]
RECALL = 0.95
#: Queries on which recall is measured.
SAMPLE_QUERIES = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 8192
#: Directions that part the shards, at most, and rows from which they are sampled.
MOST_SHARDS = 4096
SAMPLE_ROWS = 16_384
LEAF = 256


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without squares that leave the range of doubles."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


class VpTree:
    """Vantage-point tree over the directions of rows; searches whole batches of queries for largest inner product."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7) -> None:
        self.points = points
        self.lengths = _lengths(points)
        self.unit = points / self.lengths[:, None]
        self.rng = np.random.default_rng(seed)
        self.leaf = leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        """(greatest length, rows), or (greatest length, vantage, middle, inner, outer)."""
        longest = float(self.lengths[rows].max())
        if len(rows) <= self.leaf:
            return longest, rows
        vantage = rows[self.rng.integers(len(rows))]
        gap = np.sqrt(np.maximum(((self.unit[rows] - self.unit[vantage]) ** 2).sum(1), 0))
        middle = float(np.median(gap))
        inside = gap < middle
        if not inside.any() or inside.all():  # equal distances: no vantage point parts them
            return longest, rows
        return longest, vantage, middle, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float | np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inner products with the queries' directions, rows), k for each query, unordered; missing ones have row -1.

        With ``floor`` products below a query's are of no interest.
        """
        factor = np.broadcast_to(np.asarray(factor, float), len(queries))
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        best = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1)
        asks = queries / _lengths(queries)[:, None]

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 2:
                found = node[1]
                cand = np.concatenate([best[at], asks[at] @ self.points[found].T], axis=1)
                ids = np.concatenate([rows[at], np.broadcast_to(found, (len(at), len(found)))], axis=1)
                top = np.argpartition(-cand, k - 1, axis=1)[:, :k]
                best[at] = np.take_along_axis(cand, top, 1)
                rows[at] = np.take_along_axis(ids, top, 1)
                return
            _, vantage, middle, inner, outer = node
            gap = np.sqrt(np.maximum(((asks[at] - self.unit[vantage]) ** 2).sum(1), 0))
            near = gap < middle
            for side, first, second in ((near, inner, outer), (~near, outer, inner)):
                some = at[side]
                visit(first, some)
                worst = np.maximum(best[some].min(1), floor[some])
                # A negative k-th product bounds no direction: any row may pass it by being short.
                reach = np.where(worst < 0, np.inf, factor[some] * np.sqrt(np.maximum(2 - 2 * np.maximum(worst, 0) / second[0], 0) + 1e-12))
                reach[worst > second[0] * (1 + 1e-9)] = -1.0  # too short in any direction
                visit(second, some[np.abs(middle - gap[side]) <= reach])

        visit(self.root, np.arange(len(queries)))
        return best, rows


def _shard_search(
    ids: np.ndarray, vecs: np.ndarray, qids: np.ndarray, qvecs: np.ndarray, k: int, factor: float | np.ndarray, floor: np.ndarray | None = None
) -> Iterator[tuple[int, int, float, int]]:
    """(query, row, inner product, number of the query) for the best k of a shard.

    Equal vectors are one point that stands for its smallest ids; one more than
    k of them are kept, as the query itself may be among them and no other
    could reach the result.  Where the last point found ties with the k-th row,
    all points that tie are looked up.
    """
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], vecs[order]
    points, group = np.unique(vecs, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by], np.arange(len(points)))
    ends = np.append(starts[1:], len(by))
    want = min(k + 9, len(points))
    lengths = _lengths(qvecs)
    _, rows = VpTree(points).search(qvecs, want, factor, None if floor is None else floor / lengths)
    for q, (qid, found) in enumerate(zip(qids.tolist(), rows, strict=True)):
        found = found[found >= 0]
        for again in (False, True):
            exact = (points[found] * qvecs[q]).sum(1)
            cand_ids, cand_score = [], []
            for p, s in zip(found.tolist(), exact.tolist(), strict=True):
                members = ids[by[starts[p] : min(ends[p], starts[p] + k + 1)]]
                cand_ids.append(members[members != qid][:k])
                cand_score.append(np.full(len(cand_ids[-1]), s))
            if not cand_ids:
                break
            flat, score = np.concatenate(cand_ids), np.concatenate(cand_score)
            top = np.lexsort((flat, -score))[:k]
            if again or len(found) < want or want == len(points) or len(top) < k:
                break
            kth = float(score[top[-1]])
            slack = 1e-12 * (abs(kth) + float(lengths[q]) * 1e-3)
            if exact.min() < kth - slack:
                break
            found = np.flatnonzero(points @ qvecs[q] >= kth - slack)
        if cand_ids:
            for i in top.tolist():
                yield qid, int(flat[i]), float(score[i]), q


class _Shards:
    """How rows are dealt to shards, and what shards can be ruled out."""

    def __init__(self, rows: DataFrame, total: int, shard_rows: int) -> None:
        self.spark = rows.sparkSession
        count = min(MOST_SHARDS, partitions_for(self.spark, total, shard_rows))
        share = SAMPLE_ROWS / max(total, SAMPLE_ROWS)
        picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("vec").limit(2 * SAMPLE_ROWS).toArrow()
        sample = np.unique(unit(matrix(picked["vec"])), axis=0) if picked.num_rows else np.zeros((1, 1))
        self.pivots = sample[np.random.default_rng(5).permutation(len(sample))[:count]]
        pivots = self.pivots

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = unit(matrix(b.column(1))) @ pivots.T
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.argmax(1).astype(np.int32)), pa.array(near.max(1)), pa.array(_lengths(matrix(b.column(1))))], ["id", "vec", "asks", "shard", "near", "length"])

        self.dealt = staged(rows.mapInArrow(deal, "id long, vec array<double>, asks boolean, shard int, near double, length double"), "dealt")
        got = self.dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("length").alias("length")).toArrow()  # a row for each shard
        at = got["shard"].to_numpy()
        self.rows, self.radius, self.length = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
        self.rows[at], self.radius[at], self.length[at] = got["n"].to_numpy(), np.sqrt(np.maximum(2 - 2 * got["near"].to_numpy(), 0)) + 1e-9, got["length"].to_numpy()
        self.parts = np.maximum(1, -(-self.rows // shard_rows))

    def route(self, asks: DataFrame) -> DataFrame:
        """``asks`` (id, tag, factor, floor, vec, shard) once for each other shard that may hold rows of more than ``floor``."""
        pivots, radius, length, some = self.pivots, self.radius, self.length, self.rows > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column(4))
                worst = b.column(3).to_numpy(zero_copy_only=False) / _lengths(x)
                gap = np.maximum(0, np.sqrt(np.maximum(2 - 2 * (unit(x) @ pivots.T), 0)) - radius)
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = b.column(2).to_numpy()[:, None] * np.sqrt(np.maximum(2 - 2 * np.maximum(worst, 0)[:, None] / length, 0) + 1e-12)
                go = ((worst < 0)[:, None] | ((gap <= reach) & (worst[:, None] <= length * (1 + 1e-9)))) & some
                go[np.arange(len(x)), b.column(5).to_numpy()] = False
                q, s = np.nonzero(go)
                for at in range(0, len(q), 100_000):
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(q[at : at + 100_000])) for i in range(5)), pa.array(s[at : at + 100_000].astype(np.int32))], ["id", "tag", "factor", "floor", "vec", "shard"])

        return asks.select("id", "tag", "factor", "floor", "vec", "shard").mapInArrow(run, "id long, tag int, factor double, floor double, vec array<double>, shard int")

    def search(self, asks: DataFrame, k: int, block_rows: int) -> DataFrame:
        """(query_id, tag, vec_id, score): the best k of each shard for the queries sent to it."""
        counts = {r["shard"]: r["count"] for r in asks.groupBy("shard").count().collect()}  # a row for each shard
        size = lambda of: F.element_at(F.array(*(F.lit(int(v)) for v in of)), F.col("shard") + 1)
        blocks = np.array([max(1, -(-counts.get(i, 0) // block_rows)) for i in range(len(self.parts))])
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        data = self.dealt.where(F.col("shard").isin([int(i) for i in counts])) if len(counts) < len(self.parts) else self.dealt
        data = data.select("id", "vec", "shard", F.pmod(F.xxhash64("id"), size(self.parts)).cast("int").alias("part"), every(size(blocks)).alias("block"))
        sent = asks.select("id", "tag", "factor", "floor", "vec", "shard", F.pmod(F.xxhash64("id", F.lit(1)), size(blocks)).cast("int").alias("block"), every(size(self.parts)).alias("part"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                tag = right["tag"].to_numpy()
                own = _shard_search(left["id"].to_numpy(), matrix(left["vec"]), right["id"].to_numpy(), matrix(right["vec"]), k, right["factor"].to_numpy(), right["floor"].to_numpy())
                found = [(q, int(tag[i]), v, s) for q, v, s, i in own]
            return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "tag": pa.array([f[1] for f in found], pa.int32()), "vec_id": pa.array([f[2] for f in found], pa.int64()), "score": pa.array([f[3] for f in found], pa.float64())})

        return data.groupBy("shard", "part", "block").cogroup(sent.groupBy("shard", "part", "block")).applyInArrow(run, "query_id long, tag int, vec_id long, score double")

    def best(self, asks: DataFrame, k: int, block_rows: int) -> DataFrame:
        """(query_id, tag, rank, vec_id, score) of queries (id, tag, factor, vec, shard): own shards first, then others within reach."""
        top = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
        pick = lambda found: found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        lowest = F.lit(float("-inf"))
        first = staged(pick(self.search(asks.withColumn("floor", lowest), k, block_rows)), "found")
        floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "tag", F.col("score").alias("floor"))
        rest = staged(self.route(asks.join(floors, ["id", "tag"], "left").withColumn("floor", F.coalesce("floor", lowest))), "asks")
        second = self.search(rest, k, block_rows)
        return pick(first.drop("rank").unionByName(second))


def _exact(rows: DataFrame, asks: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of a few queries by brute force over all rows."""
    qids, q = np.array([a[0] for a in asks]), np.array([a[1] for a in asks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            score = x @ q.T
            score[ids[:, None] == qids] = -np.inf
            at = np.argpartition(-score, min(k, len(ids)) - 1, axis=0)[:k]
            cols = np.broadcast_to(np.arange(len(qids)), at.shape)
            got = score[at, cols]
            fine = got > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(qids[cols[fine]]), pa.array(ids[at[fine]]), pa.array(got[fine])], ["query_id", "vec_id", "score"])

    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.select("id", "vec").mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def measured_factor(shards: _Shards, k: int, recall: float, block_rows: int, factors: tuple[float, ...] = FACTORS) -> tuple[float, dict[float, float]]:
    """The least factor whose recall on a sample of queries reaches ``recall``, and each one's recall: by score, as ties may fall either way."""
    asks = shards.dealt.where("asks").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES)
    asks = staged(asks.select("id", "vec", "shard").dropDuplicates(["id"]), "sample")
    wanted = [(r["id"], r["vec"]) for r in asks.select("id", "vec").collect()]  # SAMPLE_QUERIES rows
    if not wanted:
        return factors[0], {}
    truth = {}
    for r in _exact(shards.dealt, wanted, k).collect():
        truth.setdefault(r["query_id"], []).append(r["score"])
    each = asks.withColumn("f", F.explode(F.array(*(F.struct(F.lit(i).alias("tag"), F.lit(f).alias("factor")) for i, f in enumerate(factors)))))
    found: dict[tuple[int, int], list[float]] = {}
    for r in shards.best(each.select("id", "f.tag", "f.factor", "vec", "shard"), k, block_rows).collect():
        found.setdefault((r["query_id"], r["tag"]), []).append(r["score"])
    got = {}
    for tag, f in enumerate(factors):
        hits = sum(sum(s >= min(t) - 1e-9 * abs(min(t)) for s in found.get((q, tag), [])) for q, t in truth.items())
        got[f] = min(1.0, hits / max(1, sum(map(len, truth.values()))))
    return next((f for f in factors if got[f] >= recall), factors[-1]), got


def nearest(
    df: DataFrame, is_query: Column, k: int = 20, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, recall: float = RECALL
) -> DataFrame:
    """The k rows of largest inner product for each query row: query_id, rank, vec_id, score.

    Without ``factor`` the least one of FACTORS with ``recall`` on a sample of
    the queries is taken.  Candidates are all rows but those of the query's own
    id; ties go to smaller ids; fewer candidates give fewer rows.  Rows whose
    vector is null, empty, zero or holds null or non-finite components take no
    part, nor do null ids.  A repeated id counts as a row each time; as a query
    it asks once, with its first vector by order.  An empty table gives no rows;
    vectors of different lengths are an error; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    vec = F.col(vec_col)
    rows = df.where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dimension(rows, "vec")
    total = rows.count()
    shards = _Shards(rows, total, shard_rows)
    if factor is None:
        factor = measured_factor(shards, k, recall, block_rows)[0] if total else FACTOR
    asks = shards.dealt.where("asks")
    asks = asks.groupBy("id").agg(F.min(F.struct("vec", "shard")).alias("q")).select("id", F.lit(0).alias("tag"), F.lit(float(factor)).alias("factor"), "q.vec", "q.shard")
    return shards.best(staged(asks, "asks"), k, block_rows).select("query_id", "rank", "vec_id", "score")
