"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned to their principal components, so
leading dimensions hold most of each product.  Rows are ordered by nested
medians of the leading components and cut into blocks of bounded size.  Two
blocks meet in one task, unless the boxes of their leading components and
suffix norms lie too far apart: then neither's rows are sent to the other.
Blocks meet tile by tile.  A tile pair is skipped by its boxes likewise; else
the products of the leading dimensions are accumulated, and the rest is bounded
by the product of the suffix norms.  Only pairs whose bound reaches the
threshold are computed in full, in double precision.

Equal vectors are one point with a weight.  A task returns weighted link
counts and, for connectivity, one edge for each linked point, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import ship, staged
from pagemill.llm.graph import connected_components, merge
from pagemill.llm.vectors import dimension, matrix, unit, usable

#: Rows of a block; a task holds two.
BLOCK_ROWS = 8192
TILE_ROWS = 1024
#: Leading dimensions that are accumulated before the bound is tested.
LEAD = 16
#: Rows from which the order's medians are read; only the order depends on them.
SAMPLE_ROWS = 16_384
MOST_CELLS = 4096
#: Pairs of blocks that may be broadcast.
MOST_PAIRS = 500_000


def _principal(points: DataFrame, dims: int) -> np.ndarray:
    """Rotation to principal components, largest variance first, from the second moments of all rows."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                x = unit(x)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    got = points.select("vec").mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    second = np.zeros(dims * dims)
    for r in got:
        second[r["i"]] = r["v"]
    second = second.reshape(dims, dims)
    return np.linalg.eigh((second + second.T) / 2)[1][:, ::-1].copy()


def _medians(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A balanced tree of cuts in heap order, each of the component that spreads most there: (component, value)."""
    cuts: list[tuple[int, float]] = []
    level = [sample]
    for d in range(depth):
        nxt = []
        for rows in level:
            axis = int(rows.var(0).argmax()) if len(rows) > 1 else d % sample.shape[1]
            at = float(np.median(rows[:, axis])) if len(rows) else 0.0
            cuts.append((axis, at))
            nxt += [rows[rows[:, axis] < at], rows[rows[:, axis] >= at]]
        level = nxt
    return cuts


def _cells(x: np.ndarray, cuts: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    axes, values = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts])
    for _ in range(depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), axes[node]] >= values[node])
    return node - (2**depth - 1)


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float, lead: int = LEAD, tile: int = TILE_ROWS):
    """Index pairs (i, j) with product >= threshold between rows of ``a`` and ``b`` (None: within a, i < j), in runs.

    Rows are unit vectors in principal components, in order.
    """
    same = b is None
    b = a if same else b
    lead = min(lead, a.shape[1])
    far = 2 - 2 * threshold + 1e-6

    def bounded(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[:, :lead], np.sqrt(np.maximum((x[:, lead:] ** 2).sum(1), 0))[:, None]], axis=1).astype(np.float32)

    def boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [x[i : i + tile, :lead] for i in range(0, len(x), tile)]
        return np.array([p.min(0) for p in parts]), np.array([p.max(0) for p in parts])

    fa, fb = bounded(a), bounded(b)
    (alo, ahi), (blo, bhi) = boxes(a), boxes(b)
    for ta in range(len(alo)):
        gap = np.maximum(0, np.maximum(blo - ahi[ta], alo[ta] - bhi))
        for tb in np.flatnonzero((gap**2).sum(1) <= far).tolist():
            if same and tb < ta:
                continue
            i0, j0 = ta * tile, tb * tile
            bound = fa[i0 : i0 + tile] @ fb[j0 : j0 + tile].T
            i, j = np.nonzero(bound >= threshold - 1e-4)
            if same and ta == tb:
                keep = i < j
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            if len(i) > bound.size // 20:
                full = a[i0 : i0 + tile] @ b[j0 : j0 + tile].T
                score = full[i, j]
            else:
                score = np.concatenate([np.einsum("ij,ij->i", a[i0 + i[s : s + 65_536]], b[j0 + j[s : s + 65_536]]) for s in range(0, len(i), 65_536)])
            hit = score >= threshold - 1e-9
            if hit.any():
                yield i0 + i[hit], j0 + j[hit], score[hit]


def _near_blocks(rows: DataFrame, turn: np.ndarray, blocks: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of blocks (lower, higher), each with itself, whose boxes are near enough to hold a link."""
    lead = min(LEAD, len(turn))
    # Distances between leading parts and between suffix norms together bound those between unit vectors.
    names = [f"b{i}" for i in range(lead + 1)]

    def bounds(batches):
        lo, hi = np.full((blocks, lead + 1), np.inf), np.full((blocks, lead + 1), -np.inf)
        for batch in batches:
            x = unit(matrix(batch.column(0))) @ turn if batch.num_rows else np.empty((0, len(turn)))
            x = np.concatenate([x[:, :lead], np.sqrt(np.maximum((x[:, lead:] ** 2).sum(1), 0))[:, None]], axis=1)
            own = batch.column(1).to_numpy()
            np.minimum.at(lo, own, x)
            np.maximum.at(hi, own, x)
        got = np.flatnonzero(lo[:, 0] < np.inf).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(got), *(pa.array(lo[got, i]) for i in range(lead + 1)), *(pa.array(hi[got, i]) for i in range(lead + 1))], ["own", *names, *(f"t{n}" for n in names)])

    schema = "own int, " + ", ".join(f"{n} double" for n in [*names, *(f"t{n}" for n in names)])
    got = rows.select("vec", "own").mapInArrow(bounds, schema).groupBy("own").agg(*(F.min(n).alias(n) for n in names), *(F.max(f"t{n}").alias(f"t{n}") for n in names)).toArrow()  # a row for each block
    own = got["own"].to_numpy()
    lo, hi = (np.stack([got[f"{p}{n}"].to_numpy() for n in names], axis=1) for p in ("", "t"))
    far = 2 - 2 * threshold + 1e-6
    a, b = [], []
    for i in range(len(own)):
        gap = np.maximum(0, np.maximum(lo - hi[i], lo[i] - hi))
        near = np.flatnonzero((gap**2).sum(1) <= far)
        near = near[own[near] >= own[i]]
        a.append(np.full(len(near), own[i]))
        b.append(own[near])
    return np.concatenate(a), np.concatenate(b)


def near_duplicates(
    df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: n_links 0 and their own id as component.  A repeated id
    counts as a row each time and gives equal rows.  A null id has no component
    of its own; rows with null ids are returned unlinked.  An empty table gives
    no rows, vectors of different lengths are an error, other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    vec = F.col(vec_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull() & usable(vec), vec.cast("array<double>")).alias("vec"))
    points = staged(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "points")
    dims = dimension(points, "vec")
    count = points.count()
    if not count:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    turn = _principal(points, dims)
    depth = max(0, min(MOST_CELLS, count // 512).bit_length() - 1)
    share = SAMPLE_ROWS / max(count, SAMPLE_ROWS)
    picked = points.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < int(share * 1_000_003)).select("vec").limit(2 * SAMPLE_ROWS).toArrow()
    sample = matrix(picked["vec"])
    sample = unit(sample) @ turn[:, : min(8, dims)] if len(sample) else np.zeros((1, min(8, dims)))
    cuts = _medians(sample, depth)

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(2))
            if len(x):
                cell = _cells(unit(x) @ turn[:, : min(8, dims)], cuts, depth)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32))], ["rep", "n", "vec", "cell"])

    placed = points.select("rep", "n", "vec").mapInArrow(place, "rep long, n long, vec array<double>, cell int")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # MOST_CELLS rows at most
    first, parts, blocks, room = [0] * (1 << depth), [1] * (1 << depth), 0, 0
    for cell in range(1 << depth):
        n = sizes.get(cell, 0)
        if n > block_rows:  # a crowded cell gets blocks of its own
            blocks += bool(room)
            first[cell], parts[cell] = blocks, -(-n // block_rows)
            blocks, room = blocks + parts[cell], 0
            continue
        if room + n > block_rows:
            blocks, room = blocks + 1, 0
        first[cell] = blocks
        room += n
    blocks += bool(room)
    at = F.element_at(F.array(*map(F.lit, first)), F.col("cell") + 1) + F.pmod(F.xxhash64("rep"), F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)).cast("int")
    blocked = staged(placed.select("rep", "n", "vec", "cell", at.alias("own")), "blocks")
    near = _near_blocks(blocked, turn, blocks, threshold)
    pairs = spark.createDataFrame(pa.table({"own": pa.array(np.concatenate([near[0], near[1]]).astype(np.int32)), "other": pa.array(np.concatenate([near[1], near[0]]).astype(np.int32))}).to_pandas()).distinct()
    dealt = blocked.join(F.broadcast(pairs) if len(near[0]) <= MOST_PAIRS else pairs, "own")
    dealt = dealt.select("rep", "n", "vec", "cell", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        rep, weight, own, cell = (t[c].to_numpy() for c in ("rep", "n", "own", "cell"))
        raw = matrix(t["vec"])
        scaled = raw * 2.0 ** -np.floor(np.log2(np.abs(raw).max(1)))[:, None]  # by powers of two: exact, and squares stay in range
        turned = unit(raw) @ turn
        sides = []
        for block in (lo, hi) if lo != hi else (lo,):
            rows_of = np.flatnonzero(own == block)
            sides.append(rows_of[np.lexsort((turned[rows_of, 0], cell[rows_of]))])
        left, right = sides[0], sides[-1]
        links = np.zeros(len(rep), np.int64)
        label = np.arange(len(rep))
        for i, j, score in tile_links(turned[left], None if lo == hi else turned[right], threshold):
            i, j = left[i], right[j]
            close = np.abs(score - threshold) < 1e-8
            if close.any():  # so near the threshold the original vectors decide
                x, y = scaled[i[close]], scaled[j[close]]
                keep = np.ones(len(i), bool)
                keep[close] = (x * y).sum(1) / (np.sqrt((x**2).sum(1)) * np.sqrt((y**2).sum(1))) >= threshold
                i, j = i[keep], j[keep]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = merge(label, i, j)
        got = np.flatnonzero(links)
        return pa.table({"rep": rep[got], "links": links[got], "root": rep[label[got]]})

    found = staged(dealt.groupBy("lo", "hi").applyInArrow(compare, "rep long, links long, root long"), "links")
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = points.join(counts, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(known, "vec", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
