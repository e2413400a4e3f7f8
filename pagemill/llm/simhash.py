"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most three bits are linked.  Half of that
radius is one and a half bits: every distinct fingerprint emits all variants
with at most one bit flipped, and for the odd half bit one of three blocks of
bits is left out.  For two fingerprints at distance three at least one
differing bit lies in some block; with that block left out at most two remain,
and flipping one on each side makes the variants meet.  Variants are shuffled,
and pairs that meet are verified on the whole fingerprints.

Equal fingerprints are one node from the start, so groups of copies cost one
node however large.  Within a bucket only a spanning forest of the verified
links leaves the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import ascii_words, ship, staged
from pagemill.llm.bpe import slices
from pagemill.llm.graph import connected_components, merge

RADIUS = 3
#: Bits of the three blocks, low to high.
BLOCKS = ((0, 21), (21, 42), (42, 64))
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 without words."""
    import xxhash

    words = ascii_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words)
    if n <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - width] + 1).tolist()]
    total = np.zeros(64, np.int64)
    shingles = n - width + 1
    stops = ends[width - 1 :].tolist()
    for at in range(0, shingles, 65_536):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, text_key, fp) of every whole text: a 64-bit hash, and the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                got = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got)], ["id", "text_key", "fp"])

    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return src.mapInArrow(run, "id long, text_key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flipped(kept: Column, flips: Column) -> Column:
    return F.transform(flips, lambda x: kept.bitwiseXOR(x))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint with one block cleared and at most one other bit flipped; the block is part of the key."""
    fp = F.col("fp")
    parts = []
    for block, (lo, hi) in enumerate(BLOCKS):
        mask = _signed(((1 << 64) - 1) ^ ((1 << hi) - (1 << lo)))
        # The cleared block has room for the block's own number.
        kept = fp.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(_signed((block + 1) << lo)))
        flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in range(64) if not lo <= b < hi))
        parts.append(_flipped(kept, flips))
    return fps.select(fp, F.explode(F.concat(*parts)).alias("key"))


def _forest(fp: np.ndarray, out: list[np.ndarray]) -> None:
    """Connect what is linked within one bucket: an edge from each row to the first row of its part; a block of rows at a time."""
    n = len(fp)
    label = np.arange(n)
    step = max(1, 4_000_000 // n)
    # Rows that link to the first row need no comparisons among themselves.
    near = np.bitwise_count((fp ^ fp[0]).view("<u8")) <= RADIUS
    label[near] = 0
    rest = np.flatnonzero(~near)
    for at in range(0, len(rest), step):
        rows = rest[at : at + step]
        hit = np.bitwise_count((fp[rows][:, None] ^ fp[None, :]).view("<u8")) <= RADIUS
        r, c = np.nonzero(hit)
        label = merge(label, rows[r], c)
    got = np.flatnonzero(label != np.arange(n))
    if len(got):
        out.append(np.stack([fp[label[got]], fp[got]]))


def _bucket_edges(key: np.ndarray, fp: np.ndarray, out: list[np.ndarray]) -> None:
    """Links within runs of equal keys; short runs all at once."""
    cut = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    for n in np.unique(sizes[(sizes > 1) & (sizes <= 12)]).tolist():
        rows = fp[starts[sizes == n][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(i + 1, n):
                hit = np.bitwise_count((rows[:, i] ^ rows[:, j]).view("<u8")) <= RADIUS
                if hit.any():
                    out.append(np.stack([rows[hit, i], rows[hit, j]]))
    for i in np.flatnonzero(sizes > 12).tolist():
        _forest(fp[starts[i] : starts[i] + sizes[i]], out)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): fingerprints linked directly, enough of them to connect whatever is connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def flush(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            out: list[np.ndarray] = []
            if len(key):
                _bucket_edges(key, fp, out)
            if out:
                got = np.concatenate(out, axis=1)
                got.sort(axis=0)
                got = np.unique(got, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy()])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from flush(key[:last], fp[:last])
            held_key, held_fp = key[last:], fp[last:]
        yield from flush(held_key, held_fp)

    # A set number of partitions: adaptive execution would put small ones together and leave cores idle.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = variants(fps).select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable), kept, text_key (a hash of the text).

    Texts without words, empty and null ones included, have fingerprint zero and
    are linked like any other.  Fingerprints are linked, not ids: a row without
    an id links others and has their smallest id, null if none has one; rows of
    one id with different texts may be in different components.  ``kept`` marks
    the row of the smallest (id, text_key) of a component, a null id being the
    largest, and each row that repeats it.  Other columns are ignored; an empty
    table gives no rows.
    """
    marked = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "text_key"))
    nodes = staged(marked.groupBy("fp").agg(first.alias("first")), "nodes")
    comps = connected_components(links(nodes.select("fp")))
    known = nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("part"), "first")
    known = staged(known, "parts")
    labels = known.select("fp", "part").join(known.groupBy("part").agg(F.min("first").alias("first")), "part").select("fp", F.col("first.id").alias("component_id"), F.col("first.text_key").alias("first_key"))
    return marked.join(labels, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))).alias("kept"),
        "text_key",
    )
