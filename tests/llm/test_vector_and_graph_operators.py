"""Vector operators, sharding, components and the pipeline against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import ann, sharding, simhash, vector_dedup
from pagemill.llm.graph import connected_components, merge


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100] + rng.normal(size=(60, 16)) * 0.1
    x[200:220] = x[200]
    return x.astype(np.float32)


def table(spark, x, extra=()):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10_000 + i, v, 0) for i, v in enumerate(extra)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


BAD = (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15)


def test_nearest(spark, vectors):
    x = vectors.astype(float)
    df = table(spark, vectors, BAD)
    for factor, least in ((1.0, 1.0), (ann.FACTOR, 0.9)):
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, factor, shard_rows=200, block_rows=10).collect()
        hits = 0
        for q in range(0, 600, 20):
            score = (x * x[q]).sum(1)
            order = [i for i in np.lexsort((np.arange(600), -score)).tolist() if i != q][:20]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert [m[0] for m in mine] == list(range(1, 21))
            assert all(s == pytest.approx(score[v], rel=1e-12) for _, v, s in mine)
            hits += len({m[1] for m in mine} & set(order))
            if factor == 1.0:
                assert [m[1] for m in mine] == order
        assert hits / 600 >= least
    assert ann.nearest(table(spark, vectors[:3]), F.col("vec_id") == 0, 20).count() == 2
    assert ann.nearest(table(spark, vectors[:3]), F.col("vec_id") == 77, 20).count() == 0
    assert ann.nearest(table(spark, vectors[:0], BAD), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("kind", ["equal", "lognormal", "some long", "one long", "one short", "clusters", "clusters, lognormal"])
def test_nearest_recall_with_unequal_lengths(kind):
    rng = np.random.default_rng(13)
    n, dims, k = 16 * ann.LEAF, 64, 20
    x = rng.normal(size=(n, dims))
    if kind.startswith("clusters"):
        x = rng.normal(size=(64, dims))[rng.integers(0, 64, n)] + 0.7 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind.endswith("lognormal"):
        x *= rng.lognormal(0, 0.5, n)[:, None]
    elif kind == "some long":
        x[rng.random(n) < 0.01] *= 3
    elif kind == "one long":
        x[17] *= 3
    elif kind == "one short":
        x[17] *= 1e-3
    qids = np.arange(0, n, 40)
    for factor, least in ((1.0, 1.0), (ann.FACTOR, 0.98)):
        got = {}
        for q, v, s, _ in ann._shard_search(np.arange(n), x, qids, 5 * x[qids], k, factor):
            got.setdefault(q, set()).add(v)
            assert s == pytest.approx(5 * (x[v] @ x[q]), rel=1e-9, abs=1e-12)
        hits = 0
        for q in qids.tolist():
            score = x @ x[q]
            score[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-score)[:k].tolist()))
        print(kind, factor, hits / (k * len(qids)))
        assert hits / (k * len(qids)) >= least


def test_ties_between_distinct_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (3000, 12)).astype(float)
    x[x.sum(1) == 0, 0] = 1
    x = np.concatenate([x, x[:, ::-1] * 2])  # distinct vectors with equal products, in trees of several levels
    got = {}
    for q, v, s, _ in ann._shard_search(np.arange(len(x)), x, np.arange(0, len(x), 150), x[::150], 20, 1.0):
        got.setdefault(q, []).append((v, s))
    for q in range(0, len(x), 150):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -score)).tolist() if i != q][:20]
        assert got[q] == [(i, score[i]) for i in order]
    real = rng.normal(size=(2000, 6)) * np.repeat(rng.permutation(200), 10)[:, None]
    df = table(spark, np.concatenate([x[:400], real[:, :1] @ np.ones((1, 12))]))
    whole = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, 1.0, shard_rows=300, block_rows=7).collect()
    y = np.concatenate([x[:400], real[:, :1] @ np.ones((1, 12))]).astype(np.float32).astype(float)
    usable = np.abs(y).max(1) > 0
    for q in range(0, 2400, 400):
        score = np.where(usable, (y * y[q]).sum(1), -np.inf)
        order = [i for i in np.lexsort((np.arange(len(y)), -score)).tolist() if i != q][:20]
        assert [r["vec_id"] for r in sorted(whole, key=lambda r: r["rank"]) if r["query_id"] == q] == order


def test_recall_is_measured_and_factor_raised(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    df = table(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("vec_id") % 20 == 0).alias("asks"))
    shards = ann._Shards(df, 3000, 700)
    factor, got = ann.measured_factor(shards, 20, 0.995, 1000)
    assert got[1.0] == 1.0 and got[factor] >= 0.995 and all(got[f] < 0.995 for f in ann.FACTORS if f < factor) and got[0.2] < 0.995


def test_repeated_and_null_ids(spark, vectors):
    rows = [(1, vectors[0].tolist()), (1, vectors[1].tolist()), (2, vectors[0].tolist()), (None, vectors[0].tolist()), (20, vectors[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])][:2] == [(20, 1, 1), (20, 2, 2)] and len(got) == 3
    links = vector_dedup.near_duplicates(df).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in links) == [(-1, 0), (1, 0), (1, 2), (2, 2), (20, 2)]


def test_links_of_huge_vectors_and_far_blocks(spark):
    x = np.eye(8)[np.arange(64) % 8] * 1e200 + 1e198
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_dedup.near_duplicates(df, block_rows=2).collect()
    assert all(r["n_links"] == 7 and r["component_id"] == r["vec_id"] % 8 for r in got)


def test_far_blocks_do_not_meet():
    rng = np.random.default_rng(9)
    shape = rng.normal(size=(3, 32))
    share = {}
    for n in (4000, 16_000):
        x = rng.normal(size=(n, 3)) @ shape
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = x @ np.linalg.eigh(x.T @ x)[1][:, ::-1]
        depth = (n // 125).bit_length() - 1
        cell = vector_dedup._cells(y[:, :8], vector_dedup._medians(y[:, :8], depth), depth)
        boxes = [(y[cell == c][:, :16].min(0), y[cell == c][:, :16].max(0)) for c in np.unique(cell)]
        near = sum((np.maximum(0, np.maximum(b[0] - a[1], a[0] - b[1])) ** 2).sum() <= 0.2 for a in boxes for b in boxes)
        share[n] = near / len(boxes) ** 2
    assert share[16_000] < 0.75 * share[4000] < 0.75


def test_vector_links(spark, vectors):
    x = vectors.astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(table(spark, vectors, BAD), block_rows=150).collect()}
    label = np.arange(600)
    while True:
        low = np.array([label[linked[i]].min() for i in range(600)])
        if (low == label).all():
            break
        label = low
    for i in range(600):
        assert got[i]["n_links"] == linked[i].sum() - 1 and got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i)
    assert all(got[10_000 + i]["n_links"] == 0 and got[10_000 + i]["kept"] for i in range(len(BAD)))
    assert vector_dedup.near_duplicates(table(spark, vectors[:0])).count() == 0


def chains(n, length, dims=16, cosine=0.92):
    """Unit vectors in chains: each has ``cosine`` with the one before; in random order."""
    rng = np.random.default_rng(11)
    x = np.empty((n, dims))
    for i in range(n):
        v = rng.normal(size=dims)
        if i % length:
            p = x[i - 1]
            v -= (v @ p) * p
            x[i] = cosine * p + np.sqrt(1 - cosine**2) * v / np.linalg.norm(v)
        else:
            x[i] = v / np.linalg.norm(v)
    return x[rng.permutation(n)].astype(np.float32)


def smallest(n, pairs):
    """The smallest index of each one's part, by union-find."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_vector_chains_across_tiles(spark):
    x = chains(5000, 40, 24)
    assert len(x) > 4 * vector_dedup.TILE_ROWS  # one block, several tiles a side
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    pairs = [(s + int(i), int(j)) for s in range(0, 5000, 1000) for i, j in zip(*np.nonzero(u[s : s + 1000] @ u.T >= 0.9), strict=True)]
    want = smallest(5000, pairs)
    for block_rows in (8192, 2500):
        got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(table(spark, x), block_rows=block_rows).collect()}
        assert [got[i]["component_id"] for i in range(5000)] == want
        assert all(got[i]["kept"] == (want[i] == i) for i in range(5000))


def test_merge_keeps_earlier_links():
    label = np.arange(8)
    for i, j in ((5, 3), (3, 2), (5, 1), (7, 6), (6, 2)):
        label = merge(label, np.array([i]), np.array([j]))
    assert label.tolist() == [0, 1, 1, 1, 4, 1, 1, 1]


def test_simhash_forest_over_several_row_blocks():
    rng = np.random.default_rng(12)
    fp = np.empty(5000, np.uint64)
    for i in range(5000):  # chains of 25 that differ in three bits from link to link
        fp[i] = rng.integers(0, 2**63, dtype=np.uint64) if i % 25 == 0 else fp[i - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fp = np.unique(fp)[rng.permutation(len(np.unique(fp)))].view(np.int64)
    pairs = [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count((fp[i] ^ fp).view("<u8")) <= 3)]
    out = []
    simhash._forest(fp, out)
    at = {int(f): i for i, f in enumerate(fp)}
    edges = [(at[int(a)], at[int(b)]) for a, b in zip(*out[0], strict=True)]
    assert smallest(len(fp), edges) == smallest(len(fp), pairs)


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if n in got} and set(got) == {n for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, docs):
    rows = [(i, f"text {i % 50 if i % 3 == 0 else i}") for i in range(203)] + [(300, None), (301, None), (None, "x"), (5, "text 5")]
    got = sharding.shard_documents(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    groups = {}
    text = dict(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] % 3 == 0 and r["doc_id"] < 203:
            groups.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert np.mean([len(g) == 1 for g in groups.values()]) > 0.9
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in got if r["doc_id"] in (300, 301))
    assert sharding.shard_documents(docs([])).count() == 0


def test_linked_documents_move_by_swaps(spark, docs):
    """All documents are linked, so no shard has room: only swaps bring linked ones together."""
    rng = np.random.default_rng(2)
    rows = [(i, f"text {i}") for i in range(800)]
    order = rng.permutation(800).tolist()
    pairs = [(order[4 * i + a], order[4 * i + b]) for i in range(200) for a in range(4) for b in range(a + 1, 4)]
    links = spark.createDataFrame(pairs, "a long, b long")
    cut = []
    for rounds in (0, 10):
        got = sharding.shard_documents(docs(rows), links, rounds=rounds)
        at = {r["doc_id"]: r["shard"] for r in got.collect()}
        sizes = np.bincount(list(at.values()), minlength=8)
        assert sizes.max() - sizes.min() <= 1
        told = sharding.cut_links(got, links).first()
        assert (told["links"], told["cut"]) == (len(pairs), sum(at[a] != at[b] for a, b in pairs))
        cut.append(told["cut"] / len(pairs))
    assert cut[0] > 0.8 and cut[1] < 0.35


def test_grants_keep_sizes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = 4
        asked = {s * n + t: int(rng.integers(0, 30)) for s in range(n) for t in range(n) if s != t}
        room = rng.integers(-3, 20, n).tolist()
        got = sharding._grants(asked, room)
        assert all(0 <= g <= asked.get(w, 0) for w, g in enumerate(got))
        for s in range(n):
            assert sum(got[t * n + s] for t in range(n)) - sum(got[s * n + t] for t in range(n)) <= max(0, room[s])


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p
    from pagemill.llm import line_dedup, mixing, simhash, toxicity
    from pagemill.llm._common import read_table, staged

    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    kept = staged(p.drop_toxic(spark, docs, sf_dir), "t")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.5}
    lines = staged(p.drop_repeated_lines(spark, kept, sf_dir), "t")
    assert lines.columns == docs.columns and lines.count() == kept.count()
    gone = {r["doc_id"]: set(r["removed_lines"]) for r in line_dedup.summary(kept).collect()}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in lines.collect():
        assert r["text"] == "\n".join(x for i, x in enumerate(texts[r["doc_id"]].split("\n")) if i not in gone[r["doc_id"]])
    single = staged(p.drop_near_duplicates(spark, lines, sf_dir), "t")
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in simhash.near_duplicates(lines).where("kept").collect()}
    mixed = staged(p.mix_sources(spark, single, sf_dir), "t")
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mix(single).where("kept").collect()}
    assert p.encode(spark, mixed, sf_dir).count() == mixed.count()


def test_pipeline_odd_rows(spark, sf_dir):
    import corpus_pipeline as p
    from pagemill.llm._common import staged

    rows = [(None, "null id text with some words"), (1, None), (2, ""), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "quite other words of the same id number"), (6, "a b c d e f g h"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    lines = staged(p.drop_repeated_lines(spark, docs, sf_dir), "t")
    assert lines.columns == docs.columns and lines.count() == len(rows)
    single = p.drop_near_duplicates(spark, docs, sf_dir)
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in single.collect())
    assert got == [(-1, "null id text with some words"), (1, ""), (5, "a b c d e f g h"), (5, "quite other words of the same id number")]
    mixed = p.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() <= len(rows)
    empty = docs.where("false")
    for stage in (p.drop_repeated_lines, p.drop_near_duplicates, p.mix_sources, p.encode):
        assert stage(spark, empty, sf_dir).count() == 0
