"""Text operators against brute force, and their defined results in odd cases."""

import collections
import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from pagemill.llm import bpe, line_dedup, lm, mixing, simhash, token_counts, toxicity
from pagemill.llm.queries import vocabulary

LONG = "word " * 30_000
ODD = [(None, "null id text here now"), (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "a b c"), (5, "a b c"), (6, "a b c")]


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -- simhash


def components(ids, linked):
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {0}
    for b in base.tolist():
        fps.add(b)
        for _ in range(25):
            x = b
            for bit in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [simhash._signed(x) for x in fps]
    edges = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    true = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert components(signed, edges) == components(signed, true)


def test_simhash_fingerprint_by_hand():
    import xxhash

    text = "The quick\tbrown fox\njumps over The quick brown"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two Words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


def test_simhash_odd_rows(docs):
    got = simhash.near_duplicates(docs(ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[2]["fingerprint"] == "0" * 16
    assert by[6]["component_id"] == 5 and not by[6]["kept"]
    assert simhash.near_duplicates(docs([])).count() == 0


def test_simhash_against_brute_force(docs):
    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = rng.choice(words, 120).tolist()
        for c in range(6):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(120))] = str(rng.choice(words))
            rows.append((100 * g + c, " ".join(own)))
    rows += [(None, rows[0][1]), (7000, ""), (7001, None), (None, " "), (300, rows[0][1]), (300, "quite another text")]
    fps = [simhash.fingerprint(t) for _, t in rows]
    n = len(rows)
    label = components(list(range(n)), [(i, j) for i in range(n) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(least.get(label[i], d), d)
    want = sorted(((-1 if d is None else d), f"{fps[i]:016x}", least.get(label[i])) for i, (d, _) in enumerate(rows))
    got = simhash.near_duplicates(docs(rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = [(r["component_id"], r["doc_id"]) for r in got if r["kept"]]
    assert len(kept) == len(set(label.values())) and all(c == d for c, d in kept)


@pytest.mark.parametrize("run", [lambda d, s: toxicity.score_documents(d, s.createDataFrame([], "doc_id long, toxic int")), lambda d, s: lm.score_documents(d, ~lm.held_out(), lm.F.lit(False)), lambda d, s: bpe.encode_documents(d, open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read()), lambda d, s: token_counts.count_tokens(d, [("▁a", -1.0)]), lambda d, s: line_dedup.summary(d), lambda d, s: mixing.mix(d)])
def test_empty_tables(spark, docs, run):
    assert run(docs([]), spark).count() == 0


def test_clashing_columns(spark):
    names = ("kept", "rid", "word", "_gone", "own_id", "row", "gone", "text_key", "sig", "tok", "line", "ver")
    d = spark.createDataFrame([(i, t, "en", "s", *([7] * len(names))) for i, t in [(1, "a b c d e f\nx"), (2, "a b c d e f"), (3, "other words here")]], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(d).collect()}
    assert got[2]["text"] == "" and got[1]["removed_lines"] == [] and all(r[n] == 7 for r in got.values() for n in names)
    assert simhash.near_duplicates(d).count() == mixing.mix(d).count() == lm.score_documents(d, lm.F.lit(True), lm.F.lit(False)).count() == 3


# -- line dedup


def brute_lines(rows, t=0.8):
    lines = []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(line.lower().split(" ")) - {""}
            if words:
                lines.append((d, i, words))
    out = collections.defaultdict(list)
    for k, (d, i, w) in enumerate(lines):
        if any(len(w & v) >= t * len(w | v) - 1e-9 for _, _, v in lines[:k]):
            out[d].append(i)
    return out


def test_lines_against_brute_force(docs):
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(60)]
    rows, made = [], []
    for d in range(40):
        text = []
        for _ in range(rng.integers(1, 8)):
            if made and rng.random() < 0.5:
                words = list(made[rng.integers(len(made))])
                for _ in range(rng.integers(0, 3)):
                    words[rng.integers(len(words))] = pool[rng.integers(60)]
            else:
                words = [pool[i] for i in rng.integers(0, 60, rng.integers(3, 20))]
            made.append(words)
            text.append(" ".join(words))
        rows.append((d, "\n".join(text)))
    want = brute_lines(rows)
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.summary(docs(rows)).collect()}
    assert got == {d: want.get(d, []) for d, _ in rows}
    assert sum(map(len, want.values())) > 20


def test_short_lines_against_brute_force(docs):
    rng = np.random.default_rng(4)
    rows = [(d, "\n".join(" ".join(f"w{i}" for i in rng.integers(0, 7, rng.integers(0, 8))) for _ in range(6))) for d in range(12)]
    rows += [(20, "Share this page\nhome\n\nw0 w0 w0 w0 w0 w0"), (21, "share this page\nHome\n\nw0 w0 w0 w0 w0")]
    seen, want = [], {d: [] for d, _ in rows}
    for d, text in rows:
        for i, line in enumerate(text.split("\n")):
            words = frozenset(line.lower().split())
            if words and any(len(words & v) >= 0.8 * len(words | v) - 1e-9 for v in seen):
                want[d].append(i)
            seen.append(words)
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.summary(docs(rows)).collect()}
    assert got == want and want[21] == [0, 1, 3]


def test_hot_tokens_and_repeated_rows(docs):
    """A template on every line, near copies in great number, and rows that repeat id and text."""
    rng = np.random.default_rng(21)
    base = " ".join(f"b{i}" for i in range(30))
    rows = [(i, f"share this page with code c{i}\n" + base.replace(f"b{i % 30}", f"x{i}") + "\n" + " ".join(rng.choice([f"z{k}" for k in range(40)], 12))) for i in range(150)]
    rows += [(3, rows[3][1]), (3, "share this page with code c3"), (None, base)]
    lines = [((-1 if d is None else d), str(t), n, frozenset(x.split())) for d, t in dict.fromkeys(rows) for n, x in enumerate(t.split("\n"))]
    got = {}
    for r in line_dedup.summary(docs(rows)).collect():
        got.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(tuple(r["removed_lines"]))
    want = {}
    for d, t in rows:
        d = -1 if d is None else d
        if d == 3:
            continue  # two texts of one id: their order is by a hash
        gone = tuple(n for n, x in enumerate(t.split("\n")) if any((e, k) < (d, n) and len(s & frozenset(x.split())) >= 0.8 * len(s | frozenset(x.split())) - 1e-9 for e, _, k, s in lines))
        want.setdefault(d, []).append(gone)
    assert {d: g for d, g in got.items() if d != 3} == want and len(got[3]) == 3
    assert sum(1 in g[0] for d, g in got.items() if d >= 0) > 130


def test_marked_cells(spark):
    """Every marked hash is found, and few others by chance, in a table of a quarter byte a cell."""
    ids = spark.range(1000).select(line_dedup.F.xxhash64("id").alias("i"))
    table = line_dedup._marked(ids, size := line_dedup._cells(64 * 1000))
    assert len(table) == size // 4 and max(table) < 128
    found = spark.range(20_000).select("id", line_dedup._is_marked(table, line_dedup.F.xxhash64("id")).alias("m")).where("m").collect()
    assert {r["id"] for r in found} >= set(range(1000)) and len(found) < 1000 + 2 * 19_000 * 1000 / size


def test_plans_with_tables_are_kept_short(spark):
    """The driver keeps descriptions of a thousand plans, in which a table of a megabyte takes two."""
    from pagemill.session import staged

    table, key = bytes(range(128)) * 8192, "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    assert staged(spark.range(10).select((line_dedup._cell(table, line_dedup.F.col("id")) + line_dedup.F.col("id")).alias("x")), "short").count() == 10
    kept = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert max(len(kept.apply(i).physicalPlanDescription()) for i in range(max(0, kept.size() - 4), kept.size())) < 100_000
    assert spark.conf.get(key) == before


def test_cells_are_read_by_checksum(spark):
    table = line_dedup._BYTES * 4096
    got = spark.range(1024).select("id", line_dedup._level(table, line_dedup.F.col("id")).alias("n")).collect()
    assert all(r["n"] == r["id"] % 128 for r in got)
    counts = spark.createDataFrame([(i * 4099, i) for i in range(1, 128)], "i int, level int")
    packed = line_dedup._packed(counts, 1 << 20, line_dedup._BYTES)
    assert [packed[i * 4099] for i in range(128)] == list(line_dedup._BYTES) and packed.count(line_dedup._BYTES[0]) == (1 << 20) - 127


def test_events_of_staged_plans_hold_no_tables(spark):
    """Each node's description goes into the event log and stays with the driver; limits of a plan's text don't hold it."""
    from pagemill.session import staged

    table, key = bytes(range(128)) * 8192, "spark.sql.debug.maxToStringFields"
    store = spark._jsparkSession.sharedState().statusStore()
    known = lambda: {e.apply(i).executionId() for e in [store.executionsList()] for i in range(e.size())}
    before, old = spark.conf.get(key), known()
    col = line_dedup.F.col("id")
    df = spark.range(10).where(line_dedup._is_marked(table, col) | (col >= 0)).select((line_dedup._cell(table, col) + col).alias("x"))
    staged(df, "short")
    nodes = [n.apply(i) for e in known() - old for n in [store.planGraph(e).allNodes()] for i in range(n.size())]
    assert nodes and max(len(n.desc()) for n in nodes) < 10_000
    assert spark.conf.get(key) == before


def test_tokens_sort_by_level_and_stay_apart(spark):
    table = line_dedup._BYTES * 4096
    h = line_dedup.F.xxhash64("id")
    rows = spark.range(5000).select(h.alias("h"), line_dedup._level(table, h).alias("n"), line_dedup._token(table, h).alias("t")).collect()
    assert all(r["t"] >> 56 == r["n"] == (r["h"] & (len(table) - 1)) % 128 for r in rows)
    assert len({r["t"] for r in rows}) == len({(r["h"] & (1 << 64) - 1) >> 8 for r in rows})


def test_line_breaks_are_not_replaced(docs):
    """Cutting at them is cheaper; other white space still parts words, and is counted so."""
    d = docs([(0, "a b\nC\td\x0be\x0cf\rg"), (1, "a\n\nB"), (2, None), (3, "")])
    table = line_dedup.rarity_table(d)
    level = lambda n: line_dedup._BYTES[n]  # noqa: E731  round(2 log2(count + 1)): 3 for two, 2 for one
    cells = collections.Counter(b for b in table if b != level(0))
    assert cells[level(3)] == 3 and cells[level(2)] == 5  # the empty word is counted too
    words = {r["line"]: [w for w in r["words"] if w] for r in line_dedup.lines_of(d, line_dedup.F.lit(0).cast("long")).where("doc_id = 0").collect()}
    assert words == {0: ["a", "b"], 1: ["c", "d", "e", "f", "g"]}
    plan = line_dedup.summary(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(text" not in plan


def test_lines_are_cut_once_for_counting_and_ordering(docs, monkeypatch):
    """Both read staged hashes, which go before postings are dealt out; a word counts once for each line."""
    names, gone, cut = [], [], []
    stage, unstage, lines_of = line_dedup.staged, line_dedup.unstaged, line_dedup.lines_of
    monkeypatch.setattr(line_dedup, "staged", lambda df, name, *a, **b: (names.append(name), stage(df, name, *a, **b))[1])
    monkeypatch.setattr(line_dedup, "unstaged", lambda *t: (gone.append((len(names), len(t))), unstage(*t))[1])
    monkeypatch.setattr(line_dedup, "lines_of", lambda *a: (cut.append(1), lines_of(*a))[1])
    d = docs([(0, "a a A a  b\n\nc d e f g"), (1, "g f e d c"), (2, None)])
    assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.summary(d).collect()} == {0: [], 1: [0], 2: []}
    assert names[:3] == ["hashes", "lines", "classes"] and gone[0] == (2, 1) and len(cut) == 1
    cells = collections.Counter(line_dedup.rarity_table(d))
    assert cells[line_dedup._BYTES[2]] == 2 and cells[line_dedup._BYTES[3]] == 6  # a and b stand in one line; c to g and the empty word in two


def test_ordering_reads_words_only_and_sorts_numbers(docs, monkeypatch):
    """The empty string goes when hashes are staged, where that is compiled; tokens can't be null to Spark, and counting's settings don't stay."""
    plans, conf, stage = {}, {}, line_dedup.staged
    d = docs([(0, "a  b\n\nc d e f g"), (1, "g f e d c"), (2, None)])
    key = line_dedup._SPLIT
    before, packed = d.sparkSession.conf.get(key), line_dedup._packed
    monkeypatch.setattr(line_dedup, "staged", lambda df, name, *a, **b: (plans.setdefault(name, df), stage(df, name, *a, **b))[1])
    monkeypatch.setattr(line_dedup, "_packed", lambda cells, *a: (conf.setdefault("read", cells.sparkSession.conf.get(key)), packed(cells, *a))[1])
    d.sparkSession.conf.set(key, "16m")
    try:
        assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.summary(d).collect()} == {0: [], 1: [0], 2: []}
        assert conf["read"] == str(line_dedup.SPLIT_BYTES) and d.sparkSession.conf.get(key) == "16m"
    finally:
        d.sparkSession.conf.set(key, before)
    assert sorted(len(r["hashes"]) for r in plans["hashes"].collect()) == [0, 2, 5, 5]
    plan = plans["lines"]._jdf.queryExecution().analyzed().toString()
    assert "array_remove" not in plan and "coalesce" in plan


def test_hub_is_the_earliest_posting(spark):
    """Of a token's postings, those similar to its first by document and class meet that one only."""
    rows = [(9, 5), (4, -3), (4, 7), (-2, 8), (-2, -8), (6, 1)]
    classes = spark.createDataFrame([((doc, 0, 0), sig, 20, 0, 0, [17]) for doc, sig in rows], "at struct<doc_id: long, ver: long, line: int>, sig long, m int, s0 long, s1 long, prefix array<int>")
    got = sorted((r["late"], r["early"], r["short"]) for r in line_dedup.candidates(classes, 0.8).collect())
    short = [(sig, -8, True) for _, sig in sorted(rows, key=lambda x: x[1]) if sig != -8]
    assert [x for x in got if x[2]] == short and all(x == (-8, 8, False) for x in got if not x[2])
    assert "doc#" not in next(x for x in line_dedup.candidates(classes, 0.8)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x).rpartition("[tok#")[2]


def test_documents_without_needed_lines_are_not_cut(docs):
    from pagemill.session import staged

    d = docs([(i, f"a{i} b{i}\tC\n\x0bd {i}\re") for i in range(400)])
    ver = line_dedup.versions(d)
    lines = line_dedup.token_lines(line_dedup.lines_of(d, ver), line_dedup.rarity_table(d), 0.8)
    needed = staged(line_dedup.classes_of(lines.where("doc_id IN (7, 8)")).select("sig", "at"), "needed")
    rows = line_dedup._whole_sets(d, ver, needed)
    assert sorted((r["at"]["doc_id"], r["at"]["line"], len(r["toks"])) for r in rows.collect()) == [(7, 0, 3), (7, 1, 3), (8, 0, 3), (8, 1, 3)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "ascii" in plan[plan.index("Generate posexplode") :]


def test_staged_tables_have_no_checksum_files(spark):
    from pagemill.session import staged

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    for few in (False, True):
        path = Path(staged(spark.range(0, 1000, 1, 4), "plain", few=few)._pagemill_path.removeprefix("file://"))
        assert len(list(path.glob("*.parquet"))) == 4 and not list(path.rglob("*.crc"))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst") == before


def test_lines_odd_rows(docs):
    rows = [*ODD, (7, "one two three four five\nx\nFIVE four three two one"), (8, "one two three four five six")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got[7]["text"] == "one two three four five\nx" and got[8]["text"] == "" and got[1]["text"] is None and got[5]["text"] == "a b c"
    assert line_dedup.dedup_lines(docs([])).count() == 0


# -- BPE


def test_bpe_exact(spark, sample):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    own = bpe.ChunkCodec(open(path, encoding="utf-8").read())
    texts = [r["text"] for r in sample.limit(60).collect()] + ["<|endoftext|> x", "it's\x1ca b " * 40, " q r", "Σ ΑΣ é ́ " * 30, "", None, LONG[:5000]]
    for t, (n, ids, text) in zip(texts, own.digest(texts), strict=True):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert n == len(want) and ids == " ".join(map(str, want)) and text == tok.decode(want, skip_special_tokens=False)


def test_bpe_repairs_joins():
    path = vocabulary("word_bpe_49k.json")
    own = bpe.ChunkCodec(open(path, encoding="utf-8").read())
    words = "some plain words that are cut in three".split()
    assert own.repaired([words[:3], words[3:5], words[5:]], set()) == own._encode([" ".join(words)])[0]


def test_other_tokenizers_are_exact_and_repaired():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    own = bpe.ChunkCodec(open(path, encoding="utf-8").read())
    assert not own.parted and bpe.ChunkCodec(open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read()).parted
    rng = np.random.default_rng(12)
    texts = [str(rng.choice(["\n\n\n\n", "  ", "\n\n\n"])).join(f"w{i}" for i in rng.integers(0, 500, 300)) for _ in range(60)] + ["", None, " ", LONG[:3000], "<|endoftext|> x " * 30, "é ñ  ü " * 60]
    for t, (n, ids, text) in zip(texts, own.digest(texts), strict=True):
        assert "".join(bpe.pieces(t or "")) == (t or "")
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert n == len(want) and ids == " ".join(map(str, want)) and text == tok.decode(want, skip_special_tokens=False)
    assert own.stats["repaired"] > 20


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in rng.integers(0, 9999, 4000)]
    a, b = bpe.chunk(" ".join(words)), bpe.chunk(" ".join(["new", "start", *words]))
    assert " ".join(a) == " ".join(words) and len(set(a) & set(b)) > 0.9 * len(a)


def test_bpe_odd_rows(docs):
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        got = bpe.encode_documents(docs(ODD), f.read(), with_ids=True).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}


# -- token counts


def test_token_counts_against_brute_force(docs):
    pieces = [("▁a", -1.0), ("b", -1.5), ("ab", -1.2), ("▁ab", -2.4), ("▁", -2.0), ("a", -2.0), ("abc", -3.0), ("c", -2.0)]
    score = {p: round(s * 1e9) for p, s in pieces}
    byte = min(score.values()) - 1_000_000_000

    def best(w):
        top = {0: (0, 0)}
        for e in range(1, len(w) + 1):
            options = [(top[s][0] + score[w[s:e]], -(top[s][1] + 1)) for s in range(e) if w[s:e] in score]
            if w[e - 1 : e] not in score:
                k = len(w[e - 1].encode())
                options.append((top[e - 1][0] + k * byte, -(top[e - 1][1] + k)))
            s, n = max(options)
            top[e] = (s, -n)
        return top[len(w)]

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(300)]
    own = token_counts.TrieCounter(pieces)
    (n, tokens, total), *_ = own.count([" ".join(words)])
    nodes = len({("▁" + w)[:k] for w in words for k in range(1, len(w) + 2)})
    assert own.scored == nodes  # each shared prefix once
    own.count([" ".join(words[::-1])])
    own.known.clear()
    own.count([" ".join(words[:50])])
    assert own.scored == nodes  # and in later batches not again
    assert n == 300 and tokens == sum(best("▁" + w)[1] for w in words) and total == pytest.approx(sum(best("▁" + w)[0] for w in words) / 1e9)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(ODD), pieces).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[4]["n_words"] == 30_000


# -- toxicity


def test_segments_against_brute_force():
    rng = np.random.default_rng(7)
    model = toxicity.Model({"bad": 2.0, "worse": 3.5})
    for _ in range(60):
        words = rng.choice(["bad", "worse", "x", "y", "z", "w"], rng.integers(0, 25)).tolist()
        s = [model.units.get(w, -toxicity.DRIFT) for w in words]

        def maximal(lo, hi, s=s):
            best = max(((sum(s[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            _, _, _, a, b = best
            return maximal(lo, a) + [(a, b, best[0])] + maximal(b, hi)

        got = [(a, b, round(v, 9)) for a, b, v in model.segments(words)]
        assert sorted(round(x[2], 9) for x in maximal(0, len(words))) == sorted(x[2] for x in got)


def test_toxicity_held_out(spark, docs):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if bad:
            words[int(rng.integers(40))] = rng.choice(["vile", "nasty", "awfulness"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    got = toxicity.score_documents(docs([*rows, (None, None), (9999, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    right = [(r["predicted"] == (r["doc_id"] % 5 == 0)) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert np.mean(right) > 0.95
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.score_documents(docs(ODD), one).collect()} == {0}


# -- language model


def test_lm_base_and_counts(docs):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"W{k}" for k in rng.zipf(1.5, 30) % 500)) for i in range(200)] + [(500, None), (501, ""), (502, "neverseen words")]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    got = {r["doc_id"]: r for r in lm.score_documents(docs(rows), ~lm.held_out(), lm.F.pmod(lm.id_crc("doc_id"), lm.F.lit(10)) == 1).collect()}
    tokens = {i: (t or "").lower().split() + [""] for i, t in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(counts[w] > 0 for w in ws) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert got[i]["score"] < 0
    out = [i for i in tokens if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)


def test_lm_against_brute_force(docs):
    """Deleted interpolation over plain dictionaries, where every word is a class of its own."""
    rng = np.random.default_rng(16)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 25) % 60)) for i in range(300)]
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    texts = {i: [*t.split(), ""] for i, t in rows}
    train = [i for i in texts if fold[i] != 0]
    pairs = lambda ids: collections.Counter(p for i in ids for p in zip(["", *texts[i]], texts[i], strict=False))
    every, held = pairs(train), pairs([i for i in train if fold[i] == 1])
    kept = every - held

    def tables(c):
        before, own = collections.Counter(), collections.Counter()
        for (a, b), n in c.items():
            before[a] += n
            own[b] += n
        return before, own, sum(c.values())

    (b_all, c_all, n_all), (b_kept, c_kept, n_kept) = tables(every), tables(kept)
    bucket = lambda a: min(lm.BUCKETS - 1, int(math.log2(max(b_all[a], 1))) // 2)
    v = len(c_all)

    def parts(a, b, c, before, own, n):
        return [c[a, b] / max(before[a], 1) if own[b] else 0.0, own[b] / n, 1 / (v + 1), float(not own[b])]

    events = [(n, bucket(a), parts(a, b, kept, b_kept, c_kept, n_kept)) for (a, b), n in held.items()]
    mix = lm.em(np.array([e[0] for e in events], float), np.array([e[1] for e in events]), np.array([e[2] for e in events]))
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs(rows), ~lm.held_out(), lm.F.pmod(lm.id_crc("doc_id"), lm.F.lit(10)) == 1).collect()}
    for i, ws in texts.items():
        want = sum(math.log10(mix[bucket(a)] @ parts(a, b, every, b_all, c_all, n_all)) for a, b in zip(["", *ws], ws, strict=False))
        assert got[i] == pytest.approx(want, rel=1e-6)
    for a in ("", "w1", "w2", "w40"):  # known words and the unknown type share all of the probability
        assert sum(mix[bucket(a)] @ parts(a, b, every, b_all, c_all, n_all) for b in [*c_all, None]) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("frequent", [500, 3000])
def test_lm_bigrams_of_rare_words(docs, monkeypatch, frequent):
    """Words beyond those that travel have bigrams and contexts of their own, exactly counted."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    pick = lambda: " ".join(f"w{k} v{k}" for k in (rng.zipf(1.1, 20) + rng.integers(0, 900, 20)) % 2500)
    rows = [(i, pick()) for i in range(500)]
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    texts = {i: [*t.split(), ""] for i, t in rows}
    pairs = lambda ids: collections.Counter(p for i in ids for p in zip(["", *texts[i]], texts[i], strict=False))
    every, held = pairs([i for i in texts if fold[i] != 0]), pairs([i for i in texts if fold[i] == 1])
    own, out = collections.Counter(), collections.Counter()
    for (_, b), n in every.items():
        own[b] += n
    for (_, b), n in held.items():
        out[b] += n
    assert len(own) > lm.OWN
    bucket = lambda a: min(lm.BUCKETS - 1, int(math.log2(max(own[a], 1))) // 2)

    def parts(a, b, off):
        o, h = (out, held) if off else (collections.Counter(), collections.Counter())
        left = own[b] - o[b]
        return [(every[a, b] - h[a, b]) / max(own[a] - o[a], 1) if left else 0.0, left / (sum(own.values()) - sum(o.values())), 1 / (len(own) + 1), float(not left)]

    mix = lm.em(np.array(list(held.values()), float), np.array([bucket(a) for a, _ in held]), np.array([parts(a, b, True) for a, b in held]))
    got = {r["doc_id"]: r for r in lm.score_documents(docs(rows), ~lm.held_out(), lm.F.pmod(lm.id_crc("doc_id"), lm.F.lit(10)) == 1).collect()}
    for i, ws in texts.items():
        want = sum(math.log10(mix[bucket(a)] @ parts(a, b, False)) for a, b in zip(["", *ws], ws, strict=False))
        assert got[i]["score"] == pytest.approx(want, rel=0.01)  # the mixture is learned from rounded estimates
        assert got[i]["n_known"] == sum(own[w] > 0 for w in ws)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((own[w] + 0.1) / (sum(own.values()) + 0.1 * (len(own) + 1))) for w in ws), rel=1e-9)


def test_lm_odd_rows(docs):
    rows = [*ODD, (5, "another text of id five")]
    got = lm.score_documents(docs(rows), lm.F.lit(True), lm.F.lit(False)).collect()
    assert len(got) == len(rows) and sorted(r["n_tokens"] for r in got if r["doc_id"] == 5) == [4, 4, 6]
    assert next(r["n_tokens"] for r in got if r["doc_id"] == 4) == 30_001 and all(math.isfinite(r["score"]) and r["n_known"] == r["n_tokens"] for r in got)


def test_lm_packed_arrays_and_words():
    rng = np.random.default_rng(12)
    for n in ([], [0], [255, 256], [1 << 40, 3], rng.integers(0, 1 << 62, 1000)):
        assert lm._unpack(lm._pack(np.array(n, np.int64))).tolist() == list(n)
    for keys in ([], [7], [0, (1 << 64) - 1], np.unique(rng.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))):
        keys = np.array(keys, np.uint64)
        got = lm._unpack_keys(lm._pack_keys(keys))
        assert got.dtype == np.uint64 and got.tolist() == keys.tolist()
    texts = [" A b\x0bÉc\x1cd ", "", None, "\t\n", "x\u3000y\r\fz"]
    words, sizes = lm.words_of(lm.pa.array(texts))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in (t or "").encode().lower().split()] and sizes.tolist() == [3, 0, 0, 0, 2]


@pytest.mark.parametrize("tokens, size", [(1, 64), (200, 1 << 20)])
def test_lm_texts_are_cut_once_and_chunks_do_not_matter(docs, monkeypatch, tokens, size):
    """Chunks of one document or of many, over one range of keys or many, give the same; and no text is cut again for another pass."""
    rng = np.random.default_rng(15)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 12) % 300)) for i in range(120)]
    score = lambda: sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8), round(r["score"], 8)) for r in lm.score_documents(docs(rows), ~lm.held_out(), lm.F.pmod(lm.id_crc("doc_id"), lm.F.lit(10)) == 1).collect())
    want = score()
    cut, walk = [], lm.walk
    monkeypatch.setattr(lm, "TOKENS", tokens)
    monkeypatch.setattr(lm, "RANGE_BYTES", size)
    monkeypatch.setattr(lm, "walk", lambda rows, ranges: cut.append(ranges) or walk(rows, ranges))
    assert score() == want and len(cut) == 1 and (cut[0] > 50) == (size == 64)


def test_lm_mixture_in_steps(docs, monkeypatch):
    """Steps of estimates stand for their means, so the mixture is nearly that of all estimates as they are."""
    rng = np.random.default_rng(17)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 25) % 400)) for i in range(300)]
    score = lambda: {r["doc_id"]: r["score"] for r in lm.score_documents(docs(rows), ~lm.held_out(), lm.F.pmod(lm.id_crc("doc_id"), lm.F.lit(10)) == 1).collect()}
    exact = score()
    monkeypatch.setattr(lm, "EXACT_EVENTS", 0)
    assert score() == pytest.approx(exact, rel=1e-3)


def test_lm_without_training(docs):
    got = lm.score_documents(docs([(1, "a b"), (2, None)]), lm.F.lit(False), lm.F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"], round(r["score"], 9)) for r in got} == {(0, 0, 0.0, 0.0)}


# -- mixing


def test_mixing_against_sql(spark, sample, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = {r[0]: r[1:] for r in c.sql(f"SELECT doc_id, n_tokens, probability, kept FROM ({mixing.oracle_sql()})").fetchall()}
    assert {r["doc_id"]: (r["n_tokens"], r["probability"], r["kept"]) for r in mixing.mix(sample).collect()} == want


def test_raking_meets_marginals(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100, 1), ("a", "fr", "y", 300, 1), ("b", "en", "y", 50, 1), ("b", "fr", "x", 550, 1)], "source string, lang string, topic string, tokens long, docs long")
    shares = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"x": 0.45, "y": 0.55}}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, target double") for k, v in shares.items()}
    fit = mixing.rake(cells, targets, budget=0.1)
    for axis, want in shares.items():
        for value, share in want.items():
            assert sum(r["fit"] for r in fit.collect() if r[axis] == value) == pytest.approx(share, abs=1e-3)
    assert mixing.shortfalls(fit, 1e-3).count() == 0
    # 150 tokens of "en" can't be half of 600: they are kept whole, and the shortfall is told.
    full = mixing.rake(cells, targets, budget=0.6, most_tests=2)
    assert all(r["fit"] <= r["cap"] + 1e-12 for r in full.collect())
    short = {r["value"]: (r["target"], r["fitted"]) for r in mixing.shortfalls(full, 1e-3).collect() if r["axis"] == "lang"}
    assert short["en"] == (0.5, pytest.approx(0.25, abs=1e-6))


def test_mixing_keeps_shares_and_budget(sample):
    rows = mixing.mix(sample).collect()
    whole, kept = sum(r["n_tokens"] for r in rows), sum(r["n_tokens"] * r["probability"] for r in rows)
    assert kept == pytest.approx(mixing.BUDGET * whole, rel=1e-4) and max(r["probability"] for r in rows) <= 1
    cells = mixing.cells_of(mixing.mix(sample))
    for axis in mixing.AXES:
        for t in mixing.tempered(cells, axis).collect():
            assert sum(r["n_tokens"] * r["probability"] for r in rows if r[axis] == t[axis]) / kept == pytest.approx(t["target"], abs=1e-3)


def test_mixing_odd_rows(docs):
    got = mixing.mix(docs(ODD)).collect()
    assert len(got) == len(ODD) and all(0 <= r["probability"] <= 1 for r in got)
    assert mixing.mix(docs([])).count() == 0
