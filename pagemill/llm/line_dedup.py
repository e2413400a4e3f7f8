"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct lower-case words.  A line is removed if an
earlier one, by (doc_id, line), has a token set of Jaccard similarity at least
the threshold.  Lines without tokens are left alone.

1. Lines are cut once; their words' hashes are staged.  The lines of each token
   are counted into a table of fixed size; a line's tokens are ordered by rarity,
   ties by hash.
2. Lines of equal token sets are one class, which stands at its first line;
   later lines of a class are removed.
3. Two similar sets of m and n tokens have at least ceil(t/(1+t) (m+n)) in
   common.  Their first common token stands so early in both that as many are
   left (positional filter), and among the first m - ceil(t m) + 1 of each
   (prefix filter).  Classes are posted under those tokens; postings that meet
   pass the length and positional filters and a bound on the symmetric
   difference from parity bits.
4. Where a posting passes the filters with the earliest posting of its token, its
   class meets that one only, which settles groups of near copies with a pair a
   member; else it meets every earlier one.
5. Candidates are verified on the whole token sets; a class for which none holds
   although some posting took the short way meets all earlier ones after all.

Sets are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import staged, unstaged

THRESHOLD = 0.8
#: Counters of the frequency table; a power of two.
COUNTERS = 1 << 20
#: Bits of the rows that an aggregate's first, faster table holds in a task; as it is, most counters go to the second.
_FAST = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Bytes that a task reads, and how many at least for counting: each task hands on a row for every counter that it has met.
_SPLIT, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", 64 << 20
_BLOCK = 1 << 12
#: Cells of a table that tells which hashes are needed, at most; a power of two.
MOST_CELLS = 1 << 23
#: Cells for each class whose postings are looked for: with a dozen postings a class, one other posting in a hundred passes by chance.
CLASS_CELLS = 1 << 10
#: Cells in a byte of such a table: bytes stay below 128, which ``ascii`` reads.
_BITS = 4
#: The byte that stands for each level of the rarity table: the one whose checksum has that number as its top byte. No two bytes share it.
_BYTES = {zlib.crc32(bytes([b])) >> 24: b for b in range(256)}
_BYTES = bytes(_BYTES[i] for i in range(128))
#: Classes whose postings may be broadcast.
SMALL_CLASSES = 2_000
#: Sets of more tokens have 128 parity bits in a posting, others 64.
WIDE = 80
#: Greatest size and position that a posting tells; larger ones pass the filters.
_MOST = (1 << 15) - 1
_LEAST_ID = -(1 << 63)
#: White space within a line, besides the space.
_MARKS = "\t\r\x0b\x0c"


def _spaced(text: Column, marks: str) -> Column:
    """Lower-case text with a space for each of ``marks``; cheaper than ``translate``, which maps letter by letter.

    ``replace`` compares at every byte: texts without such marks, found much faster, don't go through it.
    """
    low = out = F.lower(text)
    found = F.lit(False)
    for c in marks:
        out = F.replace(out, F.lit(c), F.lit(" "))
        found |= F.contains(text, F.lit(c))
    return F.when(found, out).otherwise(low)


def words_of(line: Column) -> Column:
    """Lower-case words of a line, parted by ASCII white space, and empty strings."""
    return F.split(_spaced(line, _MARKS), " ")


def versions(docs: DataFrame) -> Column:
    """Tells texts of one id apart: a hash of the text where some id repeats, else 0."""
    again = docs.groupBy(F.col("doc_id").cast("long")).count().where("count > 1").limit(1).count()
    return F.xxhash64(F.col("text").cast("string")) if again else F.lit(0).cast("long")


def lines_of(docs: DataFrame, ver: Column) -> DataFrame:
    """(doc_id, ver, line, words). Texts without a break are one line; null texts have none."""
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), ver.alias("ver"), F.posexplode(F.split(_spaced(text, _MARKS), "\n")).alias("line", "words"))
    return rows.withColumn("words", F.split("words", " "))


def _packed(cells: DataFrame, size: int, of: bytes = bytes(range(128))) -> bytes:
    """The byte in ``of`` for each cell (i: int, level: int up to 127), that of 0 where there is none: ``size`` bytes in all, whatever the data."""
    cell = F.concat(F.lpad(F.hex(F.col("i").bitwiseAND(F.lit(_BLOCK - 1))), 3, "0"), F.lpad(F.hex("level"), 2, "0"))
    blocks = cells.groupBy(F.shiftright("i", _BLOCK.bit_length() - 1).alias("block")).agg(F.array_join(F.collect_list(cell), "").alias("x"))
    table = bytearray(of[:1] * size)
    for r in blocks.toLocalIterator():  # size // _BLOCK rows
        at, x = r["block"] * _BLOCK, r["x"]
        for k in range(0, len(x), 5):
            table[at + int(x[k : k + 3], 16)] = of[int(x[k + 3 : k + 5], 16)]
    return bytes(table)


def _cell(table: bytes, h: Column) -> Column:
    """The byte of a packed table for a hash."""
    return F.ascii(F.substring(F.lit(table), h.bitwiseAND(F.lit(len(table) - 1)).cast("int") + 1, 1).cast("string"))


def _checksum(table: bytes, h: Column) -> Column:
    """The checksum of a packed table's byte for a hash; with a table of _BYTES it has the level in its top byte. It reads a byte faster than ``ascii`` does, which makes a string of it.

    Setting all bits above the cell's counts it from the table's end, as ``substring`` does below zero.
    """
    return F.crc32(F.substring(F.lit(table), h.bitwiseOR(F.lit(-len(table))).cast("int"), 1))


def _level(table: bytes, h: Column) -> Column:
    """The level in a table of _BYTES for a hash."""
    return F.shiftright(_checksum(table, h), 24)


def _token(table: bytes, h: Column) -> Column:
    """A token of a hash: its level in the top byte, then 56 bits that tell it apart from others of that level.

    The rest of the checksum, the same for all of a level, is mixed into the hash: to
    take it off is a step more for every word, and steps of lambdas aren't compiled.
    """
    return F.shiftleft(_checksum(table, h), 32).bitwiseXOR(F.shiftrightunsigned(h, 8))


def _marked(hashes: DataFrame, size: int) -> bytes:
    """A table of ``size`` cells, _BITS to a byte, in which the cells of the hashes (i: long) are set."""
    cell = F.col("i").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1), cell.bitwiseAND(F.lit(_BITS - 1)).cast("int"))
    at = F.shiftright(cell, _BITS.bit_length() - 1).cast("int")
    return _packed(hashes.groupBy(at.alias("i")).agg(F.bit_or(bit).alias("level")), size // _BITS)


def _is_marked(table: bytes, h: Column) -> Column:
    """Whether the cell of a hash is set: true for every marked hash, and by chance for others."""
    byte = _cell(table, F.shiftright(h, _BITS.bit_length() - 1))
    return F.call_function("shiftright", byte, h.bitwiseAND(F.lit(_BITS - 1)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _cells(least: int) -> int:
    """A power of two of at least 2**12 and at most MOST_CELLS cells, near ``least``."""
    return 1 << min(MOST_CELLS, max(1 << 12, least)).bit_length() - 1


def hash_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, ver, line, hashes) of lines_of: distinct 64-bit hashes of a line's words, and of the empty string.

    Nothing stands around ``array_distinct`` but what is compiled as well: within a lambda's input it isn't.
    """
    return lines.select("doc_id", "ver", "line", F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"))


def _hash_lines(rows: DataFrame) -> DataFrame:
    """``rows`` that have been hashed, as they are; else the hashed lines of documents, or of lines_of."""
    if "hashes" in rows.columns:
        return rows
    return hash_lines(rows if "words" in rows.columns else lines_of(rows, F.lit(0).cast("long")))


def without_empty(hashes: DataFrame) -> DataFrame:
    """hash_lines less the empty string. It is to be staged so: within a lambda's input ``array_remove`` isn't compiled."""
    return hashes.withColumn("hashes", F.array_remove("hashes", F.xxhash64(F.lit(""))))


def rarity_table(rows: DataFrame) -> bytes:
    """A byte for each counter: half-octave class of the lines that its tokens stand in. ``rows`` are documents or hash_lines."""
    counter = F.col("h").bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
    seen = _hash_lines(rows).select(F.explode("hashes").alias("h")).groupBy(counter.alias("i")).agg(F.count("*").alias("n"))
    cells = seen.select("i", F.least(F.lit(126), F.round(F.log2(F.col("n") + 1) * 2)).cast("int").alias("level"))
    spark = rows.sparkSession
    conf = spark.conf
    before = {key: conf.get(key, None) for key in (_FAST, _SPLIT)}
    conf.set(_FAST, str(COUNTERS.bit_length() - 1))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(_SPLIT)) < SPLIT_BYTES:
        conf.set(_SPLIT, str(SPLIT_BYTES))
    try:
        return _packed(cells, COUNTERS, _BYTES)
    finally:
        for key, value in before.items():
            conf.set(key, value) if value is not None else conf.unset(key)


def _overlap(m: Column, n: Column, t: float) -> Column:
    """Least common tokens of similar sets of m and n tokens."""
    return F.ceil((m + n) * t / (1 + t) - 1e-9)


def hashed(words: Column) -> Column:
    """Distinct 64-bit hashes of words."""
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _parities(toks: str) -> tuple[Column, Column]:
    """Parity bits of a token list: of all tokens, and of those that are odd. A shift takes the low six bits of a token's hash."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    shift = lambda bit, x: F.call_function("shiftleft", bit, F.hash(x))
    every = F.aggregate(toks, zero, lambda acc, x: acc.bitwiseXOR(shift(one, x)))
    odd = F.aggregate(toks, zero, lambda acc, x: acc.bitwiseXOR(shift(x.bitwiseAND(one), x)))
    return every, odd


def token_lines(lines: DataFrame, table: bytes, threshold: float) -> DataFrame:
    """(doc_id, ver, line, sig, m, s0, s1, prefix): class signature, tokens, parities, and a 32-bit key of each prefix token.

    A token is its rarity in the top byte, then 56 bits, so sorting puts the
    rarest first.  ``s0`` is the parity over 64 bits; ``s1`` splits it
    in 128 where there are more than WIDE tokens, and is 0 else.  No filter
    stands here: it would be pushed below the tokens and work them out twice.

    ``lines`` are without_empty, or lines_of.  A token is never null, which Spark
    can't know of what it has read from files: told by ``coalesce``, it sorts plain
    numbers instead of comparing objects.
    """
    token = lambda h: F.coalesce(_token(table, h), F.lit(0).cast("long"))
    rows = lines if "hashes" in lines.columns else without_empty(_hash_lines(lines))
    sets = rows.select("doc_id", "ver", "line", F.sort_array(F.transform("hashes", token)).alias("toks"))
    size = F.size("toks")
    length = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
    every, odd = _parities("toks")
    keys = F.transform(F.slice("toks", F.lit(1), length), lambda x: F.hash(x))
    return sets.select("doc_id", "ver", "line", F.xxhash64("toks").alias("sig"), size.alias("m"), every.alias("s0"), F.when(size > WIDE, odd).otherwise(F.lit(0).cast("long")).alias("s1"), keys.alias("prefix"))


def classes_of(lines: DataFrame) -> DataFrame:
    """(sig, at, n, m, s0, s1, prefix) of every class: its first line, its lines, and what these have in common."""
    rows = lines.where("m > 0").select("sig", F.struct("doc_id", "ver", "line").alias("at"), "m", "s0", "s1", "prefix")
    return rows.groupBy("sig").agg(F.min("at").alias("at"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("m", "s0", "s1", "prefix")))


def postings(classes: DataFrame) -> DataFrame:
    """(tok, mi, doc, sig, s0, s1): size and position share an int."""
    rows = classes.select(
        F.coalesce("at.doc_id", F.lit(_LEAST_ID)).alias("doc"), "sig", "s0", "s1", F.least("m", F.lit(_MOST)).alias("m"), F.posexplode("prefix").alias("i", "tok")
    )
    return rows.select("tok", F.shiftleft("m", 16).bitwiseOR(F.least("i", F.lit(_MOST))).alias("mi"), "doc", "sig", "s0", "s1")


def _similar(a: str, b: str, t: float) -> Column:
    """Length, positional and parity filters on two postings of one token."""
    col = F.col
    m, n = F.shiftright(col(f"{a}mi"), 16), F.shiftright(col(f"{b}mi"), 16)
    i, j = col(f"{a}mi").bitwiseAND(F.lit(0xFFFF)), col(f"{b}mi").bitwiseAND(F.lit(0xFFFF))
    x, y = col(f"{a}s0").bitwiseXOR(col(f"{b}s0")), col(f"{a}s1").bitwiseXOR(col(f"{b}s1"))
    # s1 is the parity of half of the bits' tokens, and s0 that of all: the other half is their difference.
    apart = F.when(F.least(m, n) > WIDE, F.bit_count(y) + F.bit_count(x.bitwiseXOR(y))).otherwise(F.bit_count(x))
    fits = (F.least(m - i, n - j) >= (m + n) * (t / (1 + t)) - 1e-9) & (apart <= m + n - 2 * _overlap(m, n, t))
    return fits | (F.greatest(m, n) == _MOST)


def candidates(classes: DataFrame, t: float) -> DataFrame:
    """(late, early, short): classes that may be similar, once for each token; ``short`` where that token's other postings weren't met.

    Window and join are on the same token: one exchange serves all.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    post = postings(classes).repartition(parts, "tok")
    names = ("mi", "sig", "s0", "s1")
    # Least of all, not first in order: rows sorted by the token alone, a number, are sorted without comparing them.
    late = post.withColumn("hub", F.min(F.struct("doc", *sorted(names, key="sig".__ne__))).over(Window.partitionBy("tok")))
    late = late.select(*(F.col(c).alias(f"a_{c}") for c in post.columns), *(F.col(f"hub.{c}").alias(f"h_{c}") for c in names))
    late = late.withColumn("to", F.when((F.col("h_sig") != F.col("a_sig")) & _similar("a_", "h_", t), F.col("h_sig"))).drop(*(f"h_{c}" for c in names))
    early = post.select(*(F.col(c).alias(f"b_{c}") for c in post.columns))
    met = late.join(early, F.col("a_tok") == F.col("b_tok"))
    # A posting with a shortcut meets itself once, which carries the shortcut out.
    meets = F.when(F.col("to").isNull(), (F.col("b_doc") <= F.col("a_doc")) & (F.col("b_sig") != F.col("a_sig")) & _similar("a_", "b_", t)).otherwise(F.col("b_sig") == F.col("a_sig"))
    return met.where(meets).select(F.col("a_sig").alias("late"), F.coalesce("to", "b_sig").alias("early"), F.col("to").isNotNull().alias("short"))


def _whole_sets(docs: DataFrame, ver: Column, needed: DataFrame) -> DataFrame:
    """(sig, at, toks) of classes ``needed`` (sig, at), whose first lines are read and cut again; most other lines, and documents without such lines, are passed over uncut."""
    place = F.xxhash64(F.struct("doc_id", "ver", "line"))
    of = F.struct(F.col("doc_id").cast("long"))
    marks = needed.select(F.explode(F.array(F.xxhash64("at"), F.xxhash64(F.struct("at.doc_id")))).alias("i"))
    table = _marked(marks, _cells(16 * needed.count()))
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull() & _is_marked(table, F.xxhash64(of))).select(F.col("doc_id").cast("long").alias("doc_id"), ver.alias("ver"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
    rows = rows.where(_is_marked(table, place)).select(F.struct("doc_id", "ver", "line").alias("place"), hashed(words_of(F.col("text"))).alias("toks"))
    # A row that repeats id and text gives a place again.
    return needed.join(rows, F.col("at") == F.col("place")).select("sig", "at", "toks")


def _verified(pairs: DataFrame, docs: DataFrame, ver: Column, classes: DataFrame, t: float) -> DataFrame:
    """Staged classes ``late`` of pairs (late, early) whose whole sets are similar and whose order is that."""
    needed = pairs.select(F.col("late").alias("sig")).unionByName(pairs.select(F.col("early").alias("sig"))).distinct()
    needed = staged(classes.join(needed, "sig", "left_semi").select("sig", "at"), "needed", few=True)
    own = staged(_whole_sets(docs, ver, needed), "sets", "zstd")
    left = own.select(F.col("sig").alias("late"), F.col("toks").alias("x"), F.col("at").alias("late_at"))
    right = own.select(F.col("sig").alias("early"), F.col("toks").alias("y"), F.col("at").alias("early_at"))
    both = pairs.join(left, "late").join(right, "early").where("early_at < late_at")
    common = F.size(F.array_intersect("x", "y"))
    gone = staged(both.where(common >= (F.size("x") + F.size("y") - common) * t - 1e-9).select("late").distinct(), "gone", few=True)
    unstaged(needed, own)
    return gone


def _met_by(classes: DataFrame, open_: DataFrame, count: int, t: float) -> DataFrame:
    """Pairs (late, early) of the open classes (sig) and all earlier ones that pass the filters; only their tokens' postings are dealt out."""
    again = postings(classes.join(open_, "sig", "left_semi"))
    table = _marked(again.select(F.col("tok").cast("long").alias("i")), _cells(CLASS_CELLS * count))
    other = postings(classes).where(_is_marked(table, F.col("tok").cast("long")))
    other = other.select(*(F.col(c).alias(f"b_{c}") for c in other.columns))
    again = again.select(*(F.col(c).alias(f"a_{c}") for c in again.columns))
    if count <= SMALL_CLASSES:
        again = F.broadcast(again)  # its size has just been checked
    before = (F.col("b_doc") <= F.col("a_doc")) & (F.col("b_sig") != F.col("a_sig"))
    return again.join(other, F.col("a_tok") == F.col("b_tok")).where(before & _similar("a_", "b_", t)).select(F.col("a_sig").alias("late"), F.col("b_sig").alias("early")).distinct()


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, ver: Column | None = None) -> DataFrame:
    """(doc_id, ver, line) of every line to remove."""
    ver = versions(docs) if ver is None else ver
    # Hashes hardly repeat within a page, nor do signatures and parities: a dictionary of them would be made for each file and given up.
    plain = {"parquet.enable.dictionary": "false"}
    hashes = staged(without_empty(hash_lines(lines_of(docs, ver))), "hashes", **plain)
    lines = staged(token_lines(hashes, rarity_table(hashes), threshold), "lines", "zstd", **plain)
    unstaged(hashes)
    classes = staged(classes_of(lines), "classes", "zstd")
    met = staged(candidates(classes, threshold).groupBy("late", "early").agg(F.max("short").alias("short")), "pairs", few=True)
    pairs = met.select("late", "early")
    gone = _verified(pairs, docs, ver, classes, threshold)
    # Classes that took a short way but were not verified may have missed others: they meet all earlier ones.
    open_ = staged(met.where("short").select("late").distinct().join(gone, "late", "left_anti").select(F.col("late").alias("sig")), "open", few=True)
    n = open_.count()
    if n:
        rest = staged(_met_by(classes, open_, n, threshold).join(pairs, ["late", "early"], "left_anti"), "pairs", few=True)
        gone = gone.unionByName(_verified(rest, docs, ver, classes, threshold)).distinct()
    # Of the other classes, one line each, nothing goes.
    hit = classes.join(gone.select(F.col("late").alias("sig"), F.lit(True).alias("gone")), "sig", "left").where("n > 1 OR gone").select("sig", "at", "gone")
    own = lines.select("sig", F.struct("doc_id", "ver", "line").alias("own")).join(hit, "sig").where("gone OR own <> at").select("own.*")
    out = staged(own, "removed", few=True)
    unstaged(lines, classes, met, open_)
    return out


def _by_text(docs: DataFrame, threshold: float, ver: Column) -> DataFrame:
    gone = removed_lines(docs, threshold, ver)
    return gone.distinct().groupBy(F.col("doc_id").alias("g_id"), F.col("ver").alias("g_ver")).agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its removed lines, and ``removed_lines`` (array<int>, from 0, in order).

    Null texts stay null.  A text whose lines all go becomes empty, and its row
    stays.  Rows that repeat id and text get the same result; a null id comes
    first in the order.  A column named ``removed_lines`` is replaced; other
    columns pass whatever their names.  No rows give no rows.
    """
    ver = versions(docs)
    gone = _by_text(docs, threshold, ver)
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), ver.alias("own_ver"))
    met = rows.join(gone, F.col("own_id").eqNullSafe(F.col("g_id")) & (F.col("own_ver") == F.col("g_ver")), "left")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    cols = [c for c in docs.columns if c != "removed_lines"]
    return met.select(*(kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in cols), F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"))


def summary(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed_lines. Texts are not shuffled."""
    ver = versions(docs)
    gone = _by_text(docs, threshold, ver)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ver.alias("own_ver"), F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"))
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("own_ver") == F.col("g_ver")), "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return met.select("doc_id", F.col("n_lines").cast("int").alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed_lines"))
