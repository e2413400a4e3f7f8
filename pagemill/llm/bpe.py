"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut at white space where a rolling hash over the last eight bytes
hits a mask, so equal passages in different documents yield equal chunks.
Within a worker process every distinct chunk is encoded once and its ids, their
decimal text and its decoded text are reused.  Each join between two chunks is
then checked by encoding the words around it together; on disagreement the
window grows until both sides agree, up to the whole document.

A tokenizer that parts words at white space and drops it (tried when the codec
is made) encodes a new chunk from its distinct words, and windows grow word by
word.  Any other encodes whole chunks, white space included, and chunks on the
two sides of a join that disagrees become one.

Memory is bounded: the caches hold at most a set number of characters and are
emptied when full, so a task never keeps more than that beside one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import ship

#: A boundary falls at one white-space position in this many, on average.
CHUNK_WORDS = 32
#: Characters that each cache may hold.
CACHE_CHARS = 10_000_000
#: A private-use character that texts hardly hold; words that do are encoded alone.
MARK = "\ue000"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunk(text: str) -> list[str]:
    """Content-defined chunks: their concatenation with single separators dropped covers every word of ``text``.

    Separators are only U+0020 and U+000A; any other white space stays inside a chunk.
    """
    if len(text) < 64:
        return [text] if text else []
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at >= 8]
    if not len(at):
        return [text]
    window = np.lib.stride_tricks.sliding_window_view(data, 8)[at - 8]
    mixed = np.ascontiguousarray(window).view("<u8").ravel() * _MIX
    cuts = at[(mixed >> np.uint64(40)) % np.uint64(CHUNK_WORDS) == 0]
    out, start = [], 0
    for cut in [*cuts.tolist(), len(raw)]:
        if cut > start:
            out.append(raw[start:cut].decode("utf-8", "surrogatepass"))
        start = cut + 1
    return out


def pieces(text: str) -> list[str]:
    """Content-defined chunks whose concatenation is ``text``: each but the first begins with its separator."""
    out, at = [], 0
    for c in chunk(text):
        at = text.index(c, at) + len(c) if c else at
        out.append(at)
    starts = [0, *out[:-1]]
    return [text[a:b] for a, b in zip(starts, [*out[:-1], len(text)], strict=True)] if out else ([text] if text else [])


#: Texts that tell whether a tokenizer's words are independent of each other and of white space.
PROBES = ("a b", "Hello  world\nagain", "it's 12 3! x", " lead and trail ")


class ChunkCodec:
    """Encodes and decodes whole texts exactly as the tokenizer does, one distinct chunk at a time.

    Where words are independent, a chunk that is new is put together from its
    distinct words, each encoded once; new words go to the tokenizer in groups,
    with a mark between them.
    """

    def __init__(self, tokenizer_json: str, cache_chars: int = CACHE_CHARS) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cache_chars = cache_chars
        self.decoder = self.tok.decoder
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.digits = list(map(str, range(size)))
        self.mark = self._encode([MARK])[0]
        self.safe = bool(self.mark) and self._encode([f"a {MARK} b"])[0] == self._encode(["a"])[0] + self.mark + self._encode(["b"])[0]
        self.parted = all(ids == [i for w in self._encode(p.split()) for i in w] for p, ids in zip(PROBES, self._encode(list(PROBES)), strict=True))
        self.whole: dict[str, list[int]] = {}
        self.words: dict[str, tuple[int, str, str]] = {"": (0, "", "")}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple[int, str, str, str, str]] = {}
        self.joins: set[tuple[str, str]] = set()
        self.held = [0, 0, 0]
        self.stats = {"chunks": 0, "seen": 0, "repaired": 0}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def decoded(self, ids: list[int]) -> str:
        """Without a decoder the tokenizer joins token names by spaces."""
        if self.decoder is None:
            return " ".join([self.names[i] for i in ids])
        return self.tok.decode(ids, skip_special_tokens=False)

    def _entries(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each word; words go to the tokenizer in groups, with a mark between that no word holds."""
        if not self.safe or any(MARK in w for w in words):
            yield from self._encode(words)
            return
        mark, n, last = self.mark, len(self.mark), self.mark[-1]
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        between = f" {MARK} "
        for ids, group in zip(self._encode([between.join(g) for g in groups]), groups, strict=True):
            start = end = 0
            for _ in group[1:]:
                while ids[(end := ids.index(last, end)) + 1 - n : end + 1] != mark or end + 1 - n < start:
                    end += 1
                yield ids[start : end + 1 - n]
                start = end = end + 1
            yield ids[start:]

    def _learn_words(self, texts: list[str]) -> None:
        """Know all words of ``texts``. A full cache becomes the old one, from which words that occur again are taken back."""
        need = set()
        for t in texts:
            need.update(t.replace("\n", " ").split(" "))
        for _ in range(2):
            known, old = self.words, self.old
            missing = [w for w in need if w not in known]
            size = sum(map(len, missing)) + 30 * len(missing)
            if self.held[0] + size <= self.cache_chars or not known:
                break
            self.old, self.words, self.held[0] = known, {}, 0
        self.held[0] += size
        back = [(w, old[w]) for w in missing if w in old]
        known.update(back)
        fresh = [w for w in missing if w not in known] if back else missing
        digits = self.digits
        for w, ids in zip(fresh, self._entries(fresh), strict=True):
            known[w] = (len(ids), " ".join([digits[i] for i in ids]), self.decoded(ids))
        known[""] = (0, "", "")

    def _learn(self, texts: list[str]) -> None:
        """Encode the chunks that are new."""
        fresh = list(dict.fromkeys(t for t in texts if t not in self.chunks))
        if not fresh:
            return
        size = 10 * sum(map(len, fresh))
        if self.held[1] + size > 2 * self.cache_chars:
            self.chunks.clear()
            self.held[1] = 0
            fresh = list(dict.fromkeys(texts))
            size = 10 * sum(map(len, fresh))
        self._learn_words(fresh)
        self.held[1] += size
        self.stats["chunks"] += len(fresh)
        known = self.words
        for t in fresh:
            words = t.replace("\n", " ").split(" ")
            got = [x for x in [known[w] for w in words] if x[0]]
            solid = [w for w in (words if len(words) < 3 else (words[0], words[-1])) if w] or [w for w in words if w] or [""]
            self.chunks[t] = (sum([x[0] for x in got]), " ".join([x[1] for x in got]), " ".join([x[2] for x in got]), solid[0], solid[-1])

    def _agree(self, pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
        """Joins whose two words encode together as they do apart."""
        fresh = [p for p in pairs if p not in self.joins]
        good = pairs & self.joins
        for p, ids in zip(fresh, self._entries([f"{a} {b}" for a, b in fresh]), strict=True):
            if ids == self.word_ids(p[0]) + self.word_ids(p[1]):
                good.add(p)
        self.held[2] += sum(len(a) + len(b) + 60 for a, b in fresh)
        if self.held[2] > self.cache_chars // 2:
            self.joins.clear()
            self.held[2] = 0
        self.joins |= good
        return good

    def word_ids(self, word: str) -> list[int]:
        if word not in self.words:
            ids = self._encode([word])[0]
            self.words[word] = (len(ids), " ".join(map(str, ids)), self.decoded(ids))
        return list(map(int, self.words[word][1].split()))

    def digest(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(tokens, ids in decimal joined by spaces, decoded text) of each text."""
        if not self.parted:
            found = self.encoded([t or "" for t in texts])
            return [(len(ids), " ".join(map(str, ids)), self.decoded(ids)) for ids in found]
        cut = [chunk(t or "") for t in texts]
        self._learn([c for cs in cut for c in cs])
        got = [[x for x in map(self.chunks.__getitem__, cs) if x[0]] for cs in cut]
        pairs = [[(a[4], b[3]) for a, b in zip(xs, xs[1:], strict=False)] for xs in got]
        good = self._agree({p for ps in pairs for p in ps})
        out = []
        for xs, ps in zip(got, pairs, strict=True):
            self.stats["seen"] += len(xs)
            if self.decoder is None and good.issuperset(ps):
                out.append((sum([x[0] for x in xs]), " ".join([x[1] for x in xs]), " ".join([x[2] for x in xs])))
            else:
                ids = self.repaired([[w for w in c.replace("\n", " ").split(" ") if w] for c in cut[len(out)]], good)
                out.append((len(ids), " ".join(map(str, ids)), self.decoded(ids)))
        return out

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts from whole chunks; chunks that disagree at a join are encoded again as one."""
        cut = [pieces(t) for t in texts]
        self._learn_whole([c for cs in cut for c in cs])
        sides = [[(a[self._edge(a, last=True) :], b[: self._edge(b, last=False)]) for a, b in zip(cs, cs[1:], strict=False)] for cs in cut]
        self._learn_whole([x for ss in sides for a, b in ss for x in (a, b, a + b)])
        out = []
        for cs, ss in zip(cut, sides, strict=True):
            self.stats["seen"] += len(cs)
            joined = cs[:1]
            for c, (a, b) in zip(cs[1:], ss, strict=True):
                if self.whole[a + b] == self.whole[a] + self.whole[b]:
                    joined.append(c)
                else:
                    self.stats["repaired"] += 1
                    joined[-1] += c
            self._learn_whole(joined)
            out.append([i for c in joined for i in self.whole[c]])
        if self.held[1] > self.cache_chars:
            self.whole.clear()
            self.held[1] = 0
        return out

    @staticmethod
    def _edge(text: str, last: bool) -> int:
        """Where the last two words of a text begin, with the white space before them, or where the first two end."""
        words = list(re.finditer(r"\s*\S+", text))
        if len(words) < 3:
            return 0 if last else len(text)
        return words[-2].start() if last else words[1].end()

    def _learn_whole(self, texts: list[str]) -> None:
        fresh = [t for t in dict.fromkeys(texts) if t not in self.whole]
        self.held[1] += sum(map(len, fresh))
        self.stats["chunks"] += len(fresh)
        self.whole.update(zip(fresh, self._encode(fresh), strict=True))

    def repaired(self, chunks: list[list[str]], good: set[tuple[str, str]]) -> list[int]:
        """Ids of a text in chunks of words: around a join that disagrees, a window is encoded again, and widened on both sides until what it gives at its edges agrees with what stands there."""
        words = [w for ws in chunks for w in ws]
        joins, at = [], 0
        for ws in chunks:
            if at and ws and (words[at - 1], ws[0]) not in good:
                joins.append(at)
            at += len(ws)
        ids, start = [], 0
        for at in joins:
            if at < start:
                continue
            self.stats["repaired"] += 1
            width = 2
            while True:
                lo, hi = max(start, at - width), min(len(words), at + width)
                window = self._encode([" ".join(words[lo:hi])])[0]
                head, tail = (self.word_ids(words[lo]) if lo > start else []), (self.word_ids(words[hi - 1]) if hi < len(words) else [])
                if (lo == start and hi == len(words)) or window[: len(head)] == head and window[len(window) - len(tail) :] == tail:
                    break
                width *= 2
            for w in words[start:lo]:
                ids.extend(self.word_ids(w))
            ids.extend(window)
            start = hi
        for w in words[start:]:
            ids.extend(self.word_ids(w))
        return ids


#: One codec for each tokenizer and worker process, so that later tasks find the caches filled.
_CODECS: dict[str, ChunkCodec] = {}


def codec(tokenizer_json: str) -> ChunkCodec:
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ChunkCodec(tokenizer_json)
    return _CODECS[key]


def encode_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also
    the ids themselves (``array<int>``) and the decoded text.  A null text counts
    as empty: no tokens and the digests of the empty string.  Ids may be null or
    repeat; each input row gives one output row.  Other columns are ignored, so
    clashing names do no harm.  Nothing is shuffled: cost is a scan.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(tokenizer_json)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = codec(model.value)
        for batch in batches:
            for part in slices(batch, 1):
                got = own.digest(part.column(1).to_pylist())
                cols = [
                    part.column(0),
                    pa.array([x[0] for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in got], pa.string()),
                    pa.array([hashlib.sha256(x[2].encode("utf-8", "surrogatepass")).hexdigest() for x in got], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([[int(i) for i in x[1].split()] for x in got], pa.list_(pa.int32())), pa.array([x[2] for x in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def slices(batch: pa.RecordBatch, text_at: int, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, and one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
