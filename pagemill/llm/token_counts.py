"""Token counts under a unigram piece model, by trie-shared dynamic programming.

The best-scoring segmentation of a word's prefix does not depend on what
follows it.  Distinct words are therefore put into a trie whose nodes hold the
forward score and token count of the prefix that they stand for: a prefix that
another word has brought in is not scored again, and each terminal's count is
stored with its word.  A worker process keeps its trie from one batch and task
to the next; a set number of nodes bounds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import ship
from pagemill.llm.bpe import slices

#: SentencePiece's mark of a word's start.
WORD_START = "▁"
#: Characters of distinct words whose counts a worker keeps.
CACHE_CHARS = 6_000_000
#: Nodes of a worker's trie; beyond, it starts anew.
MOST_NODES = 300_000


def zipf_pieces(pieces: list[str]) -> list[tuple[str, float]]:
    """Log10 probabilities for a piece list in order of frequency: Zipf's law on the rank."""
    norm = math.log10(sum(1 / r for r in range(1, len(pieces) + 1)))
    return [(p, -math.log10(r) - norm) for r, p in enumerate(pieces, 1)]


def sentencepiece_pieces(model_file: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a SentencePiece model, in id order, with Zipf scores."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return zipf_pieces([sp.id_to_piece(i) for i in plain])


class TrieCounter:
    """Best segmentations of words into pieces; a letter that no piece covers counts one token per UTF-8 byte.

    Among segmentations of equal score the one of fewer tokens is taken.
    Scores are whole numbers of 1e-9, so equal sums compare equal in any order.
    """

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.scores = {p: round(s * 1e9) for p, s in pieces}
        self.longest = max(map(len, self.scores), default=1)
        self.byte = min(self.scores.values(), default=-9_000_000_000) - 1_000_000_000
        self.ends: dict[str, int] = {}
        for p in self.scores:
            self.ends[p[-1]] = max(self.ends.get(p[-1], 0), len(p))
        self.known: dict[str, tuple[int, int]] = {}
        self.held = 0
        self.scored = 0
        self._clear()

    def _clear(self) -> None:
        #: Children by (node, letter); score and count of each node. Node 0 is the empty prefix.
        self.child: dict[int, int] = {}
        self.best: list[int] = [0]
        self.tokens: list[int] = [0]

    def _grow(self, w: str, path: list[int]) -> int:
        """The node of ``w``'s prefix that is one letter longer than ``path`` tells."""
        end = len(path)
        ch = w[end - 1]
        best, tokens, scores = self.best, self.tokens, self.scores
        if ch in scores:
            top, count = best[path[-1]] + scores[ch], tokens[path[-1]] + 1
        else:
            k = len(ch.encode("utf-8", "surrogatepass"))
            top, count = best[path[-1]] + k * self.byte, tokens[path[-1]] + k
        wide = self.ends.get(ch, 0)
        for start in range(end - wide if wide < end else 0, end - 1):
            s = scores.get(w[start:end])
            if s is not None:
                s += best[path[start]]
                if s > top or (s == top and tokens[path[start]] + 1 < count):
                    top, count = s, tokens[path[start]] + 1
        best.append(top)
        tokens.append(count)
        self.scored += 1
        return len(best) - 1

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        size = sum(map(len, fresh)) + 20 * len(fresh)
        if self.held + size > CACHE_CHARS * 4:
            self.known.clear()
            self.held = 0
            fresh = list(words)
        self.held += size
        for word in fresh:
            if len(self.best) > MOST_NODES:
                self._clear()
            child = self.child
            w = WORD_START + word
            node, path = 0, [0]
            for ch in w:
                key = node << 21 | ord(ch)
                node = child.get(key, 0)
                if not node:
                    node = child[key] = self._grow(w, path)
                path.append(node)
            self.known[word] = (self.tokens[node], self.best[node])

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(words, tokens, log10 score) of each text; words are parted by ASCII white space."""
        cut = [(t or "").split() if t and t.isascii() and not any(c in t for c in "\x1c\x1d\x1e\x1f") else ascii_split(t or "") for t in texts]
        self.learn({w for ws in cut for w in ws})
        known = self.known
        out = []
        for ws in cut:
            got = [known[w] for w in ws]
            out.append((len(ws), sum([g[0] for g in got]), sum([g[1] for g in got]) / 1e9))
        return out


def ascii_split(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


_COUNTERS: dict[tuple, TrieCounter] = {}


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under the piece model: id, n_words, n_tokens, score (log10).

    A null or empty text has no words and no tokens, and score 0.  Ids may be
    null or repeat; each row gives one row.  Other columns are ignored.  The
    piece list is broadcast: its size is the vocabulary's, whatever the data.
    """
    if not pieces:
        raise ValueError("the piece list is empty")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = (len(pieces), hash(tuple(pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _COUNTERS.get(key)
        if own is None:
            _COUNTERS.clear()
            own = _COUNTERS[key] = TrieCounter(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                got = own.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([g[i] for g in got], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64())))],
                    ["id", "n_words", "n_tokens", "score"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_words long, n_tokens long, score double").withColumnRenamed("id", id_col)
