"""Toxic passages by maximum-scoring segments.

Training documents give each unit (a word, or the first four to eight letters of
one) its log-odds of standing in a toxic document, with an informative
Dirichlet prior from all of them; units count where the log-odds are clearly
positive.  A text is then a sequence of scores: a word's best unit, or a small
penalty for any other word.  One linear scan finds every maximal segment.
Chance segments follow an extreme-value law whose parameters come from the
clean training documents: segment scores there exceed the least unit's score by
an exponential tail, so the best of a text is Gumbel and the number above any
score Poisson.  A text's evidence is the smallest Poisson tail probability over
its r best segments, and a logistic curve on it and on the number of significant
segments gives the score.  Units for calibration come from three quarters of the
training rows, the calibration from the rest, and the final units from all.

The classifier is fitted on a bounded sample of labelled rows (``train_rows``);
every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import id_crc, ship, staged
from pagemill.llm.bpe import slices

#: Labelled rows that the classifier is fitted on, at most; chosen by a hash of the id.
TRAIN_ROWS = 24_000
#: Weight of the informative part of the Dirichlet prior, in documents' units; half a count is added to each unit besides.
PRIOR = 500.0
#: Units in a smaller share of the toxic rows, or in under three of them, don't count.
LEAST_SHARE = 0.005
#: Cost of a word without a toxic unit.
DRIFT = 0.5
#: A unit's log-odds count up to this: beyond, they say more of the sample than of the unit.
MOST_ODDS = 6.0
#: Segments with fewer chance equals expected than this are significant.
EXPECTED = 0.05
_WORDS = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7, 8)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def units_of(word: str) -> list[str]:
    """The word itself, and its prefixes marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    units: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 0.1
    weights: tuple[float, float, float] = (0.0, 1.0, 1.0)

    def __post_init__(self) -> None:
        self.heads = {u[:4] for u in self.units}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Positions of words with a toxic unit, and the best unit's score."""
        heads, units = self.heads, self.units
        out = []
        for i in [i for i, w in enumerate(words) if w[:4] in heads]:
            best = max([units.get(u, 0.0) for u in units_of(words[i])])
            if best > 0:
                out.append((i, best))
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments: (first word, one past the last, score).

        A stack of candidates with the running totals left of and at the end of
        each: a new one merges leftwards while a candidate starts lower and ends
        lower.  Words between hits only lower the total, so only hits are visited.
        """
        stack: list[tuple[int, int, float, float]] = []
        total, last = 0.0, -1
        for i, s in self.hits(words):
            total -= DRIFT * (i - last - 1)
            cand = (i, i + 1, total, total + s)
            total, last = total + s, i
            while True:
                at = len(stack) - 1
                while at >= 0 and stack[at][2] >= cand[2]:
                    at -= 1
                if at < 0 or stack[at][3] >= cand[3]:
                    stack.append(cand)
                    break
                cand = (stack[at][0], cand[1], stack[at][2], cand[3])
                del stack[at:]
        return [(a, b, hi - lo) for a, b, lo, hi in stack]

    def expected(self, score: float, n: int) -> float:
        """Chance segments of at least this score in a clean text of n words."""
        return self.scale * max(n, 1) * math.exp(-min(700.0, self.rate * score))

    def features(self, words: list[str], found: list[tuple[int, int, float]] | None = None) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """Evidence (log of 1 less the decimal logarithm of the least tail probability), log of 1 + significant segments, and those segments."""
        found = self.segments(words) if found is None else found
        best = 0.0
        for r, s in enumerate(sorted((f[2] for f in found), reverse=True), 1):
            mean = self.expected(s, len(words))
            if mean >= r:
                break
            # P(Poisson(mean) >= r) by its leading term and the geometric bound of the others.
            term = r * (math.log(self.scale * max(len(words), 1)) - self.rate * s) - mean - math.lgamma(r + 1) - math.log1p(-mean / (r + 1))
            best = max(best, -term / math.log(10))
        good = [(a, b, s, e) for a, b, s in found if (e := self.expected(s, len(words))) <= EXPECTED]
        return math.log1p(best), math.log1p(len(good)), good

    def score(self, x: float, y: float) -> float:
        z = self.weights[0] + self.weights[1] * x + self.weights[2] * y
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _units(rows: DataFrame, n_bad: int) -> dict[str, float]:
    """Units with clearly positive log-odds, from rows (text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for part in slices(batch, 0):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen[y].update({u for w in set(words_of(t)) for u in units_of(w)})
                if len(seen[0]) + len(seen[1]) > 150_000:
                    yield emit(*seen)
        yield emit(*seen)

    def emit(good: Counter, bad: Counter) -> pa.RecordBatch:
        units = list(good.keys() | bad.keys())
        out = pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([bad[u] for u in units], pa.int64()), pa.array([good[u] for u in units], pa.int64())], ["unit", "bad", "good"])
        good.clear()
        bad.clear()
        return out

    counts = staged(rows.mapInArrow(count, "unit string, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "units")
    totals = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    nb, ng = float(totals["bad"] or 0), float(totals["good"] or 0)
    if not nb or not ng:
        return {}
    prior = F.lit(0.5) + F.lit(PRIOR) * (F.col("bad") + F.col("good")) / (nb + ng)
    odds = F.log((F.col("bad") + prior) / (nb + PRIOR - F.col("bad") - prior)) - F.log((F.col("good") + prior) / (ng + PRIOR - F.col("good") - prior))
    error = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    sure = counts.where(F.col("bad") >= max(3.0, LEAST_SHARE * n_bad)).select("unit", odds.alias("odds"), error.alias("error")).where("odds - 2.3 * error > 1.0 AND odds > 2.0")
    return {r["unit"]: min(MOST_ODDS, r["odds"]) for r in sure.select("unit", "odds").collect()}  # the training rows bound their number


def fit(train: DataFrame, label_col: str = "toxic", text_col: str = "text") -> Model:
    """Fit on all rows of ``train``, which should be bounded (see ``training_rows``).

    Without rows of both labels the model knows no units and scores every text
    by the share of toxic rows.  Rows that calibrate never teach the units that
    they calibrate: with one row of a label, that label has none to teach.
    """
    ship(train.sparkSession)
    rows = train.select(F.col(text_col).cast("string").alias("text"), (F.col(label_col) == 1).cast("int").alias("y")).where("y IS NOT NULL")
    rows = staged(rows, "training")
    both = rows.agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).first()
    if not both["bad"] or not both["good"]:
        return Model(weights=(math.log((both["bad"] + 0.5) / (both["good"] + 0.5)), 0.0, 0.0))
    # A quarter by hash, and where it has none of a label, that label's first row by hash.
    crc = F.crc32(F.coalesce("text", F.lit("")))
    aside = F.pmod(crc, F.lit(4)) == 0
    for r in rows.groupBy("y").agg(F.count_if(aside).alias("n"), F.min(crc).alias("least")).where("n = 0").collect():
        aside |= (F.col("y") == r["y"]) & (crc == r["least"])
    rows = rows.withColumn("aside", aside)
    model = Model(_units(rows.where("NOT aside"), both["bad"] * 3 // 4))
    rest = rows.where("aside")
    found = _score(rest.select("y", "text"), model, keep="y").select("y", "n_words", F.col("segments")).toArrow()  # as many rows as train has
    y = found["y"].to_numpy().astype(float)
    segments = [np.array(s or [], float) for s in found["segments"].to_pylist()]
    words = found["n_words"].to_numpy()
    least = min(model.units.values(), default=1.0)
    chance = np.concatenate([s for s, bad in zip(segments, y, strict=True) if not bad]) if (y == 0).any() else np.empty(0)
    model.rate = (len(chance) + 1) / (float((chance - least).sum()) + 0.7)
    model.scale = (len(chance) + 0.5) / (max(1.0, float(words[y == 0].sum())) * math.exp(-model.rate * least))
    x = np.array([model.features(range(n), [(0, 1, float(v)) for v in s])[:2] for n, s in zip(words.tolist(), segments, strict=True)]).reshape(-1, 2)
    model.weights = _logistic(x, y)
    return Model(_units(rows, both["bad"]), model.rate, model.scale, model.weights)


def _score(docs: DataFrame, model: Model, keep: str, text_col: str = "text") -> DataFrame:
    """(keep, words, segment scores, score, significant passages) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for t in part.column(1).to_pylist():
                    words = words_of(t)
                    found = m.segments(words)
                    x1, x2, good = m.features(words, found)
                    rows.append((len(words), [f[2] for f in found], m.score(x1, x2), [{"first_word": a, "last_word": b - 1, "score": s, "expected": e} for a, b, s, e in good]))
                types = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(passage))
                names = [keep, "n_words", "segments", "score", "passages"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names)

    kind = dict(docs.dtypes)[keep]
    src = docs.select(keep, F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(
        run, f"{keep} {kind}, n_words long, segments array<double>, score double, passages array<struct<first_word: int, last_word: int, score: double, expected: double>>"
    )


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled rows outside the held-out fold, at most about ``train_rows`` of them, chosen by a hash of the id.

    Several labels of one document count as toxic if one of them is.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marks = marks.where(F.pmod(id_crc("doc_id"), F.lit(folds)) != 0)
    n = marks.count()
    if n > train_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(train_rows / n * 1_000_003))
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # train_rows bounds its size


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted, n_words, passages.

    ``passages`` holds each significant passage by its first and last word.
    Labels train the model and are never an input of a score; a null or empty
    text has no passages and the score of a text without toxic words.  Null ids
    count as held out with the checksum of the empty text, repeated ids give a
    row each, and other columns are ignored.
    """
    model = fit(training_rows(docs, labels, folds, train_rows))
    got = _score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, keep="doc_id")
    return got.select(
        "doc_id",
        (F.pmod(id_crc("doc_id"), F.lit(folds)) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_words",
        "passages",
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``; texts pass through one scan and are not shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, folds, train_rows)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, at):
                scores = [m.score(*m.features(words_of(t))[:2]) for t in part.column(at).to_pylist()]
                yield part.filter(pa.array([s < threshold for s in scores]))

    return docs.mapInArrow(run, docs.schema)
