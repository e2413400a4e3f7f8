"""Mixing sources to target weights by iterative proportional fitting.

Token totals are aggregated once to cells of (source, language, topic).  The
cell table is raked: in turn each axis' sums are scaled to that axis' target
shares, and no cell beyond the share that keeping all of it would give, so what
a full cell can't take goes to others.  This goes on until all sums meet their
targets, or a number of rounds is spent: then the targets can't all be met, and
``shortfalls`` tells which.  A document is kept with its cell's probability:
fitted share over present share, scaled to the token budget.

DataFrame functions only.  The documents are read twice (aggregate, sample)
and never shuffled: the cell table has one row for each combination that
occurs, and joins back by whatever strategy its size permits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import staged, unstaged

AXES = ("source", "lang", "topic")
#: Rounds of raking between two tests of convergence, each of which scales all three axes; and tests at most.
ROUNDS = 8
MOST_TESTS = 25
#: Greatest difference between a fitted and a target share where raking ends.
TOLERANCE = 1e-6
#: Cells that one task rakes; more are dealt out anew for each axis.
ONE_TASK_CELLS = 1_000_000
#: Targets are the present shares to this power, made to sum to one: small groups gain, large ones lose.
TEMPER = 0.7
#: Tokens to keep, as a share of those there are.
BUDGET = 0.6
#: Targets by themselves ask for at most this share of what a group has.
HEADROOM = 0.95
_DRAW = 2**32

#: Topics by rule, the first that matches; fixed values.
TOPICS = (
    ("license", "licen[sc]e|copyright|all rights reserved"),
    ("contact", "[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}|\\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\\b"),
    ("table", "\\|[^|\\n]*\\|"),
    ("web", "https?://|www\\.|click here"),
)


def topic_of(text: Column) -> Column:
    """The first matching rule's topic, else ``prose``; a null text is ``prose``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TOPICS):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def tokens_of(text: Column) -> Column:
    """Words parted by ASCII white space, by counting their first letters: no array is built."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def draw_of(doc_id: Column) -> Column:
    """A fixed pseudo-random number below 2**32 for an id, from the MD5 of its text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, docs) from rows that have those axes and ``n_tokens``."""
    return docs.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def _round(cur: DataFrame) -> DataFrame:
    for axis in AXES:
        total = F.sum("fit").over(Window.partitionBy(axis))
        cur = cur.withColumn("fit", F.when(total > 0, F.least("cap", F.col("fit") * F.col(f"target_{axis}") / total)).otherwise(F.lit(0.0)))
    return cur


def shortfalls(fitted: DataFrame, least: float = 0.0) -> DataFrame:
    """(axis, value, target, fitted) of raked cells whose sums miss their targets by more than ``least``."""
    parts = [fitted.groupBy(F.lit(axis).alias("axis"), F.col(axis).alias("value"), F.col(f"target_{axis}").alias("target")).agg(F.sum("fit").alias("fitted")) for axis in AXES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.abs(F.col("target") - F.col("fitted")) > least)


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, rounds: int = ROUNDS, most_tests: int = MOST_TESTS) -> DataFrame:
    """Cells with ``fit``, their share of the mixture, at most ``cap``: what keeping the whole cell would give.

    ``targets[axis]`` has columns (axis, target); values without a target get
    none of the mixture.  Cells without tokens stay at zero.  Ends where every
    axis' sums are within TOLERANCE of its targets, or after ``most_tests`` times
    ``rounds`` rounds; ``shortfalls`` of the result tells what can't be met.
    """
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    cur = cells.withColumn("fit", F.col("tokens") / F.lit(whole)).withColumn("cap", F.col("tokens") / F.lit(whole * budget))
    for axis in AXES:
        cur = cur.join(targets[axis].select(axis, F.col("target").alias(f"target_{axis}")), axis, "left").fillna(0.0, [f"target_{axis}"])
    small = cells.count() <= ONE_TASK_CELLS
    cur = staged(cur.coalesce(1) if small else cur, "cells")
    for _ in range(most_tests):
        nxt = cur.coalesce(1) if small else cur
        for _ in range(rounds):
            nxt = _round(nxt)
        last, cur = cur, staged(nxt, "cells")
        unstaged(last)
        if not shortfalls(cur, TOLERANCE).limit(1).count():
            break
    return cur


def tempered(cells: DataFrame, axis: str, temper: float = TEMPER, budget: float = BUDGET) -> DataFrame:
    """Target shares of an axis: present token shares to a power, made to sum to one, and none beyond HEADROOM of what there is.

    Values in order of how far they would go beyond it are held there one by one,
    and the rest share what is left.
    """
    sums = cells.groupBy(axis).agg(F.sum("tokens").alias("t")).withColumn("p", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(temper))).otherwise(F.lit(0.0)))
    got = sums.agg(F.sum("p").alias("p"), F.sum("t").alias("t")).first()
    power, whole = float(got["p"] or 0) or 1.0, float(got["t"] or 0) or 1.0
    before = Window.orderBy(F.desc_nulls_last(F.try_divide(F.col("p"), F.col("t"))), axis).rowsBetween(Window.unboundedPreceding, -1)  # an axis' values, in one task
    held = sums.withColumn("cap", F.col("t") * F.lit(HEADROOM / (whole * budget)))
    rest = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0.0))
    held = held.withColumn("full", (F.col("t") > 0) & (F.col("p") * (1 - rest("cap", before)) >= F.col("cap") * (F.lit(power) - rest("p", before))))
    every = Window.partitionBy()
    left = (1 - rest(F.when(F.col("full"), F.col("cap")), every)) / (F.lit(power) - rest(F.when(F.col("full"), F.col("p")), every))
    return held.select(axis, F.when(F.col("full"), F.col("cap")).otherwise(F.col("p") * left).alias("target"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with source, lang, topic, n_tokens, probability (9 decimals), ``kept``, and text_key (a hash of the text).

    Null sources, languages and topics are groups of their own, named by the
    empty text; null texts have no tokens.  A cell whose documents have no
    tokens at all is kept whole (probability 1): it takes nothing of the budget.
    Draws depend on doc_id alone, so equal ids in a cell are kept or dropped
    together.  Columns of ``docs`` with other names are ignored; no rows give
    no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(topic_of(text) if topic is None else topic, F.lit("")).alias("topic"), tokens_of(text).alias("n_tokens"), F.xxhash64(text).alias("text_key"),
    )
    rows = staged(rows, "tokens")  # a few bytes a document; the texts are not read again
    cells = staged(cells_of(rows), "cells")
    targets = targets or {axis: tempered(cells, axis, budget=budget) for axis in AXES}
    fitted = rake(cells, targets, budget)
    probability = fitted.select(*AXES, F.round(F.when(F.col("tokens") > 0, F.col("fit") / F.col("cap")).otherwise(F.lit(1.0)), 9).alias("probability"))
    return rows.join(probability, list(AXES), "left").select(
        "doc_id", *AXES, "n_tokens", "probability", (draw_of(F.col("doc_id")) < F.col("probability") * F.lit(float(_DRAW))).alias("kept"), "text_key"
    )


def oracle_sql(rounds: int = ROUNDS, most_tests: int = MOST_TESTS, budget: float = BUDGET, temper: float = TEMPER) -> str:
    """DuckDB SQL with the same result over ``documents``: each step of the recursion is the rounds up to the next test."""
    topic = "CASE " + " ".join("WHEN regexp_matches(lower(coalesce(text, '')), '" + p + f"') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    steps = [
        f"r AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, "
        "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL)",
        "w AS MATERIALIZED (SELECT coalesce(nullif(sum(tokens), 0), 1)::DOUBLE AS whole FROM c)",
    ]
    for a in AXES:
        steps.append(f"p_{a} AS (SELECT {a}, sum(tokens) AS t, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, {temper}) ELSE 0 END AS p FROM c GROUP BY {a})")
        steps.append(f"h_{a} AS (SELECT {a}, t, p, t * ({HEADROOM} / (whole * {budget})) AS cap, (SELECT sum(p) FROM p_{a}) AS power FROM p_{a}, w)")
        before = f"OVER (ORDER BY p / nullif(t, 0) DESC NULLS LAST, {a} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        steps.append(f"g_{a} AS (SELECT *, t > 0 AND p * (1 - coalesce(sum(cap) {before}, 0)) >= cap * (power - coalesce(sum(p) {before}, 0)) AS held FROM h_{a})")
        left = "(1 - coalesce(sum(CASE WHEN held THEN cap END) OVER (), 0)) / (power - coalesce(sum(CASE WHEN held THEN p END) OVER (), 0))"
        steps.append(f"t_{a} AS MATERIALIZED (SELECT {a}, CASE WHEN held THEN cap ELSE p * {left} END AS target_{a} FROM g_{a})")
    names = "source, lang, topic, tokens, cap, target_source, target_lang, target_topic"
    block = "x"
    for n in range(rounds * len(AXES)):
        a = AXES[n % len(AXES)]
        inner = block if block == "x" else f"({block}) y{n}"
        block = f"SELECT turn, {names}, CASE WHEN sum(fit) OVER (PARTITION BY {a}) > 0 THEN least(cap, fit * target_{a} / sum(fit) OVER (PARTITION BY {a})) ELSE 0 END AS fit FROM {inner}"
    errors = ", ".join(f"abs(target_{a} - sum(fit) OVER (PARTITION BY {a})) AS e_{a}" for a in AXES)
    tested = f"SELECT *, max(greatest({', '.join(f'e_{a}' for a in AXES)})) OVER () AS err FROM (SELECT *, {errors} FROM ({block}) z) e"
    first = "SELECT 0 AS turn, c.*, tokens / (whole * " + str(budget) + ") AS cap, target_source, target_lang, target_topic, tokens / whole AS fit, 1e0 AS err FROM c, w JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)"
    first = first.replace("FROM c, w JOIN", "FROM c CROSS JOIN w JOIN")
    steps.append(f"f AS (SELECT turn, {names}, fit, err FROM ({first}) s UNION ALL SELECT turn + 1, {names}, fit, err FROM ({tested.replace('FROM x', 'FROM f WHERE err > ' + str(TOLERANCE) + f' AND turn < {most_tests}')}) g)")
    steps.append("q AS MATERIALIZED (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN fit / cap ELSE 1.0 END, 9) AS probability FROM f WHERE turn = (SELECT max(turn) FROM f))")
    return (
        "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, n_tokens, probability, "
        f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT < probability * {float(_DRAW)} AS kept FROM r JOIN q USING (source, lang, topic)"
    )
