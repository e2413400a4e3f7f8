"""From raw documents to an encoded training corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet and read again before the next one.  All but the last
return the columns of their input.

Null texts pass all stages as texts without words: they are not toxic, have no
lines, are near-duplicates of each other and of empty texts, have no tokens, and
encode as empty.  A null id is a value like others, larger than all in choosing
which near-duplicate stays.  Rows of one id with different texts are decided
apart; of rows that repeat id and text one stays.  Empty tables and extra
columns are fine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, line_dedup, mixing, simhash, toxicity
from pagemill.llm._common import read_table, staged
from pagemill.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _without(docs: DataFrame, out: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` that agree with none of ``out`` in id, text_key and ``by``, nulls being equal."""
    key = {"id_": F.col("doc_id").cast("long"), "text_key": F.xxhash64("text"), **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by}}
    ours = docs.select(F.struct("*").alias("row"), *(v.alias(f"k_{c}") for c, v in key.items()))
    theirs = out.select(F.col("doc_id").cast("long").alias("c_id_"), "text_key", *by).distinct()
    same = F.col("k_id_").eqNullSafe(F.col("c_id_"))
    for c in ("text_key", *by):
        same &= F.col(f"k_{c}") == F.col(c)
    return ours.join(theirs, same, "left_anti").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id; of rows that repeat it in id and text, one."""
    marks = staged(simhash.near_duplicates(docs).select("doc_id", "text_key", "kept"), "marks")
    left = _without(docs, marks.where(~F.col("kept")), ())
    again = marks.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if again else left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics."""
    return _without(docs, mixing.mix(docs).where(~F.col("kept")), ("source", "lang"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.encode_documents(docs, f.read())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
