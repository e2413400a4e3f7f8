"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import ann, bpe, line_dedup, lm, mixing, sharding, simhash, token_counts, toxicity, vector_dedup
from pagemill.llm._common import id_crc, read_table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(read_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm.held_out(folds=10)
    deleted = F.pmod(id_crc("doc_id"), F.lit(10)) == 1
    docs = read_table(spark, sf_dir, "documents")
    got = lm.score_documents(docs, ~held_out, deleted)
    return got.select("doc_id", lm.held_out(folds=10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.encode_documents(read_table(spark, sf_dir, "documents"), f.read())


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.sentencepiece_pieces(vocabulary("piece_bpe_32k.model"))
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), pieces)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("text_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_nearest": op2_nearest,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_lm": op5_lm,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op10_mixing": mixing.oracle_sql()}
