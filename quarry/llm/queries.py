"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import learned_partitions, lm_scoring, mixing, mtree, order_minhash, quality_knn, sentencepiece_fst, suffix_dedup, token_files, tool_calls
from .common import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference to the documents labelled good."""
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), lm_scoring.targets(table(spark, sf_dir, "labels")))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows found for every 50th vector."""
    e = table(spark, sf_dir, "embeddings")
    return learned_partitions.search(e, e.filter("vec_id % 50 = 0"))


def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products for every 50th vector."""
    e = table(spark, sf_dir, "embeddings")
    return mtree.search(e, e.filter("vec_id % 50 = 0"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a 400-byte string goes; lengths and digest of what is left."""
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), 400, "none"))


def op6_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what decoding makes of them, as a digest."""
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"), digest=True)


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by votes of labelled ones."""
    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call, with its answer, place, checks and canonical JSON."""
    return tool_calls.link(*tool_calls.chat_calls(table(spark, sf_dir, "conversations")), tool_calls.CHAT_SCHEMAS)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the id files, read them back."""
    import public_tokenizers

    folder = f"{Scratch(spark, 'tokens').path}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder, digest=True)


def queries() -> dict[str, Query]:
    ops = (
        op1_lm_scoring, op2_learned_partitions, op3_mtree, op4_order_minhash, op5_suffix_dedup, op6_sentencepiece_fst,
        op7_quality_knn, op8_tool_calls, op9_mixing, op10_token_files,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_mtree": mtree.SQL, "op8_tool_calls": tool_calls.SQL, "op9_mixing": mixing.SQL}
