"""The registered queries: each applies one operator, with its production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscope.llm import (brown_lm, conversation_trie, exact_dedup, langid, license_scan, mixing,
                           ngram_join, phrase_index, piece_codec, quality, sharding, substring_dedup,
                           vector_forest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes, equal texts together."""
    return sharding.shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per document and per host; a document's source is its host."""
    return quality.judge(documents(spark, sf_dir)).drop("host_rate")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the scan as texts, with commas between."""
    return license_scan.scan(documents(spark, sf_dir)).select(
        "doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses", "unresolved")])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text."""
    return piece_codec.encode_documents(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return phrase_index.collocations(documents(spark, sf_dir))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return vector_forest.nearest(vectors, vectors.where(F.col("vec_id") % vector_forest.EVERY == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_exact_dedup, op3_quality_rules, op4_lm_scoring, op5_language_id, op6_mixing,
        op7_license_scan, op8_sentencepiece, op9_substring_dedup, op10_ngram_join, op11_conversation_trie,
        op12_collocations, op13_nearest)
}
