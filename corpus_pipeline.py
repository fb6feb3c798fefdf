"""A corpus pipeline over ``documents``: each stage is one operator of
``prefscope.llm`` applied to all that the stage before kept, written as
Parquet and read again. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefscope.llm import exact_dedup, langid, mixing, ngram_join, piece_codec
from prefscope.llm.shared import written

#: A text is rejected when no learned language reaches this mean probability.
MIN_LANGUAGE_SCORE = 0.4
#: Near duplicates share 80 % of their shingles of five words.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is in a language that the network
    knows; it learns from the documents themselves."""
    return langid.accepted(docs, MIN_LANGUAGE_SCORE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.unique_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram links connect: the one whose
    doc_id is the group's component_id."""
    return ngram_join.one_of_each(docs, NEAR_PERCENT, NEAR_SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document that the mix takes
    twice is there twice."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every row of the mix."""
    return piece_codec.encode_documents(docs).select("doc_id", "n_pieces", "piece_ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_join", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the network nor the segmentation;
#: tests/llm/test_pipeline.py holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written output of the last."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
