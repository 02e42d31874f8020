"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing of sources, packing into sequences.

Each stage works on all that the one before kept, written as Parquet and read again; all but the last return the
columns of documents. Labels are read from the table beside the documents. An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import mixing, packing, quality, similar, suffixes, tokens
from pathloom.llm.common import Scratch, collected, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality.kept_documents(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that is linked by similarities of 0.8 or more of five-word shingle sets."""
    return similar.first_of_each(spark, docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 400 bytes and more that also start elsewhere."""
    return suffixes.without_passages(spark, docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources to their target weights; a document taken more than once comes once for each pass."""
    return mixing.mix_documents(spark, docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.packed(spark, docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: Learned rules, suffix sorting and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents. Every result is written and read again; then the stage's own tables and the result before it go. Nothing of any other run is touched."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with collected() as made:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
        for own in made:
            own.drop()
    return docs
