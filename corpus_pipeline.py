"""Corpus pipeline: the stages that turn raw documents into token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import decontaminate, line_dedup, ngram_join, quality_rules, sentence_pieces
from tidewire.llm.common import documents
from tidewire.session import materialize

#: Words of a shingle and similarity, per cent, of the near-copy stage (op7's query has its own).
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go, and documents that have no word left."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id stays."""
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, and a digest of what they decode to."""
    return sentence_pieces.encode(docs, sentence_pieces.model_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", benchmark), ("sentencepiece", pieces)]

#: The SentencePiece and risk-control stages have no SQL form.  tests/llm holds each operator
#: against a brute-force version; one of the whole pipeline is still to be written.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
