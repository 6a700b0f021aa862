"""The cleaning pipeline over ``documents``: each stage is written as Parquet and reread."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strictpast.llm import decontaminate, language_mixture, line_dedup, minhash_dedup, sentencepiece_codec
from strictpast.session import stage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a determined language go."""
    return language_mixture.kept_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of runs of lines and of lines of fifty words go, and documents that consist of them."""
    return line_dedup.deduplicated_lines(docs, alone=50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return minhash_dedup.one_of_each_group(docs, words=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of what is left and the texts they decode to."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", pieces),
]

#: SQL expresses neither mixtures nor MinHash nor merges: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what the last one returns is not written yet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
