"""The numbered queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictpast.llm import (
    centroids,
    chat_snapshots,
    decontaminate,
    embedding_dedup,
    language_mixture,
    line_dedup,
    minhash_dedup,
    mixing,
    sentencepiece_codec,
    suffix_dedup,
    token_counts,
    token_files,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path(BYTE_BPE))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into seekable token files and back."""
    docs = table(spark, sf_dir, "documents")
    folder = token_files.new_folder(spark)
    index = token_files.write_token_files(docs, public_tokenizers.path(BYTE_BPE), folder, END_ID)
    read = token_files.read_token_files(token_files.with_starts(index), folder)
    return token_files.with_crc32(read)


@query
def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    held = language_mixture.held_out()
    model = language_mixture.fit(docs.where(~held))
    judged = language_mixture.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    turns = table(spark, sf_dir, "conversations")
    return chat_snapshots.render(turns, chat_snapshots.collapse_snapshots(turns))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.digest_documents(docs, public_tokenizers.path(PIECE_BPE))


@query
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    docs = table(spark, sf_dir, "documents")
    return minhash_dedup.near_duplicates(docs, words=3, percent=85)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of two lines and repeated lines of fifty words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, alone=50)


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that documents share."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four leading components of their grid vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source; those labelled good come first, those labelled bad last."""
    labels = table(spark, sf_dir, "labels")
    quality = labels.select("doc_id", F.when(F.col("quality") > 0, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))
    return mixing.mix_sources(table(spark, sf_dir, "documents"), quality=quality)


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters after ten rounds."""
    clusters, centres = centroids.fit_clusters(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(clusters, centres)
