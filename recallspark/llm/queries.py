"""Queries ``opN_<name>`` over the whole tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, cover_tree, exact_dedup, fingerprints, hard_negatives, hmm, language_id, license_scan, mixing, near_dedup, periodic_runs, pii, sharding
from .common import documents, held_out
from .oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]


def vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary.from_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), vocabulary())


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(documents(spark, sf_dir).withColumn("held_out", held_out(7, 2)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    done = language_id.identify(docs, model).withColumn("held_out", held_out(4, 2))
    return done.select("doc_id", "held_out", "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "source", "tokens", "pass", "block")


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of op11's documents: of each tenth document, by crc32 of its id,
    the words from some place on repeat the first of them. A null id is the empty
    text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    return np.concatenate([np.arange(at), at + np.arange(n - at) % period])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summarised(periodic_runs.periodic_runs(documents(spark, sf_dir), repeated_words))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_cover_tree, op3_sharding, op4_byte_bpe, op5_minhash_near_dedup, op6_license_scan, op7_hmm_scoring, op8_fingerprints, op9_language_id, op10_mixing, op11_periodic_runs, op12_hard_negatives, op13_exact_dedup, pipeline)}
