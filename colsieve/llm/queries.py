"""The opN queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exactdedup, langid, lattice, minhash, mixing, sharding, substring, toxicity, urlfilter
from .common import table
from .oracles import ORACLE_SQL


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, and decoded from its ids; digests of both."""
    out = bpe.tokenize(table(spark, sf_dir, "documents"), bpe.default_vocabulary(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on 2-word shingles at Jaccard 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes, equal texts together."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to weights 5, 2, 1 by source, at most three epochs."""
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "times", "extra")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of documents: half of them as a snapshot, the other half as a new batch."""
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller doc_id has too, removed from documents."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=50)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, from the labelled ones."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of embeddings at cosine 0.95 and their components."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    return langid.predict(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, else by segmented words and naive Bayes."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    "op6_url_filter": op6_url_filter,
    "op1_toxicity": op1_toxicity,
    "op5_lattice_near_dedup": op5_lattice_near_dedup,
    "op10_language_id": op10_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op7_mixing": op7_mixing,
    "op4_sharding": op4_sharding,
    "op2_bpe": op2_bpe,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
