"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, BPE encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next. All stages but the last return the columns of documents; extra columns, whatever
their names, pass through unread. Empty tables stay empty. ``run`` applies the stages to the documents table. SQL can't express
the trained and hashed stages, so ORACLE_SQL is None; ``tests/llm/test_pipeline.py`` compares ``run`` with plain Python code for all
five stages and the tokenizers library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.llm import bpe, exactdedup, minhash, mixing, toxicity
from colsieve.llm.common import table, written

ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't reject.

    Null, empty and blank texts stay; repeated rows are judged alike; a null doc_id is judged as any other; a text of any length is
    judged as a whole. Without labels of both kinds all documents stay.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id.

    Null counts as the empty text; a null doc_id is the smallest; of repeated rows one stays.
    """
    return exactdedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component on five-word shingles at 0.8, the one with the smallest doc_id.

    Texts without words link with nothing and stay, as do rows with a null doc_id. Rows with one doc_id and different texts are one
    document, which stays or goes as a whole.
    """
    return minhash.deduplicated(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and sampled to source weights 5, 2, 1, at most three epochs.

    A null source is a source of its own; texts without words count nothing and come as often as their source is taken whole; a
    document at the edge of its source's target comes with its first words only.
    """
    return mixing.mixed(docs, weights=(5, 2, 1), epochs=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the text's digest after decoding; a null text counts as empty, rows are independent."""
    out = bpe.tokenize(docs, bpe.default_vocabulary(), decode=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
