"""Scan queries over streams of files: the same plan, run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from colsieve.operators.scan import ScanQuery


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_scan(stream: DataFrame, query: ScanQuery) -> tuple[DataFrame, str]:
    """The query's plan and its output mode: rows are appended, aggregates are given anew after each batch."""
    return query.run(stream), "complete" if query.aggs else "append"
