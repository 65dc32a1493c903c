"""CSV sinks: a result with a header, and metric rows that are appended."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary one; any other raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}"


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Writes a directory of CSV with headers. one_file suits small results only, as it makes one task write."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)
