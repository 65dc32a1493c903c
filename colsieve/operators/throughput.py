"""Throughput of scan queries: how fast they run over what they read, and over what they would have to read without pruning."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.sources.footers import footer_stats

from .ranges import scan_report
from .scan import ScanQuery

SCHEMA = "query string, seconds double, queries_per_second double, file_bytes long, planned_bytes long, gb_per_second double, logical_gb_per_second double, selectivity double"


def throughput_report(spark: SparkSession, path: str, queries: Mapping[str, ScanQuery], runs: int = 1) -> DataFrame:
    """One row for each query: mean seconds of ``runs`` runs, planned bytes and all bytes a second, and their ratio.

    Queries run one after the other; each is executed whole, its rows are dropped. Bytes are those of ``scan_report``.
    """
    stats, rows = footer_stats(spark, path).persist(), []
    try:
        for name, query in queries.items():
            df = spark.read.parquet(path)
            began = time.perf_counter()
            for _ in range(runs):
                query.run(df).write.format("noop").mode("overwrite").save()
            seconds = (time.perf_counter() - began) / runs
            size = scan_report(stats, query.expression(df)).agg(F.sum("file_size").alias("all"), F.sum("planned_bytes").alias("planned")).first()
            rows.append((name, seconds, 1 / seconds, size["all"], size["planned"], size["planned"] / seconds / 1e9, size["all"] / seconds / 1e9, size["planned"] / size["all"]))
    finally:
        stats.unpersist()
    return spark.createDataFrame(rows, SCHEMA)
