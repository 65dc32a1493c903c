"""Workload characterisation: how selective scans are, and how much is read in proportion to the data's size.

Both take any table of executed scans; column names are parameters. Each is aggregations and one equi-join on the
warehouse key, the aggregated side a row per warehouse, so AQE may broadcast it when it is small and splits a skewed
key when it isn't.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the selectivity ladder on l_extendedprice; a number is the percent of rows kept.
LADDER = {"best": 200000.0, "real": 100000.0, "10": 94707.33, "25": 79193.03, "50": 53026.66, "75": 26875.71, "worst": 0.0}


@dataclass(frozen=True)
class Scans:
    """Names of the columns: warehouse key, bytes and files scanned, files there were."""

    key: str
    bytes: str
    files: str
    original_files: str

    def size_estimates(self, df: DataFrame) -> DataFrame:
        """(key, size): the largest estimate of a warehouse's size, bytes a file times the files there were."""
        estimate = F.nullif(F.col(self.files).cast("double"), F.lit(0.0))
        return df.groupBy(self.key).agg(F.max(F.col(self.bytes) / estimate * F.col(self.original_files)).alias("size"))


def selectivity_ratio(df: DataFrame, scans: Scans) -> DataFrame:
    """Each scan with the share of its warehouse's estimated size that it read; null unless the size is positive."""
    ratio = F.when(F.col("size") > 0, F.col(scans.bytes) / F.col("size"))
    return df.join(scans.size_estimates(df), scans.key).select(scans.key, scans.bytes, "size", ratio.alias("ratio"))


def selectivity_distribution(df: DataFrame, scans: Scans) -> DataFrame:
    """(selectivity_bucket, query_count, query_percentage): scans by rounded-up percent, at most 100; null ratios count as 100."""
    bucket = F.least(F.ceil(F.col("ratio") * 100).cast("double"), F.lit(100.0))
    counts = selectivity_ratio(df, scans).select(bucket.alias("selectivity_bucket")).groupBy("selectivity_bucket").agg(F.count("*").alias("query_count"))
    return share_of_total(counts, "query_count", "query_percentage").orderBy(F.asc_nulls_last("selectivity_bucket"))


def share_of_total(counts: DataFrame, column: str, alias: str) -> DataFrame:
    """counts with each row's percent of the column's total: a cross join with one row."""
    total = counts.agg(F.sum(column).alias("_total"))
    percent: Column = F.col(column).cast("double") * 100.0 / F.col("_total")
    return counts.crossJoin(total).select(*counts.columns, percent.alias(alias))


def retrieval_rate(df: DataFrame, scans: Scans, days: float = 14) -> DataFrame:
    """(weighted_avg_read_per_size, total_size): bytes read in a month for each byte of size, weighted by size.

    The trace covers ``days``; warehouses of size 0 or of unknown size have no rate and don't count in the average's numerator.
    """
    sized = df.join(scans.size_estimates(df), scans.key)
    rate = sized.groupBy(scans.key, "size").agg((F.sum(scans.bytes) / F.nullif(F.col("size"), F.lit(0.0))).alias("rate"))
    month = F.sum(F.col("rate") * F.col("size")) / F.sum("size") / days * 365 / 12
    return rate.agg(month.alias("weighted_avg_read_per_size"), F.sum("size").alias("total_size"))


def ladder(df: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """(share, threshold): for each share of rows, from 0 to 1, the value that this share of the column's values is above.

    Exact and interpolated; nulls and NaN don't count. Values are counted before they are sorted, so what one task
    sorts are the distinct values; for columns with very many of them see ``percentile_approx``.
    """
    counts = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    at = F.expr(f"percentile(v, array({', '.join(str(1 - s) for s in shares)}), n)")
    pairs = counts.agg(at.alias("at")).select(F.explode(F.arrays_zip(F.array(*map(F.lit, map(float, shares))).alias("share"), F.col("at"))).alias("p"))
    return pairs.select(F.col("p.share").alias("share"), F.col("p.at").alias("threshold"))
