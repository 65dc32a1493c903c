"""Byte-range planning: what a reader of the surviving row groups would fetch, adjacent ranges merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .predicate import Expr
from .pruning import prune


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """(file, offset, length) with overlapping and adjacent ranges of a file merged: gaps and islands."""
    order = W.partitionBy("file").orderBy("offset", "length")
    before = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("offset") > before), 1).otherwise(0)
    islands = ranges.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = islands.groupBy("file", "island").agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return out.select("file", "offset", (F.col("end") - F.col("offset")).alias("length"))


def byte_ranges(stats: DataFrame, expr: Expr | None, columns: list[str] | None = None) -> DataFrame:
    """The merged ranges of all chunks (or of some columns' chunks) of the surviving row groups, and of the footers."""
    kept = stats.join(prune(stats, expr).where("keep"), ["file", "row_group"], "left_semi")
    if columns is not None:
        kept = kept.where(F.col("col_name").isin(columns))
    chunks = kept.select("file", F.col("chunk_offset").alias("offset"), F.col("chunk_length").alias("length"))
    footers = stats.select("file", F.col("footer_offset").alias("offset"), F.col("footer_length").alias("length")).distinct()
    return merge_ranges(chunks.unionByName(footers))


def scan_report(stats: DataFrame, expr: Expr | None) -> DataFrame:
    """For each file: groups and rows in all and kept, bytes in all and planned, and their ratio."""
    groups = stats.select("file", "file_name", "file_size", "row_group", "num_rows").distinct().join(prune(stats, expr), ["file", "row_group"])
    kept = F.col("keep").cast("int")
    files = groups.groupBy("file", "file_name", "file_size").agg(
        F.count("*").alias("row_groups"), F.sum(kept).alias("row_groups_kept"), F.sum("num_rows").alias("num_rows"), F.sum(kept * F.col("num_rows")).alias("num_rows_kept")
    )
    planned = byte_ranges(stats, expr).groupBy("file").agg(F.sum("length").alias("planned_bytes"))
    return files.join(planned, "file").withColumn("selectivity", F.col("planned_bytes") / F.col("file_size"))
