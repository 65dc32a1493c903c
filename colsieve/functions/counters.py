"""Rates from cumulative host counters: the change between consecutive samples of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def delta(column: str, order: list[str], by: list[str] | None = None) -> Column:
    """A column's change since the sample before; null for the first.

    by: the series' keys. Without them all rows are one series, and one task sorts it: meant for the samples of one host.
    """
    w = W.partitionBy(*(by or [])).orderBy(*order)
    return F.col(column) - F.lag(column).over(w)


def counter_deltas(df: DataFrame, columns: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with ``d_<column>`` for each of the columns."""
    return df.withColumns({f"d_{c}": delta(c, order, by) for c in columns})


def host_utilisation(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """CPU percent (times cores), disk percent and network MiB/s from (time, cpu_total, cpu_idle, io_ms, rx_bytes, tx_bytes, cores).

    The first sample of a series is dropped. Without a change of cpu_total CPU is 0; without elapsed time the other rates are 0.
    """
    d = counter_deltas(samples, ["time", "cpu_total", "cpu_idle", "io_ms", "rx_bytes", "tx_bytes"], ["time"], by).where("d_time is not null")
    busy = F.when(F.col("d_cpu_total") != 0, 100 * (F.col("d_cpu_total") - F.col("d_cpu_idle")) / F.col("d_cpu_total") * F.col("cores")).otherwise(0.0)
    rate = lambda x: F.when(F.col("d_time") > 0, x).otherwise(0.0)
    return d.select(
        *(by or []),
        "time",
        busy.alias("cpu_percent"),
        rate(F.col("d_io_ms") / (F.col("d_time") * 1000) * 100).alias("disk_percent"),
        rate(F.col("d_rx_bytes") / (F.col("d_time") * 1024 * 1024)).alias("rx_mib_s"),
        rate(F.col("d_tx_bytes") / (F.col("d_time") * 1024 * 1024)).alias("tx_mib_s"),
    )
