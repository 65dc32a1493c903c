"""Command line: one scan query over a directory or glob of Parquet files.

    python -m colsieve -p DIR --column l_extendedprice -w 50 --agg 'SUM(l_extendedprice)'
    python -m colsieve -p DIR --where 'a > 1 AND b <= 2.0' -cc 3
    python -m colsieve -p DIR --where 'a > 1' --report
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from colsieve.operators import predicate, ranges
from colsieve.operators.scan import ScanQuery
from colsieve.plans.workloads import LADDER
from colsieve.sources.footers import footer_stats


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="colsieve", description="Scan, prune and aggregate Parquet files.")
    p.add_argument("-p", "--path", required=True)
    p.add_argument("--where", help="predicate text")
    p.add_argument("-w", "--workload", choices=sorted(LADDER), help="a threshold of the ladder instead of --where")
    p.add_argument("--column", help="column of the workload's threshold")
    p.add_argument("-cc", "--columns", type=int, help="how many leading columns to return")
    p.add_argument("--agg", action="append", default=[], help="OP(column); may be repeated")
    p.add_argument("--per-file", action="store_true")
    p.add_argument("--report", action="store_true", help="row groups and bytes that the query would read, by file")
    a = p.parse_args(args)
    if (a.workload is None) != (a.column is None) or (a.workload and a.where):
        p.error("--workload needs --column and excludes --where")
    where = f"{a.column} > {LADDER[a.workload]!r}" if a.workload else a.where
    spark = SparkSession.builder.appName("colsieve").getOrCreate()
    if a.report:
        ranges.scan_report(footer_stats(spark, a.path), predicate.parse(where) if where else None).show(1000, False)
        return
    query = ScanQuery(where=where, first_n=a.columns, aggs=tuple(a.agg), scope="file" if a.per_file else "dataset")
    query.run(spark.read.parquet(a.path)).show(1000, False)


if __name__ == "__main__":
    main()
