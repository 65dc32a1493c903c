"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.functions.counters import counter_deltas, host_utilisation
from colsieve.operators import predicate, pruning, ranges
from colsieve.operators.scan import ScanQuery
from colsieve.operators.throughput import throughput_report
from colsieve.plans import workloads
from colsieve.sources.footers import footer_stats
from colsieve.sources.sinks import shared_dir, write_csv

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LINEITEM = workloads.Scans("l_suppkey", "l_extendedprice", "l_quantity", "l_linenumber")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scan(name: str, table: str, sql: str | None, **query) -> None:
    """Registers a ScanQuery over one table."""
    QUERIES[name] = lambda spark, sf_dir: ScanQuery(**query).run(_table(spark, sf_dir, table))
    if sql:
        ORACLE_SQL[name] = sql


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _sql_aggs(column: str) -> str:
    return f"coalesce(sum({column}), 0.0) AS sum_{column}, avg({column}) AS avg_{column}, min({column}) AS min_{column}, max({column}) AS max_{column}, count({column}) AS count_{column}"


FIVE = tuple(f"{op}(l_extendedprice)" for op in ("SUM", "AVG", "MIN", "MAX", "COUNT"))


def _rounded(name: str, threshold: float) -> None:
    """The flagship: one threshold, five aggregates in one pass; sums rounded, as their order is free."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ScanQuery(where=f"l_extendedprice > {threshold!r}", aggs=FIVE).run(_table(spark, sf_dir, "lineitem"))
        return out.withColumns({c: F.round(c, 4) for c in ("sum_l_extendedprice", "avg_l_extendedprice")})

    QUERIES[name] = run
    ORACLE_SQL[name] = f"""
        SELECT round(coalesce(sum(l_extendedprice), 0.0), 4) AS sum_l_extendedprice, round(avg(l_extendedprice), 4) AS avg_l_extendedprice,
          min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice, count(l_extendedprice) AS count_l_extendedprice
        FROM lineitem WHERE l_extendedprice > CAST({threshold!r} AS DOUBLE)"""


_rounded("q_flagship", 50000.0)
for _name, _threshold in workloads.LADDER.items():
    _rounded(f"q_workload_{_name}", _threshold)

_scan("q_scan_project", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0", columns=("o_totalprice", "o_orderkey"), where="o_totalprice > 100000.0")
_scan("q_late_project", "orders", "SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice <= 50000.0 AND o_orderkey > 100", columns=("o_orderstatus", "o_custkey"), where="o_totalprice <= 50000.0 AND o_orderkey > 100")
_scan("q_first_n_columns", "orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders", first_n=3)

_KEYS = ("l_orderkey", "l_linenumber", "l_quantity")
for _name, _op in (("lt", "<"), ("le", "<="), ("eq", "=="), ("ge", ">="), ("gt", ">")):
    _scan(f"q_filter_{_name}", "lineitem", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op.replace('==', '=')} 25.0", columns=_KEYS, where=f"l_quantity {_op} 25.0")
_scan("q_filter_int", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber >= 3", columns=_KEYS, where="l_linenumber >= 3")
_scan("q_filter_float", "lineitem", "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount > 0.05", columns=("l_orderkey", "l_discount"), where="l_discount > 0.05")
_scan("q_filter_string", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", columns=("o_orderkey", "o_orderstatus"), where="o_orderstatus == F")
_scan("q_filter_datetime", "events", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00'", columns=("event_id", "user_id"), where="ts >= 2024-01-02-00:00:00")
_scan("q_filter_and", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40.0 AND l_returnflag = 'A'", columns=("l_orderkey", "l_linenumber"), where="l_quantity > 40.0 AND l_returnflag == A")
_scan("q_filter_or", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49.0 OR l_returnflag = 'R'", columns=("l_orderkey", "l_linenumber"), where="l_quantity > 49.0 OR l_returnflag == R")
_scan("q_filter_not", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 10.0 OR l_linenumber <= 2)", columns=("l_orderkey", "l_linenumber"), where="NOT (l_quantity > 10.0 OR l_linenumber <= 2)")
_scan(
    "q_filter_precedence", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49.0 OR (l_linenumber < 3 AND NOT l_returnflag = 'N')",
    columns=("l_orderkey", "l_linenumber"), where="l_quantity > 49.0 OR l_linenumber < 3 AND NOT l_returnflag == N",
)
_scan("q_filter_by_index", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 2", columns=("l_orderkey", "l_linenumber"), where="3 == 2", by_index=True)


@_query("SELECT doc_id, quality = 1 AS good FROM labels WHERE quality = 1")
def q_filter_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return ScanQuery(where="good == true").run(flags)


@_query("SELECT l_orderkey, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01'")
def q_filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship_date"))
    return ScanQuery(where="ship_date >= 1996-01-01-00:00:00").run(dates)


def _nulls(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.nullif("l_linenumber", F.lit(3)).alias("line"))
    return ScanQuery(where="line < 2 OR l_quantity > 20.0", aggs=("COUNT(l_orderkey)", "COUNT(line)"), strict_nulls=strict).run(df)


_NULLS_SQL = "SELECT count(l_orderkey) AS count_l_orderkey, count(line) AS count_line FROM (SELECT l_orderkey, l_quantity, nullif(l_linenumber, 3) AS line FROM lineitem) WHERE "


@_query(_NULLS_SQL + "line < 2 OR l_quantity > 20.0")
def q_filter_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nulls(spark, sf_dir, False)


@_query(_NULLS_SQL + "line IS NOT NULL AND l_quantity IS NOT NULL AND (line < 2 OR l_quantity > 20.0)")
def q_filter_nulls_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nulls(spark, sf_dir, True)


_scan("q_agg_sum_int", "lineitem", "SELECT CAST(coalesce(sum(l_orderkey), 0) AS BIGINT) AS sum_l_orderkey, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS sum_l_linenumber FROM lineitem", aggs=("SUM(l_orderkey)", "SUM(l_linenumber)"))
_scan("q_agg_count", "events", "SELECT count(props) AS count_props, count(value) AS count_value FROM events WHERE value > 10.0", aggs=("COUNT(value)",), where="value > 10.0")
_scan("q_agg_minmax_int", "lineitem", "SELECT CAST(min(l_linenumber) AS BIGINT) AS min_l_linenumber, CAST(max(l_linenumber) AS BIGINT) AS max_l_linenumber, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey FROM lineitem", aggs=("MIN(l_linenumber)", "MAX(l_linenumber)", "MIN(l_orderkey)", "MAX(l_orderkey)"))
_scan("q_agg_minmax_float", "orders", "SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders", aggs=("MIN(o_totalprice)", "MAX(o_totalprice)"))
_scan(
    "q_agg_empty", "lineitem", f"SELECT {_sql_aggs('l_quantity')}, CAST(coalesce(sum(l_orderkey), 0) AS BIGINT) AS sum_l_orderkey FROM lineitem WHERE l_quantity < -1.0",
    where="l_quantity < -1.0", aggs=("SUM(l_quantity)", "AVG(l_quantity)", "MIN(l_quantity)", "MAX(l_quantity)", "COUNT(l_quantity)", "SUM(l_orderkey)"),
)
ORACLE_SQL["q_agg_count"] = "SELECT count(value) AS count_value FROM events WHERE value > 10.0"


@_query("SELECT round(coalesce(sum(o_totalprice), 0.0), 2) AS sum_o_totalprice FROM orders")
def q_agg_sum_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ScanQuery(aggs=("SUM(o_totalprice)",)).run(_table(spark, sf_dir, "orders")).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@_query("SELECT round(avg(l_quantity), 6) AS avg_l_quantity, round(avg(l_linenumber), 6) AS avg_l_linenumber FROM lineitem")
def q_agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ScanQuery(aggs=("AVG(l_quantity)", "AVG(l_linenumber)")).run(_table(spark, sf_dir, "lineitem"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@_query(
    """SELECT 'customer.parquet' AS file, CAST(min(c_nationkey) AS BIGINT) AS min_key, CAST(max(c_nationkey) AS BIGINT) AS max_key, count(c_nationkey) AS n FROM customer
    UNION ALL SELECT 'supplier.parquet', CAST(min(s_nationkey) AS BIGINT), CAST(max(s_nationkey) AS BIGINT), count(s_nationkey) FROM supplier
    UNION ALL SELECT 'nation.parquet', CAST(min(n_nationkey) AS BIGINT), CAST(max(n_nationkey) AS BIGINT), count(n_nationkey) FROM nation"""
)
def q_agg_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table is one file here; a table of many files gives a row for each."""
    out = None
    for name, column in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")):
        part = ScanQuery(aggs=(f"MIN({column})", f"MAX({column})", f"COUNT({column})"), scope="file").run(_table(spark, sf_dir, name)).toDF("file", "min_key", "max_key", "n")
        out = part if out is None else out.unionByName(part)
    return out


@_query("SELECT l_suppkey, max(l_extendedprice / nullif(l_quantity, 0) * l_linenumber) AS size FROM lineitem GROUP BY l_suppkey")
def q_group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LINEITEM.size_estimates(_table(spark, sf_dir, "lineitem"))


@_query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def q_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))


_SIZES = "SELECT l_suppkey, max(l_extendedprice / nullif(l_quantity, 0) * l_linenumber) AS size FROM lineitem GROUP BY l_suppkey"


@_query(f"WITH sizes AS ({_SIZES}) SELECT l.l_suppkey, l.l_extendedprice, s.size, CASE WHEN s.size > 0 THEN l.l_extendedprice / s.size ELSE NULL END AS ratio FROM lineitem l JOIN sizes s ON l.l_suppkey = s.l_suppkey")
def q_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workloads.selectivity_ratio(_table(spark, sf_dir, "lineitem"), LINEITEM)


@_query("WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) SELECT s_nationkey, n, n * 100.0::DOUBLE / (SELECT sum(n) FROM c) AS percentage FROM c")
def q_share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return workloads.share_of_total(counts, "n", "percentage")


@_query(
    f"""WITH sizes AS ({_SIZES}), r AS (SELECT CASE WHEN s.size > 0 THEN l.l_extendedprice / s.size ELSE NULL END AS ratio FROM lineitem l JOIN sizes s ON l.l_suppkey = s.l_suppkey),
    c AS (SELECT CAST(least(ceil(ratio * 100), 100) AS DOUBLE) AS selectivity_bucket, count(*) AS query_count FROM r GROUP BY 1)
    SELECT selectivity_bucket, query_count, CAST(query_count AS DOUBLE) * 100.0 / (SELECT sum(query_count) FROM c) AS query_percentage FROM c ORDER BY selectivity_bucket"""
)
def q_selectivity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workloads.selectivity_distribution(_table(spark, sf_dir, "lineitem"), LINEITEM)


@_query(
    f"""WITH sizes AS ({_SIZES}), r AS (SELECT l.l_suppkey, s.size, sum(l.l_extendedprice) / nullif(s.size, 0) AS rate FROM lineitem l JOIN sizes s ON l.l_suppkey = s.l_suppkey GROUP BY l.l_suppkey, s.size)
    SELECT round(sum(rate * size) / sum(size) / 14 * 365 / 12, 6) AS weighted_avg_read_per_size, round(sum(size), 2) AS total_size FROM r"""
)
def q_retrieval_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = workloads.retrieval_rate(_table(spark, sf_dir, "lineitem"), LINEITEM)
    return out.select(F.round("weighted_avg_read_per_size", 6).alias("weighted_avg_read_per_size"), F.round("total_size", 2).alias("total_size"))


@_query(
    """SELECT event_id, user_id, value - lag(value) OVER w AS d_value, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d_micros
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)"""
)
def q_counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    return counter_deltas(events, ["value", "micros"], ["micros", "event_id"], ["user_id"]).select("event_id", "user_id", "d_value", "d_micros")


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    path = f"{shared_dir(spark)}/nation-csv-{uuid.uuid4().hex}"
    write_csv(nation, path, one_file=True)
    return spark.read.schema(nation.schema).option("header", True).csv(path)


_SAMPLES = "epoch_us(ts) / 1e6::DOUBLE AS time, event_id AS cpu_total, event_id // 3 AS cpu_idle, event_id * 2 AS io_ms, event_id * 1048576 AS rx_bytes, user_id * event_id AS tx_bytes, 4 AS cores"


@_query(
    f"""WITH s AS (SELECT user_id, {_SAMPLES} FROM (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL)),
    d AS (SELECT user_id, time, cores, time - lag(time) OVER w AS t, cpu_total - lag(cpu_total) OVER w AS c, cpu_idle - lag(cpu_idle) OVER w AS i, io_ms - lag(io_ms) OVER w AS io, rx_bytes - lag(rx_bytes) OVER w AS rx, tx_bytes - lag(tx_bytes) OVER w AS tx
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY time))
    SELECT user_id, time, CASE WHEN c <> 0 THEN round(100 * (c - i)::DOUBLE / c * cores, 6) ELSE 0.0::DOUBLE END AS cpu_percent, CASE WHEN t > 0 THEN round(io / (t * 1000) * 100, 6) ELSE 0.0::DOUBLE END AS disk_percent,
      CASE WHEN t > 0 THEN round(rx / (t * 1048576), 6) ELSE 0.0::DOUBLE END AS rx_mib_s, CASE WHEN t > 0 THEN round(tx / (t * 1048576), 6) ELSE 0.0::DOUBLE END AS tx_mib_s FROM d WHERE t IS NOT NULL"""
)
def q_host_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand in for samples, a user for a host, ids for cumulative counters."""
    events = _table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("id"))
    samples = events.select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), F.col("id").alias("cpu_total"), F.expr("id div 3").alias("cpu_idle"), (F.col("id") * 2).alias("io_ms"),
        (F.col("id") * 1048576).alias("rx_bytes"), (F.col("user_id") * F.col("id")).alias("tx_bytes"), F.lit(4).alias("cores"),
    )
    out = host_utilisation(samples, ["user_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("cpu_percent", "disk_percent", "rx_mib_s", "tx_mib_s")})


@_query(
    """SELECT share, round(threshold, 4) AS threshold FROM (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS share,
      unnest((SELECT quantile_cont(l_extendedprice, [1.0, 0.9, 0.75, 0.5, 0.25, 0.0]) FROM lineitem)) AS threshold)"""
)
def q_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workloads.ladder(_table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)).withColumn("threshold", F.round("threshold", 4))


#: Predicates for the pruning queries, each with the SQL over statistics (lo and hi by column) that keeps a row group.
PRUNED = {
    "l_quantity <= 40.0 AND NOT l_linenumber > 6": "lo['l_quantity']::DOUBLE <= 40 AND lo['l_linenumber']::BIGINT <= 6",
    "l_linenumber > 7": "hi['l_linenumber']::BIGINT > 7",
    "NOT l_linenumber <= 7 OR l_suppkey < 0": "hi['l_linenumber']::BIGINT > 7 OR lo['l_suppkey']::BIGINT < 0",
    "l_quantity < 1.0": "lo['l_quantity']::DOUBLE < 1",
    "l_quantity > 1000.0": "true",
    "l_returnflag == Z": "lo['l_returnflag'] <= 'Z' AND hi['l_returnflag'] >= 'Z'",
    "l_shipdate < 1990-01-01-00:00:00": "lo['l_shipdate']::TIMESTAMP < TIMESTAMP '1990-01-01'",
    "l_shipdate >= 1990-01-01-00:00:00 AND l_linestatus == O": "hi['l_shipdate']::TIMESTAMP >= TIMESTAMP '1990-01-01' AND lo['l_linestatus'] <= 'O' AND hi['l_linestatus'] >= 'O'",
    "l_orderkey == text": "true",
}
_FILE = "'/root/testdata/sf0.01/lineitem.parquet'"
_CHUNKS = f"""chunks AS (SELECT parse_filename(file_name) AS file_name, CAST(row_group_id AS INTEGER) AS row_group, row_group_num_rows AS num_rows, CAST(column_id AS INTEGER) AS col_index, path_in_schema AS col_name,
      least(coalesce(dictionary_page_offset, data_page_offset), data_page_offset) AS chunk_offset, total_compressed_size AS chunk_length, stats_null_count AS null_count, coalesce(stats_min_value, stats_min) AS low, coalesce(stats_max_value, stats_max) AS high, type
      FROM parquet_metadata({_FILE})),
    files AS (SELECT parse_filename(file_name) AS file_name, file_size_bytes AS file_size, footer_size FROM parquet_file_metadata({_FILE})),
    groups AS (SELECT file_name, row_group, any_value(num_rows) AS num_rows, map(list(col_name), list(low)) AS lo, map(list(col_name), list(high)) AS hi FROM chunks GROUP BY file_name, row_group),
    kept AS ({" UNION ALL ".join(f"SELECT '{p}' AS predicate, file_name, row_group, num_rows, {sql} AS keep FROM groups" for p, sql in PRUNED.items())})"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer_stats(spark, f"{sf_dir}/lineitem.parquet")


def _for_each_predicate(spark: SparkSession, sf_dir: str, plan) -> DataFrame:
    stats, out = _stats(spark, sf_dir), None
    for text in PRUNED:
        one = plan(stats, predicate.parse(text)).withColumn("predicate", F.lit(text))
        out = one if out is None else out.unionByName(one)
    return out


@_query(
    f"""WITH {_CHUNKS} SELECT file_name, row_group, num_rows, col_index, col_name, chunk_offset, chunk_length, null_count,
      CASE WHEN col_name = 'l_shipdate' THEN epoch_us(low::TIMESTAMP) WHEN type LIKE 'INT%' THEN low::BIGINT END AS min_int, CASE WHEN col_name = 'l_shipdate' THEN epoch_us(high::TIMESTAMP) WHEN type LIKE 'INT%' THEN high::BIGINT END AS max_int,
      CASE WHEN type = 'DOUBLE' THEN low::DOUBLE + 0.0::DOUBLE END AS min_float, CASE WHEN type = 'DOUBLE' THEN high::DOUBLE + 0.0::DOUBLE END AS max_float,
      CASE WHEN type = 'BYTE_ARRAY' THEN low END AS min_string, CASE WHEN type = 'BYTE_ARRAY' THEN high END AS max_string FROM chunks"""
)
def q_footer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = [F.col(f"{m}_int").cast("long").alias(f"{m}_int") for m in ("min", "max")]
    real = [(F.col(f"{m}_float") + 0.0).alias(f"{m}_float") for m in ("min", "max")]  # no negative zero
    return _stats(spark, sf_dir).select("file_name", "row_group", "num_rows", "col_index", "col_name", "chunk_offset", "chunk_length", "null_count", *whole, *real, "min_string", "max_string")


@_query(f"WITH {_CHUNKS} SELECT predicate, file_name, row_group, keep FROM kept")
def q_prune_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _for_each_predicate(spark, sf_dir, pruning.prune)
    return out.select("predicate", F.element_at(F.split("file", "/"), -1).alias("file_name"), "row_group", "keep")


_ISLANDS = """islands AS (SELECT *, sum(starts) OVER (PARTITION BY predicate, file_name ORDER BY first, n ROWS UNBOUNDED PRECEDING) AS island FROM
      (SELECT *, CASE WHEN first <= max(first + n) OVER (PARTITION BY predicate, file_name ORDER BY first, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM wanted)),
    merged AS (SELECT predicate, file_name, min(first)::BIGINT AS "offset", (max(first + n) - min(first))::BIGINT AS length FROM islands GROUP BY predicate, file_name, island)"""
_WANTED = "wanted AS (SELECT predicate, k.file_name, chunk_offset AS first, chunk_length AS n FROM kept k JOIN chunks c ON k.file_name = c.file_name AND k.row_group = c.row_group WHERE keep{some} UNION ALL SELECT DISTINCT predicate, k.file_name, file_size - 8 - footer_size, footer_size FROM kept k JOIN files f ON k.file_name = f.file_name)"
_SOME = ["l_partkey", "l_quantity", "l_shipdate"]


@_query(f"""WITH {_CHUNKS}, {_WANTED.format(some=f" AND col_name IN ({', '.join(map(repr, _SOME))})")}, {_ISLANDS} SELECT predicate, file_name, "offset", length FROM merged""")
def q_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _for_each_predicate(spark, sf_dir, lambda stats, expr: ranges.byte_ranges(stats, expr, _SOME))
    return out.select("predicate", F.element_at(F.split("file", "/"), -1).alias("file_name"), "offset", "length")


@_query(
    f"""WITH {_CHUNKS}, {_WANTED.format(some="")}, {_ISLANDS}, planned AS (SELECT predicate, file_name, sum(length)::BIGINT AS planned_bytes FROM merged GROUP BY ALL)
    SELECT k.predicate, k.file_name, any_value(file_size)::BIGINT AS file_size, count(*) AS row_groups, sum(keep::INT)::BIGINT AS row_groups_kept, sum(num_rows)::BIGINT AS num_rows, sum(keep::INT * num_rows)::BIGINT AS num_rows_kept,
      any_value(planned_bytes) AS planned_bytes, any_value(planned_bytes)::DOUBLE / any_value(file_size) AS selectivity
    FROM kept k JOIN files f ON k.file_name = f.file_name JOIN planned p ON p.predicate = k.predicate AND p.file_name = k.file_name GROUP BY k.predicate, k.file_name"""
)
def q_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_each_predicate(spark, sf_dir, ranges.scan_report).drop("file")


@_query()
def q_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder's thresholds, timed: no SQL, as seconds differ from run to run."""
    queries = {name: ScanQuery(where=f"l_extendedprice > {at!r}", aggs=FIVE) for name, at in workloads.LADDER.items()}
    return throughput_report(spark, f"{sf_dir}/lineitem.parquet", queries)
