"""Every registered query that has SQL gives its rows on the smallest tables; the others run."""

import duckdb
import pytest

from colsieve.functions.counters import host_utilisation
from colsieve.operators.scan import ScanQuery
from colsieve.operators.throughput import throughput_report
from colsieve.plans import registry, workloads
from colsieve.sources.sinks import append_csv, shared_dir

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    q = con.execute(registry.ORACLE_SQL[name].replace("/sf0.01/", "/sf0.001/"))
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in q.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_selectivity_edges(spark):
    """No files, no bytes, and a ratio above one."""
    rows = [(1, 10.0, 0.0, 5), (2, 0.0, 2.0, 5), (3, 10.0, 2.0, 1), (3, 3.0, 3.0, 1), (4, 1.0, 4.0, 400)]
    df = spark.createDataFrame(rows, "w int, bytes double, files double, original int")
    got = workloads.selectivity_distribution(df, workloads.Scans("w", "bytes", "files", "original")).collect()
    assert [(r[0], r[1]) for r in got] == [(1.0, 1), (60.0, 1), (100.0, 3)]
    assert sum(r[2] for r in got) == pytest.approx(100)


def test_host_utilisation(spark):
    rows = [(1.0, 100, 50, 0, 0, 0, 4), (2.0, 200, 100, 500, 1048576, 0, 4), (3.0, 200, 100, 500, 1048576, 2097152, 4)]
    got = host_utilisation(spark.createDataFrame(rows, "time double, cpu_total long, cpu_idle long, io_ms long, rx_bytes long, tx_bytes long, cores int")).orderBy("time").collect()
    assert [tuple(r) for r in got] == [(2.0, 200.0, 50.0, 1.0, 0.0), (3.0, 0.0, 0.0, 0.0, 2.0)]


def test_append_csv(spark, tmp_path):
    for _ in range(2):
        append_csv(spark.range(3), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 6


def test_ladder_skips_nulls_and_nan(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)] + [(None,), (float("nan"),)], "v double")
    assert [tuple(r) for r in workloads.ladder(df, "v", (0.1, 0.5, 1.0)).collect()] == [(0.1, 9.0), (0.5, 5.0), (1.0, 0.0)]


def test_throughput(spark):
    rows = {r["query"]: r for r in throughput_report(spark, f"{D}/lineitem.parquet", {"none": ScanQuery(where="l_linenumber > 7"), "all": ScanQuery()}, runs=2).collect()}
    assert rows["all"].selectivity > 0.9 > rows["none"].selectivity and rows["all"].file_bytes == rows["none"].file_bytes
    for r in rows.values():
        assert r.queries_per_second == pytest.approx(1 / r.seconds) and r.gb_per_second == pytest.approx(r.planned_bytes / r.seconds / 1e9)


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Cluster)
    assert shared_dir(spark).startswith("file://")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
