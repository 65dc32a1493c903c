import pytest

from colsieve.operators.aggregates import Aggregate, parse_aggregate
from colsieve.operators.scan import ScanQuery

ALL = tuple(f"{op}({{}})" for op in ("SUM", "AVG", "MIN", "MAX", "COUNT"))


def five(column):
    return tuple(a.format(column) for a in ALL)


def test_parse_aggregate():
    assert parse_aggregate("SUM(x)") == Aggregate("SUM", "x") and str(parse_aggregate("MAX(a b)")) == "MAX(a b)"
    for bad in ("sum(x)", "SUM", "SUM()", "MEDIAN(x)", "SUM(x", ""):
        with pytest.raises(ValueError):
            parse_aggregate(bad)


def test_aggregates_skip_nulls_and_widen(spark):
    df = spark.createDataFrame([(1, 1.5, None), (None, None, None), (3, 2.5, None)], "i short, f float, n int")
    assert ScanQuery(aggs=five("i")).run(df).collect()[0] == (4, 2.0, 1, 3, 2)
    assert ScanQuery(aggs=five("f")).run(df).collect()[0] == (4.0, 2.0, 1.5, 2.5, 2)
    assert ScanQuery(aggs=five("n")).run(df).collect()[0] == (0, None, None, None, 0)
    assert dict(ScanQuery(aggs=("MIN(i)", "MAX(f)")).run(df).dtypes) == {"min_i": "bigint", "max_f": "double"}


def test_unsigned(spark):
    df = spark.sql("select cast(9223372036854775808 as decimal(20,0)) u union all select cast(5 as decimal(20,0))")
    row = ScanQuery(where="u > 7", aggs=("SUM(u)", "COUNT(u)")).run(df).first()
    assert int(row[0]) == 2**63 and row[1] == 1


def test_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert str(ScanQuery(aggs=("MAX(x)",)).run(df).first()[0]) == "nan"
    assert ScanQuery(aggs=("MAX(x)", "COUNT(x)"), ignore_nan=True).run(df).first() == (1.0, 1)


def test_bad_aggregates_raise(spark):
    df = spark.createDataFrame([("a", True)], "s string, t boolean")
    for agg in ("SUM(s)", "MIN(t)", "COUNT(*)", "COUNT(S)"):
        with pytest.raises(ValueError):
            ScanQuery(aggs=(agg,)).run(df)


def test_projection_keeps_table_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert ScanQuery(columns=("c", "a"), where="b == 2").run(df).columns == ["a", "c"]
    assert ScanQuery(first_n=2).run(df).columns == ["a", "b"]
    for bad in ({"first_n": 4}, {"first_n": 0}, {"columns": ("z",)}):
        with pytest.raises(ValueError):
            ScanQuery(**bad).run(df)


def test_file_scope(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 5).coalesce(1).write.parquet(str(tmp_path / f"t/{i}"))
    df = spark.read.parquet(*(str(tmp_path / f"t/{i}") for i in range(3)))
    got = ScanQuery(where="id > 2", aggs=("MIN(id)", "COUNT(id)"), scope="file").run(df)
    assert sorted(r[1:] for r in got.collect()) == [(3, 2), (10, 5), (20, 5)]
    with pytest.raises(ValueError):
        ScanQuery(aggs=("MIN(id)",), scope="block").run(df)


def test_stream(spark, tmp_path):
    from colsieve.streaming.scans import stream_files, stream_scan

    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = stream_files(spark, str(tmp_path / "in"), spark.range(1).schema)
    out, mode = stream_scan(stream, ScanQuery(where="id >= 4", aggs=("SUM(id)", "COUNT(id)")))
    q = out.writeStream.outputMode(mode).format("memory").queryName("scanned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from scanned").first() == (39, 6)
