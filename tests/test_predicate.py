import datetime as dt

import pytest
from pyspark.sql import functions as F

from colsieve.operators.predicate import And, Cond, Literal, Not, Or, PredicateError, columns_of, literal, parse, to_column, tokenize
from colsieve.operators.scan import ScanQuery


def test_tree_and_precedence():
    a, b, c = (Cond(n, ">", Literal("int", 1)) for n in "abc")
    assert parse("a > 1 OR b > 1 AND NOT c > 1") == Or(a, And(b, Not(c)))
    assert parse("(a > 1 OR b > 1) AND c > 1") == And(Or(a, b), c)
    assert parse("a > 1 AND b > 1 AND c > 1") == And(And(a, b), c)
    assert columns_of(parse("b > 1 OR a > 1 AND b < 3")) == ["b", "a"]
    assert parse("1 == 5", ["x", "y"]) == Cond("y", "==", Literal("int", 5))


def test_tokens_split_at_space_and_parentheses_only():
    assert tokenize("(a >  1)") == ["(", "a", ">", "1", ")"]
    assert tokenize("a\t> 1") == ["a\t>", "1"]


@pytest.mark.parametrize("text", ["NOT NOT a > 1", "a = 1", "a != 1", "a >", "a", "(a > 1", "", "a > 1 b", "a > 1)", "a > 1 or b > 2"])
def test_rejected(text):
    with pytest.raises(PredicateError):
        parse(text)


@pytest.mark.parametrize("bad", ["x > 1", "2 > 1"])
def test_index_rejected(bad):
    with pytest.raises(PredicateError):
        parse(bad, ["a", "b"])


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("2024-01-02-00:00:00", ("moment", 1704153600000)), ("2024-13-02-00:00:00", ("string", "2024-13-02-00:00:00")), ("true", ("bool", True)), ("True", ("string", "True")), ("1.", ("float", 1.0)), (".5", ("float", 0.5)), ("1.5e3", ("float", 1500.0)),
        ("1e5", ("string", "1e5")), ("a.b", ("string", "a.b")), ("NaN", ("string", "NaN")), ("-7", ("int", -7)), (str(2**63 - 1), ("int", 2**63 - 1)), (str(2**63), ("string", str(2**63))), ("1_0", ("string", "1_0")),
    ],
)
def test_literals(token, want):
    assert literal(token) == Literal(*want)


SCHEMA = "i8 byte, i16 short, i32 int, i64 long, u64 decimal(20,0), f32 float, f64 double, t boolean, s string, d date, ts timestamp, ntz timestamp_ntz, bin binary"
SUITS = {"i8": "im", "i16": "im", "i32": "im", "i64": "im", "u64": "i", "f32": "f", "f64": "f", "t": "b", "s": "s", "d": "im", "ts": "m", "ntz": "m", "bin": ""}


def test_without_moments(spark):
    token = "2024-01-02-00:00:00"
    assert literal(token).kind == "moment" and literal(token, moments=False) == Literal("string", token)
    assert parse(f"NOT 0 == {token}", ["s"], moments=False) == Not(Cond("s", "==", Literal("string", token)))
    df = spark.createDataFrame([(token,), ("x",)], "s string")
    assert ScanQuery(where=f"0 == {token}", by_index=True, moments=False).run(df).count() == 1
    with pytest.raises(PredicateError):
        ScanQuery(where=f"s == {token}").run(df)


def test_type_matrix(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    tokens = {"i": "5", "m": "2024-01-02-00:00:00", "f": "5.0", "b": "true", "s": "five"}
    for column, suits in SUITS.items():
        for kind, token in tokens.items():
            if kind in suits:
                to_column(parse(f"{column} < {token}"), schema)
            else:
                with pytest.raises(PredicateError):
                    to_column(parse(f"{column} < {token}"), schema)


def test_unknown_and_other_case_raise(spark):
    schema = spark.createDataFrame([], "Ab int").schema
    for name in ("ab", "x"):
        with pytest.raises(PredicateError):
            to_column(parse(f"{name} > 1"), schema)


def test_null_logic(spark):
    df = spark.createDataFrame([(None, 1), (None, 9), (5, 1)], "a int, b int")
    count = lambda text, **k: df.filter(to_column(parse(text), df.schema, **k)).count()
    assert count("a > 1 OR b > 5") == 2
    assert count("a > 1 OR b > 5", strict_nulls=True) == 1
    assert count("NOT (a > 1 AND b > 5)") == 2


def test_dates_and_moments(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), dt.datetime(2024, 1, d)) for d in (1, 2, 3)], "d date, ts timestamp_ntz")
    count = lambda text: df.filter(to_column(parse(text), df.schema)).count()
    assert [count(f"d {op} 2024-01-02-00:00:00") for op in ("<", "<=", "==", ">=", ">")] == [1, 2, 1, 2, 1]
    assert [count(f"d {op} 2024-01-02-06:00:00") for op in ("<", "<=", "==", ">=", ">")] == [2, 2, 0, 1, 1]
    assert [count(f"ts {op} 2024-01-02-06:00:00") for op in ("<", "<=", "==", ">=", ">")] == [2, 2, 0, 1, 1]
    assert count("d == 19724") == 1


def test_nan_safe(spark, tmp_path):
    spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for text, n in (("x > 5.0", 1), ("NOT x < 5.0", 1), ("x <= 3.0", 2), ("NOT x == 1.0", 2)):
        assert df.filter(to_column(parse(text), df.schema, nan_safe=True)).count() == n


def test_comparison_is_pushed_down(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("a"), F.col("id").cast("string").alias("b"), F.lit(1).alias("c")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = df.filter(to_column(parse("a > 3 AND b == five"), df.schema)).select("a")._jdf.queryExecution().toString()
    assert "GreaterThan(a,3)" in plan and "EqualTo(b,five)" in plan and "ReadSchema: struct<a:bigint,b:string>" in plan
