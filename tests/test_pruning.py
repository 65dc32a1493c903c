import datetime as dt
import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colsieve.operators.predicate import parse, to_column
from colsieve.operators.pruning import may_hold, prune
from colsieve.operators.ranges import byte_ranges, merge_ranges, scan_report
from colsieve.sources.footers import footer_stats


@pytest.fixture(scope="module")
def groups(tmp_path_factory):
    """Ten row groups of 100 rows with tight, wide, missing and misleading statistics."""
    rng, n = np.random.default_rng(4), 1000
    table = pa.table({
        "a": pa.array(np.arange(n)), "b": pa.array(rng.random(n)), "i": pa.array([None if k % 7 == 0 else int(k) % 50 for k in range(n)], pa.int32()),
        "f": pa.array([float("nan") if k % 90 == 3 else k / 10 for k in range(n)], pa.float32()), "t": pa.array([k < 300 for k in range(n)]), "s": pa.array([f"a-common-prefix-{k // 100}" for k in range(n)]),
        "d": pa.array([dt.date(2024, 1, 1) + dt.timedelta(days=k // 10) for k in range(n)]), "ts": pa.array([dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(n)], pa.timestamp("us")),
        "n": pa.array([None if k < 100 else k for k in range(n)], pa.int64()),
    })
    path = tmp_path_factory.mktemp("groups")
    pq.write_table(table, path / "sorted.parquet", row_group_size=100)
    pq.write_table(table.take(rng.permutation(n)), path / "shuffled.parquet", row_group_size=100, use_dictionary=False)
    pq.write_table(table, path / "bare.parquet", row_group_size=100, write_statistics=False)
    return str(path)


@pytest.mark.parametrize("op", ["<", "<=", "==", ">=", ">"])
def test_interval_table(op):
    holds = {"<": lambda x, v: x < v, "<=": lambda x, v: x <= v, "==": lambda x, v: x == v, ">=": lambda x, v: x >= v, ">": lambda x, v: x > v}[op]
    for low, high, v in itertools.product(range(5), range(5), range(-1, 6)):
        if low <= high:
            inside = [holds(x, v) for x in range(low, high + 1)]
            assert may_hold(op, False, low, high, v) == any(inside)
            assert may_hold(op, True, low, high, v) == (not all(inside))


def test_footers(spark, groups):
    stats = footer_stats(spark, groups)
    assert stats.count() == 3 * 10 * 9
    row = stats.where("file_name = 'sorted.parquet' and row_group = 2 and col_name = 'a'").first()
    assert (int(row.min_int), int(row.max_int), row.num_rows, row.null_count) == (200, 299, 100, 0)
    assert stats.where("file_name = 'bare.parquet' and min_int is not null").count() == 0
    for name in ("sorted.parquet", "bare.parquet"):
        meta = pq.read_metadata(f"{groups}/{name}")
        want = sum(meta.row_group(g).column(c).total_compressed_size for g in range(10) for c in range(9))
        assert stats.where(F.col("file_name") == name).agg(F.sum("chunk_length")).first()[0] == want


def test_footers_of_a_path_that_only_spark_opens(spark, groups):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.footers.link./at", f"file://{groups}")
    seen, own = (footer_stats(spark, p) for p in ("viewfs://footers/at", groups))
    columns = [c for c in own.columns if c != "file"]
    assert all(r.file.startswith("viewfs:") for r in seen.select("file").distinct().collect())
    assert sorted(map(str, seen.select(columns).collect())) == sorted(map(str, own.select(columns).collect()))


def test_pruned_groups_hold_no_matching_row(spark, groups):
    rng = random.Random(7)
    leaves = ["a < 250", "a >= 730", "a == 512", "b > 0.5", "i <= 10", "i == 49", "f > 50.0", "f < 20.0", "f == 30.5", "t == true", "t == false", "s == a-common-prefix-3", "s > a-common-prefix-7", "d < 2024-02-01-00:00:00", "d >= 2024-03-01-12:30:00", "d == 2024-02-01-00:00:00", "d == 2024-02-01-06:00:00", "d == 19800",
              "ts >= 2024-01-20-00:00:00", "n > 900", "n == 50", "a > 1000", "s < a"]
    stats = footer_stats(spark, groups).cache()

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(leaves)
        if rng.random() < 0.35:
            return f"NOT ( {some(depth - 1)} )"
        return f"( {some(depth - 1)} {rng.choice(['AND', 'OR'])} {some(depth - 1)} )"

    spark.conf.set("spark.sql.parquet.filterPushdown", "false")
    try:
        df = {f: spark.read.parquet(f"{groups}/{f}.parquet") for f in ("sorted", "shuffled", "bare")}
        pruned = 0
        for text in leaves + [f"NOT {x}" for x in leaves] + [some(3) for _ in range(12)]:
            expr = parse(text)
            kept = {(r.file.rsplit("/", 1)[-1].split(".")[0], r.row_group): r.keep for r in prune(stats, expr).collect()}
            assert len(kept) == 30 and all(kept["bare", g] for g in range(10))
            for f in ("sorted", "shuffled"):
                hits = {r[0] for r in df[f].withColumn("g", F.col("_metadata.row_index") / 100).filter(to_column(expr, df[f].schema)).select(F.floor("g").cast("int")).distinct().collect()}
                assert all(kept[f, g] for g in hits), text
            pruned += sum(not k for k in kept.values())
        assert pruned > 100
    finally:
        spark.conf.unset("spark.sql.parquet.filterPushdown")


def test_dates_prune_by_moments(spark, groups):
    """Groups of ten days each; midnight belongs to the day."""
    stats = footer_stats(spark, f"{groups}/sorted.parquet")
    for text, n in (("d > 2030-01-01-00:00:00", 0), ("d < 2024-01-01-00:00:00", 0), ("d < 2024-01-01-00:00:01", 1), ("d == 2024-01-15-00:00:00", 1), ("NOT d <= 2024-03-20-00:00:00", 2)):
        assert prune(stats, parse(text)).where("keep").count() == n, text


def test_unknown_column_and_type_mismatch_keep(spark, groups):
    stats = footer_stats(spark, groups)
    for text in ("zzz > 1", "a > 5000.0", "a == text", "b > 7"):
        assert prune(stats, parse(text)).where("keep").count() == 30


def test_merge_ranges_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(f, rng.randrange(300), rng.randrange(1, 12)) for f in "xyz" for _ in range(40)]
    want = []
    for f in "xyz":
        covered = sorted({b for g, o, n in rows if g == f for b in range(o, o + n)})
        start = covered[0]
        for a, b in zip(covered, [*covered[1:], None], strict=True):
            if b != a + 1:
                want.append((f, start, a + 1 - start))
                start = b
    got = merge_ranges(spark.createDataFrame(rows, "file string, offset long, length long"))
    assert sorted(map(tuple, got.collect())) == want


def test_ranges_and_report(spark, groups):
    stats = footer_stats(spark, f"{groups}/sorted.parquet")
    whole = byte_ranges(stats, None).agg(F.sum("length")).first()[0]
    some = byte_ranges(stats, parse("a < 250")).agg(F.sum("length")).first()[0]
    one = byte_ranges(stats, parse("a < 250"), ["a"]).agg(F.sum("length")).first()[0]
    assert one < some < whole
    r = scan_report(stats, parse("a < 250")).first()
    assert (r.row_groups, r.row_groups_kept, r.num_rows, r.num_rows_kept, r.planned_bytes) == (10, 3, 1000, 300, some)
    assert r.selectivity == some / r.file_size
