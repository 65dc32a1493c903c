import os
import random

import pytest
from helpers import components
from pyspark.sql import functions as F

from colsieve.llm import common
from colsieve.llm.common import connected_components, keep, scratch, shared_dir, spread_join, written


@pytest.mark.parametrize("hot", [1, 20, 20_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join(spark, monkeypatch, hot, how):
    """The rows of a plain join, whatever counts as a hot key; clashing names and null keys included."""
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(hot)
    left = spark.createDataFrame([(rng.choice([0, 0, 0, 1, 2, None, *range(40)]), i, "x") for i in range(500)], "k long, `a.b` long, _hot string")
    right = left.where("k % 3 <> 1").groupBy("k").agg(F.max("`a.b`").alias("v"), F.count("*").alias("use"))
    left = left.drop("_hot")
    got, want = spread_join(left, right, "k", how), left.join(right.drop("use"), "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select("k", "`a.b`", "v").collect())) == sorted(map(str, want.select("k", "`a.b`", "v").collect()))


@pytest.mark.parametrize("hot", [3, 20_000])
def test_components(spark, monkeypatch, hot):
    """One node with very many neighbours, chains, and pairs."""
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(1)
    edges = [(500, i) for i in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    assert got == components({x for e in edges for x in e}, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_deletes_what_is_not_kept(spark):
    there = lambda df: os.path.exists(df._written_path.removeprefix("file://"))
    with scratch():
        outer = written(spark.range(3), "t")
        with scratch():
            kept, dropped = keep(written(spark.range(4), "t")), written(spark.range(5), "t")
        assert there(kept) and not there(dropped)
        last = keep(written(spark.range(6), "t"))
    assert there(last) and not there(kept) and not there(outer) and last.count() == 6
    with pytest.raises(RuntimeError), scratch():
        failed = written(spark.range(2), "t")
        raise RuntimeError
    assert not there(failed)


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Cluster)
    assert shared_dir(spark).startswith("file://")
