"""What the operators share: the folder all executors see, written cut points, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT of a join's rows is joined by broadcast; there are at most HOT of them, whatever the input.
HOT = 20_000
_own_dir: str | None = None
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary one; any other raises."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="colsieve-")
    return _own_dir


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextlib.contextmanager
def scratch():
    """Deletes at its end what was ``written`` inside, but for the frames handed to ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def keep(df: DataFrame) -> DataFrame:
    """Hands df on to the scope outside, if there is one: a lazy result still reads it."""
    _scopes[-1].remove(df)
    if len(_scopes) > 1:
        _scopes[-2].append(df)
    return df


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing that is still lazy reads it."""
    for df in frames:
        if getattr(df, "_written_path", None):
            delete(df.sparkSession, df._written_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_frame(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A few rows of the driver as a DataFrame; through Arrow, as rows of Python objects would start more Python workers."""
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)}))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left with the columns of right (key, ..., use), a lookup with one row for each key; how: left or inner.

    use: how many rows of left have the key, at least. Rows of keys that hold more than 1/``HOT`` of all stay where they are and
    meet a broadcast of at most ``HOT`` rows; the others are shuffled by a key that can't fill a task.
    """
    size = right.agg(F.sum("use").alias("all"), F.max("use").alias("most")).first()
    total, plain = size["all"] or 0, right.drop("use")
    if (size["most"] or 0) * HOT <= total:
        return left.join(plain, key, how)
    hot = right.where(F.col("use") * HOT > total).drop("use").withColumn("_hot", F.lit(True))
    tried = left.join(F.broadcast(hot), key, "left")
    rest = tried.where("_hot is null").select(*[F.col(f"`{c}`") for c in left.columns]).join(plain, key, how)
    return tried.where("_hot").drop("_hot").unionByName(rest)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Entries (row, column) of a boolean matrix, fewer than rows + columns, that connect what all true entries connect."""
    rows, cols = np.nonzero(linked)
    parent = list(range(sum(linked.shape)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = find(i), find(len(linked) + j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum; equal states end the iteration."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds, each a partial aggregation and a join, written to the shared
    folder. Rows never outnumber the edges, so one huge component costs no more than many small ones; the node that
    a huge component gathers around is joined by broadcast.
    Self-loops and nulls are ignored. Raises if the rounds don't settle rather than returning a partial answer.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(pairs, "cc")
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        # large-star: every neighbour larger than u moves to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("use")).select("a", F.least("a", "m").alias("m"), "use")
        large = spread_join(both.where("b > a"), least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "cc")
        # small-star: the smaller neighbours and u itself move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("use"))
        small = spread_join(large, least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct(), "cc")
        discard(now, large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts in an Arrow batch; Spark's own limits are 10,000 rows and 64 MB, for each of a few buffers in either process.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to ``TEXT_ROWS`` rows from now on, as lazy results are planned later. It changes no result."""
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= TEXT_ROWS:
        spark.conf.set(_ARROW_ROWS, str(TEXT_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """At most n rows in an Arrow batch of what is executed inside: bounds a batch of rows that hold long texts."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(n))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)
