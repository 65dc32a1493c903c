"""Parquet footers as a DataFrame: one row for each column chunk, with typed statistics.

Files are listed by Spark; only footers are read. Paths of the schemes that pyarrow opens are read by tasks, some footers each.
Of any other scheme the driver fetches the last bytes of each file through Spark's own file systems, ``FETCHERS`` files at a time, and
tasks decode them: a few kilobytes a file, so suited to some 100,000 files.
"""

from __future__ import annotations

import datetime as dt
import urllib.parse
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "file string, file_name string, file_size long, footer_offset long, footer_length long, row_group int, num_rows long, "
    "col_index int, col_name string, physical_type string, kind string, chunk_offset long, chunk_length long, null_count long, "
    "min_int decimal(20,0), max_int decimal(20,0), min_float double, max_float double, min_string string, max_string string, min_bool boolean, max_bool boolean"
)
FILES_PER_TASK, FETCHERS = 64, 16
OPENED_BY_TASKS = ("", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def kind_of(t: pa.DataType) -> str:
    """int, float, bool, string, date or moment (both as integers: days, and microseconds), else other."""
    if pa.types.is_integer(t):
        return "int"
    if pa.types.is_floating(t):
        return "float"
    if pa.types.is_boolean(t):
        return "bool"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_date(t):
        return "date"
    return "moment" if pa.types.is_timestamp(t) else "other"


def _number(x) -> int:
    if isinstance(x, dt.datetime):
        zero = dt.datetime(1970, 1, 1, tzinfo=x.tzinfo and dt.UTC)
        return (x - zero) // dt.timedelta(microseconds=1)
    if isinstance(x, dt.date):
        return (x - dt.date(1970, 1, 1)).days
    return int(x)


def _read(path: str) -> tuple[str, int, int, pq.FileMetaData]:
    """Name, size and footer length of a file that pyarrow can open, and its decoded footer."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    size = system.get_file_info(at).size
    with system.open_input_file(at) as f:
        f.seek(size - 8)
        tail = f.read(8)
        if tail[4:] != b"PAR1":
            raise ValueError(f"not a Parquet file: {path}")
        return at.rsplit("/", 1)[-1], size, int.from_bytes(tail[:4], "little"), pq.read_metadata(f)


def _fetched(spark: SparkSession, path: str) -> tuple[str, int, bytearray]:
    """Path, size, and footer with its length and magic, through Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size, read = system.getFileStatus(at).getLen(), spark._jvm.org.apache.commons.io.IOUtils.toByteArray
    stream = system.open(at)
    try:
        stream.seek(size - 8)
        tail = bytes(read(stream, 8))
        if tail[4:] != b"PAR1":
            raise ValueError(f"not a Parquet file: {path}")
        stream.seek(size - 8 - int.from_bytes(tail[:4], "little"))
        return path, size, bytearray(read(stream, 8 + int.from_bytes(tail[:4], "little")))
    finally:
        stream.close()


def chunk_rows(path: str, size: int | None = None, tail: bytes | None = None) -> list[dict]:
    """The rows of one file, opened here or given by its size and last bytes. A chunk starts at its dictionary page if it has one, else at its data."""
    if tail is None:
        name, size, length, meta = _read(path)
    else:
        name, length, meta = urllib.parse.unquote(path.rsplit("/", 1)[-1]), len(tail) - 8, pq.read_metadata(pa.BufferReader(b"PAR1" + tail))
    schema = meta.schema.to_arrow_schema()
    file = {"file": path, "file_name": name, "file_size": size, "footer_offset": size - 8 - length, "footer_length": length}
    rows = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            name = chunk.path_in_schema
            kind = kind_of(schema.field(name).type) if name in schema.names else "other"
            start = min(x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x)
            row = file | {"row_group": g, "num_rows": group.num_rows, "col_index": c, "col_name": name, "physical_type": chunk.physical_type, "kind": kind, "chunk_offset": start, "chunk_length": chunk.total_compressed_size}
            stats = chunk.statistics if chunk.is_stats_set else None
            if stats is not None:
                row["null_count"] = stats.null_count if stats.has_null_count else None
                field = {"int": "int", "date": "int", "moment": "int", "float": "float", "bool": "bool", "string": "string"}.get(kind)
                if stats.has_min_max and field and chunk.physical_type != "INT96":
                    low, high = (_number(x) if field == "int" else x for x in (stats.min, stats.max))
                    if field == "int":
                        low, high = pa.scalar(low, pa.decimal128(20, 0)).as_py(), pa.scalar(high, pa.decimal128(20, 0)).as_py()
                    row |= {f"min_{field}": low, f"max_{field}": high}
            rows.append(row)
    return rows


def footer_stats(spark: SparkSession, path: str) -> DataFrame:
    """The footers of all files under a path or glob."""
    files = sorted(spark.read.parquet(path).inputFiles())
    if all(f.split(":", 1)[0] in OPENED_BY_TASKS for f in files if ":" in f):
        rows = [(f, None, None) for f in files]
    else:
        with ThreadPoolExecutor(FETCHERS) as pool:
            rows = list(pool.map(lambda f: _fetched(spark, f), files))
    listed = spark.createDataFrame(rows, "file string, size long, tail binary").repartition(max(1, -(-len(files) // FILES_PER_TASK)))
    arrow = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}.get(t, pa.decimal128(20, 0))) for n, t in (x.strip().split(" ") for x in SCHEMA.replace("20,0", "20;0").split(","))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(chunk_rows(row["file"], row["size"], row["tail"]), schema=arrow)

    return listed.mapInArrow(read, SCHEMA)
