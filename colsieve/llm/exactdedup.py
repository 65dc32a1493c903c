"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

Method. A ``Store`` is a folder of snapshots side by side, each written once. A snapshot has a row for each digest (SHA-256 of
the text with A-Z lower-cased) that no earlier one has, in exact buckets of the digest, and for each bucket a binary-fuse
filter: 8-bit fingerprints, about 1.13 bytes a digest. A new batch is first grouped by itself. Its distinct digests meet
the filters only; those that all filters reject are new and need no join. Those accepted join their exact buckets. The texts of
every digest that occurs more than once are compared byte by byte: what has one digest but another text is another text. Adding a
batch writes a further snapshot and rebuilds nothing.

Scale. Digests are made in the JVM. Buckets are sized by the number of rows, so a filter and its keys fit one task at any
input. A group of copies, however large, is one row after partial aggregation, also where texts are compared; texts move only
for digests that occur more than once, so the shuffle follows the number of rows and the duplicates, not the bytes. Digests are
broadcast only while there are at most ``MOST_BROADCAST`` of them (about 100 bytes each in memory), beyond that the join is shuffled.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, keep, local_frame, scratch, shared_dir, spread_join, written
from .text import mixed

_U = np.uint64
BUCKET_ROWS = 25_000
MOST_BROADCAST = 200_000
_GROUPS = "digest binary, texts long, size long, keep_id long, keep_row long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class BinaryFuse8:
    """A static filter over distinct 64-bit keys: no false negative, false positives about 1 in 256."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
        return mixed(keys ^ mixed(np.array([seed], np.uint64)))

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Three places of each hash, in three consecutive segments."""
        first = ((h >> _U(32)) * _U(self.segments)) >> _U(32)
        at = [((first + _U(k)) * _U(self.segment) + (mixed(h + _U(k + 1)) & _U(self.segment - 1))).astype(np.int64) for k in range(3)]
        return np.stack(at)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _U(32))) & _U(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        """Peels the hypergraph of keys and places in rounds; a seed that doesn't peel is replaced."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        places = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))) + 4
        segments = max(1, -(-places // segment) - 2)
        for seed in range(1, 1000):
            out = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            h = cls._hash(keys, seed)
            at = out._places(h)
            count = np.bincount(at.ravel(), minlength=len(out.prints)).astype(np.int64)
            owner = np.zeros(len(out.prints), np.int64)  # the xor of the indexes of a place's keys
            for k in range(3):
                np.bitwise_xor.at(owner, at[k], np.arange(len(keys)))
            peeled, alone, left = [], np.flatnonzero(count == 1), len(keys)
            while len(alone):
                who, once = np.unique(owner[alone], return_index=True)
                peeled.append((who, alone[once]))
                left -= len(who)
                touched = at[:, who]
                for k in range(3):
                    np.subtract.at(count, touched[k], 1)
                    np.bitwise_xor.at(owner, touched[k], who)
                alone = np.unique(touched)
                alone = alone[count[alone] == 1]
            if left == 0:
                prints = cls._prints(h)
                for who, place in reversed(peeled):
                    others = out.prints[at[0, who]] ^ out.prints[at[1, who]] ^ out.prints[at[2, who]]
                    out.prints[place] = prints[who] ^ others  # its own place still holds 0
                return out
        raise RuntimeError("no seed peels")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = self._hash(keys.astype(np.uint64), self.seed)
        at = self._places(h)
        return self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]] == self._prints(h)

    def to_bytes(self) -> bytes:
        return struct.pack("<qqq", self.seed, self.segment, self.segments) + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse8:
        return cls(*struct.unpack_from("<qqq", raw), np.frombuffer(raw, np.uint8, offset=24))


def normalised(text: Column) -> Column:
    """UTF-8 with A-Z lower-cased and nothing else changed; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)  # lower() changes nothing but A-Z there, and is faster
    return F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER)).cast("binary")


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _key(digest: str = "digest") -> Column:
    """64 bits of the digest, for buckets and filters."""
    return F.xxhash64(digest)


def _few(digests: DataFrame) -> DataFrame:
    return F.broadcast(digests) if digests.count() <= MOST_BROADCAST else digests


def _filters(keyed: DataFrame) -> DataFrame:
    """(bucket, filter) of (bucket, key)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = BinaryFuse8.build(pdf["key"].to_numpy().view(np.uint64)).to_bytes()
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [raw]})

    return keyed.groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


def _accepted(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(bucket, digest) of the batch's digests that the filters can't rule out."""

    def probe(_key, batch: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(own):
            return pd.DataFrame({"bucket": pd.Series(dtype="int64"), "digest": pd.Series(dtype="object")})
        maybe = BinaryFuse8.from_bytes(own["filter"].iloc[0]).contains(batch["key"].to_numpy().view(np.uint64))
        return batch.loc[maybe, ["bucket", "digest"]]

    keyed = batch.select("digest", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "bucket long, digest binary")


def digests(docs: DataFrame, digest: Callable[[Column], Column] = sha256, *more: Column) -> DataFrame:
    """(doc_id, digest, row, more), written: row tells repeated rows apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(normalised(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row"), *more)
    return written(rows, "ed-rows")


class Store:
    """Snapshots in one folder, each immutable.

    A snapshot's folder holds ``groups`` (bucket, digest, texts, size, keep_id, keep_row) of the digests with new texts, ``again``, the
    same for digests whose texts earlier snapshots have, ``filters`` (bucket, filter), ``documents`` (text) for comparing
    bytes, and ``ready`` (buckets), written last: without it the snapshot doesn't exist.
    """

    def __init__(self, spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.path, self.digest = spark, path.rstrip("/"), digest
        self._own: dict[str, DataFrame] = {}

    def snapshots(self) -> list[tuple[str, int]]:
        """Path and number of buckets of each, the oldest first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshot-*/ready/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        paths = sorted(f.getPath().getParent().getParent().toString() for f in found)
        return [(p, self.spark.read.schema("buckets long").parquet(f"{p}/ready").first()["buckets"]) for p in paths]

    def _documents(self, path: str) -> DataFrame:
        """(text) of a snapshot."""
        name = path.rsplit("/", 1)[-1]
        return self._own[name] if name in self._own else self.spark.read.schema("text string").parquet(f"{path}/documents")

    def known(self) -> DataFrame:
        """(digest, texts, size, keep_id, keep_row) of all snapshots, not yet merged; texts: how many new texts the snapshot has."""
        out = local_frame(self.spark, [], digest=pa.binary(), texts=pa.int64(), size=pa.int64(), keep_id=pa.int64(), keep_row=pa.int64())
        for path, _ in self.snapshots():
            for part in ("groups", "again"):
                out = out.unionByName(self.spark.read.schema(_GROUPS).parquet(f"{path}/{part}").select(out.columns))
        return out

    def bodies(self, docs: DataFrame, digests: DataFrame) -> DataFrame:
        """The distinct (digest, body) of docs (text) whose digest is in digests (digest), distinct."""
        texts = docs.select(normalised(F.col("text")).alias("body")).withColumn("digest", self.digest(F.col("body")))
        return texts.join(_few(digests), "digest", "left_semi").select("digest", "body").distinct()

    def match(self, docs: DataFrame, hashed: DataFrame) -> DataFrame:
        """The groups of a batch: (digest, texts, size, keep_id, keep_row); texts: how many of its texts no snapshot has.

        hashed: ``digests`` of docs. A digest that occurs once in all has one text; the others' texts are compared byte by byte.
        """
        sizes = [F.count("*").alias("size"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row")]
        batch = written(hashed.groupBy("digest").agg(*sizes), "ed-batch")
        known, old = local_frame(self.spark, [], digest=pa.binary()), local_frame(self.spark, [], digest=pa.binary(), body=pa.binary())
        for path, buckets in self.snapshots():
            accepted = _accepted(batch, self.spark.read.schema("bucket long, filter binary").parquet(f"{path}/filters"), buckets)
            exact = self.spark.read.schema(f"{_GROUPS}, bucket long").parquet(f"{path}/groups").select("bucket", "digest")
            met = written(exact.join(accepted, ["bucket", "digest"], "left_semi").select("digest"), "ed-met")
            if not met.isEmpty():
                known, old = known.unionByName(met), old.unionByName(self.bodies(self._documents(path), met))
        several = written(batch.where("size > 1").select("digest").unionByName(known).distinct(), "ed-several")
        fresh = self.bodies(docs, several).join(old, ["digest", "body"], "left_anti").groupBy("digest").agg(F.count("*").alias("fresh"))
        compared = several.join(fresh, "digest", "left").select("digest", F.coalesce("fresh", F.lit(0)).alias("fresh"))
        out = batch.join(compared, "digest", "left").withColumn("texts", F.coalesce("fresh", F.lit(1)).cast("long"))
        return written(out.select("digest", "texts", "size", "keep_id", "keep_row"), "ed-groups")

    def add(self, docs: DataFrame, hashed: DataFrame | None = None, copy: bool = True) -> None:
        """Adds a batch (doc_id, text, ...) as a further snapshot.

        Without copy the texts stay where they are: docs must not change, and only this Store can compare with them.
        """
        groups = self.match(docs, digests(docs, self.digest) if hashed is None else hashed)
        name = f"snapshot-{len(self.snapshots()) + 1:08d}"
        path, new = f"{self.path}/{name}", groups.where("texts > 0")
        if copy:
            docs.select(F.col("text").cast("string").alias("text")).write.mode("overwrite").parquet(f"{path}/documents")
        else:
            self._own[name] = docs
        buckets = max(1, -(-new.count() // BUCKET_ROWS))
        groups.where("texts = 0").write.mode("overwrite").parquet(f"{path}/again")
        new = new.withColumn("bucket", F.pmod(_key(), F.lit(buckets)))
        new.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/groups")
        keyed = self.spark.read.schema(f"{_GROUPS}, bucket long").parquet(f"{path}/groups").select("bucket", _key().alias("key"))
        _filters(keyed).write.mode("overwrite").parquet(f"{path}/filters")
        local_frame(self.spark, [(buckets,)], buckets=pa.int64()).write.mode("overwrite").parquet(f"{path}/ready")


def exact_duplicates(docs: DataFrame, is_new: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text, ...).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    stays. Among repeated rows with that same doc_id exactly one is kept; a null doc_id counts as the smallest. ``is_new``: SQL
    condition on doc_id for the rows of the new batch, the others become a snapshot; without it half of the ids by
    hash. The result does not depend on it. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    new = F.expr(is_new) if is_new else F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)) == 1
    new = F.coalesce(new, F.lit(True))
    with scratch():
        hashed = keep(digests(docs, digest, new.alias("new")))
        store = Store(spark, f"{shared_dir(spark)}/ed-store-{uuid.uuid4().hex}", digest)
        store.add(docs.where(~new), hashed.where("not new"), copy=False)
        every = store.known().unionByName(store.match(docs.where(new), hashed.where("new")))
        merge = [F.sum("texts").alias("texts"), F.sum("size").alias("size"), F.max("keep_id").alias("keep_id"), F.coalesce(F.max_by("keep_row", "keep_id"), F.min("keep_row")).alias("keep_row")]
        total = keep(written(every.groupBy("digest").agg(*merge), "ed-total"))
        split = total.where("texts > 1").select("digest")
        apart = None
        if not split.isEmpty():  # one digest, several texts: their rows are told apart by the text
            texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body")).withColumn("digest", digest(F.col("body")))
            texts = written(texts.join(split, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "ed-split")
            groups = texts.groupBy("digest", "body").agg(F.count("*").alias("size"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"))
            apart = keep(written(texts.join(groups, ["digest", "body"]).drop("body"), "ed-apart"))
        delete(spark, store.path)
    columns = ["doc_id", "digest", "row", "size", "keep_id", "keep_row"]
    rows = spread_join(hashed.select("doc_id", "digest", "row"), total.where("texts = 1").withColumn("use", F.col("size")), "digest", "inner").select(columns)
    rows = rows if apart is None else rows.unionByName(apart.select(columns))
    return rows.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, that ``exact_duplicates`` keeps: one of each group of equal texts.

    Nulls, ties and repeated rows: as there; an empty table stays empty.
    """
    with scratch():
        flags = exact_duplicates(docs).groupBy(F.col("doc_id").alias("_of"), F.unhex("text_sha256").alias("_is"))
        flags = written(flags.agg(F.max("kept").alias("kept"), F.count("*").alias("times")), "ed-flags")
        lost = keep(written(flags.where("not kept").select("_of", "_is"), "ed-lost"))
        repeated = keep(written(flags.where("kept and times > 1").select("_of", "_is"), "ed-repeated"))
    # a struct of all columns, so that no column of docs can clash
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"), docs["doc_id"].cast("long").alias("_id"), sha256(normalised(docs["text"])).alias("_sha"))
    same = F.expr("_id <=> _of and _sha = _is")
    rows = rows.join(_few(lost), same, "left_anti")
    if not repeated.isEmpty():
        repeated = _few(repeated)
        once = rows.join(repeated, same, "left_semi").groupBy("_id", "_sha").agg(F.first("_doc").alias("_doc"))
        rows = rows.join(repeated, same, "left_anti").select("_doc").unionByName(once.select("_doc"))
    return rows.select("_doc.*")

