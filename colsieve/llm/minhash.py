"""Near duplicates by circulant MinHash, banding and exact Jaccard on the full shingle sets.

Method. Shingle hashes fall into a universe of 2^20 places. A first, seeded permutation shuffles the places; the second is
a table of that length, and coordinate k of the signature is the least table entry at (place + k) mod 2^20 over the set: one
circular shift for each coordinate instead of one permutation for each. For one shingle the entries of all coordinates lie
side by side, so a signature is the minimum over contiguous rows. ``BANDS`` x ``ROWS`` coordinates make the bucket keys: a pair
at similarity 0.8 misses all buckets with probability (1 - 0.8^5)^32 = 3e-6, and copies of it mostly meet through a third text
anyway.

A sketch counts a set's shingles in ``CELLS`` cells by hash. The sum of the lesser counts is never below the size of the
intersection, so candidates whose sketches can't reach the threshold are dropped without any loss. All others are
verified on their full sets.

Scale. Rows with equal sets are one class, numbered, before any bucket is built. In a bucket each class is compared with the
bucket's smallest class only, its lead: a star, linear in the bucket. A lead's text is copied once for each ``BLOCK_CLASSES``
of its members, which are dealt to the copies by hash. Where the classes of a lead still fall into several components, those
outside the largest component meet all classes of the lead exactly, in blocks of bounded size of which only as many linked pairs
come back as connect the block. So no bucket is capped, no pairs of a group are listed and no lead fills a task. Texts are fetched for candidate
classes only; those classes are broadcast while there are at most ``MOST_BROADCAST`` (about 120 bytes each), else shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, connected_components, keep, scratch, small_batches, spanning, spread_join, written
from .text import joined_buffer, mixed, shingle_sets, slices

UNIVERSE_BITS = 20
BANDS, ROWS = 32, 5
SEED = 1_000_003
CELLS = 128
MOST_BROADCAST = 200_000
PAIRS_AT_ONCE = 256
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 200_000
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second as rows: row p holds its entries at p, ..., p + coordinates - 1, circularly; a view, not a copy."""
    if coordinates not in _tables:
        rng = np.random.default_rng(SEED)
        order, first = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32), rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _tables[coordinates] = first, np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)
    return _tables[coordinates]


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set of 64-bit shingle hashes."""
    first, table = _permutations(coordinates)
    places, out = first[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)], None
    for i in range(0, len(places), 512):
        part = table[places[i : i + 512]].min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows.shape[1]):
        key = mixed(key ^ rows[:, j]) + np.uint64(j)
    return mixed(key).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(k) for k in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts)))


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each cell, one byte a cell after a byte for the unit; rounded up to whole units."""
    count = np.bincount((mixed(shingles) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    shift = max(0, int(count.max()).bit_length() - 8)
    while ((count + (1 << shift) - 1) >> shift).max() > 255:
        shift += 1
    return bytes([shift]) + ((count + (1 << shift) - 1) >> shift).astype(np.uint8).tobytes()


def _counts(sketches) -> np.ndarray:
    """Upper bounds of the cells' counts, a row for each sketch."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, CELLS + 1)
    return raw[:, 1:].astype(np.int32) << raw[:, :1]


def _reachable(common: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes may be similar, if common is the most they can share."""
    common = np.minimum(common, np.minimum(na, nb))
    return 100 * common >= percent * (na + nb - common)


def _bounded(percent: int):
    """Pairs (a, b, na, nb, sa, sb) to those that may be similar by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (_counts(batch.column(c).to_pylist()) for c in ("sa", "sb"))
            maybe = _reachable(np.minimum(sa, sb).sum(axis=1, dtype=np.int64), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield batch.select(["a", "b", "nb"]).filter(pa.array(maybe))

    return run, "a long, b long, nb long"


def _features(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, sigs, keys, bits = [], [], [], []
                for s in shingle_sets(*joined_buffer(batch.column("text")), words):
                    sizes.append(len(s))
                    sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else np.empty(0, np.int64))
                    bits.append(sketch(s) if len(s) else None)
                cols = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), _lists(keys), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run, "doc_id long, text_key binary, n_shingles long, sig binary, bands array<long>, sketch binary"


def _overlap(words: int):
    """Exact sizes of both full sets and of their intersection for rows (a, b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True):
                if a.as_py() != last:
                    last, last_set = a.as_py(), next(shingle_sets(*joined_buffer(pa.array([ta.as_py()], pa.string())), words))
                other = next(shingle_sets(*joined_buffer(pa.array([tb.as_py()], pa.string())), words))
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                rows.append((last, b.as_py(), both, len(last_set) + len(other) - both))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "common", "total"])

    return run, "a long, b long, common long, total long"


def _texts_of(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(cls, text) of the distinct classes in wanted (cls): the text of the row that stands for each."""
    ids = written(classes.select("cls", "doc_id", "text_key").join(wanted, "cls", "left_semi"), "nd-wanted")
    same = ["doc_id", "text_key"]
    if ids.count() <= MOST_BROADCAST:
        return texts.join(F.broadcast(ids), same).select("cls", "text").dropDuplicates(["cls"])
    return texts.dropDuplicates(same).join(ids, same).select("cls", "text")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the distinct candidate pairs (lead a, b, nb) that are similar, from the full texts."""
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = written(_texts_of(ids, classes, texts), "nd-texts")
    copies = F.greatest(F.ceil(F.col("use") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    leads = pairs.groupBy("a").agg(F.count("*").alias("use"), F.sum("nb").alias("shingles")).withColumn("copies", copies)
    leads = written(leads.select("a", "use", "copies"), "nd-leads")
    dealt = spread_join(pairs, leads, "a", "inner").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    lead_texts = leads.join(wanted.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    one = dealt.join(wanted.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(lead_texts, ["a", "copy"]).select("a", "b", "text_a", "text_b")
    with arrow_rows(pairs.sparkSession, PAIRS_AT_ONCE):
        return written(two.mapInArrow(*_overlap(words)).where(f"100 * common >= {percent} * total").select("a", "b"), "nd-verified")


def _block_links(words: int, percent: int):
    """One block of minor classes against one block of all classes of a lead: linked pairs of different components that connect all linked ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["minor"]], pdf[~pdf["minor"]]
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(x) or not len(y):
            return none
        sx, sy, nx, ny = _counts(x["sketch"]), _counts(y["sketch"]), x["n"].to_numpy(), y["n"].to_numpy()
        maybe = np.stack([_reachable(np.minimum(s, sy).sum(axis=1, dtype=np.int64), n, ny, percent) for s, n in zip(sx, nx, strict=True)])
        maybe &= x["component"].to_numpy()[:, None] != y["component"].to_numpy()
        rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        if not len(rows):
            return none
        own = list(shingle_sets(*joined_buffer(pa.array(x["text"].iloc[rows], pa.string())), words))
        other = list(shingle_sets(*joined_buffer(pa.array(y["text"].iloc[cols], pa.string())), words))
        common = _intersections(own, other)
        total = np.array([len(s) for s in own])[:, None] + np.array([len(s) for s in other]) - common
        found = spanning(maybe[np.ix_(rows, cols)] & (100 * common >= percent * total))
        a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        a, b = x["cls"].to_numpy()[rows[a]], y["cls"].to_numpy()[cols[b]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run, "a long, b long"


def _intersections(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of two lists of sorted sets, over their common elements some at a time."""
    x, y = np.concatenate(own), np.concatenate(other)
    of_x, of_y = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (own, other))
    shared = np.intersect1d(x, y)
    at_x, at_y = np.searchsorted(shared, x), np.searchsorted(shared, y)
    in_x = (at_x < len(shared)) & (shared[np.minimum(at_x, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool)
    in_y = (at_y < len(shared)) & (shared[np.minimum(at_y, len(shared) - 1)] == y) if len(shared) else np.zeros(len(y), bool)
    out = np.zeros((len(own), len(other)), np.int64)
    for low in range(0, len(shared), 8192):
        left, right = np.zeros((len(own), 8192), np.float32), np.zeros((len(other), 8192), np.float32)
        for m, of, at, inside in ((left, of_x, at_x, in_x), (right, of_y, at_y, in_y)):
            k = inside & (at >= low) & (at < low + 8192)
            m[of[k], at[k] - low] = 1
        out += np.rint(left @ right.T).astype(np.int64)
    return out


def _crossed(open_: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different components among the classes (lead, cls, component) that share a lead.

    The classes outside a lead's largest component meet all of its classes, block against block.
    """
    sized = written(open_.join(classes.select("cls", "n", "sketch"), "cls"), "nd-sized")
    by_component = sized.groupBy("lead", "component").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    order = F.struct("k", "component")
    per_lead = by_component.groupBy("lead").agg(F.max(order).alias("main"), F.max_by("s", order).alias("main_s"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    blocks = lambda k, s: F.greatest(F.ceil(k / BLOCK_CLASSES), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    per_lead = per_lead.select("lead", F.col("main.component").alias("main"), blocks(F.col("k") - F.col("main.k"), F.col("s") - F.col("main_s")).alias("bx"), blocks(F.col("k"), F.col("s")).alias("by"), F.col("k").alias("use"))
    placed = spread_join(sized, written(per_lead, "nd-blocks"), "lead", "inner").join(_texts_of(open_.select("cls").distinct(), classes, texts), "cls")
    placed = written(placed, "nd-placed")
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cls", "component", "n", "sketch", "text"]
    x = placed.where("component <> main").select("lead", own("bx").alias("i"), all_("by").alias("j"), *columns, F.lit(True).alias("minor"))
    y = placed.select("lead", all_("bx").alias("i"), own("by").alias("j"), *columns, F.lit(False).alias("minor"))
    return x.unionByName(y).groupBy("lead", "i", "j").applyInPandas(*_block_links(words, percent)).distinct()


def _several_texts(feats: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, cls, component) of doc_ids that come with several sets; component is the smallest of the doc_id's classes."""
    key = F.xxhash64("sig")
    ids = feats.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("k0"), F.max(key).alias("k1"), F.count("*").alias("use")).where("k0 < k1").select("doc_id", "use")
    ids = written(ids, "nd-repeated")
    sets = spread_join(feats.select("doc_id", "sig"), ids.withColumn("several", F.lit(True)), "doc_id", "inner").where("sig is not null").select("doc_id", "sig").distinct()
    sets = written(sets.join(classes.select("sig", "cls"), "sig").select("doc_id", "cls"), "nd-repeated")
    least = sets.groupBy("doc_id").agg(F.min("cls").alias("least"), F.count("*").alias("use"))
    return written(spread_join(sets, least, "doc_id", "inner"), "nd-repeated")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...).

    Words are split at ASCII white space and compared with A-Z lower-cased; the set of a text with fewer than
    ``words`` words is its whole sequence. Texts that are null, empty or blank have an empty set and link with
    nothing. Equal sets are linked. Rows that repeat a doc_id share its component, also where their texts differ and link with
    different documents. A null doc_id keeps the row, with a null component, kept. Columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    with scratch():
        feats = keep(written(texts.mapInArrow(*_features(words)).withColumn("row", F.monotonically_increasing_id()), "nd-features"))
        sets = feats.where("doc_id is not null and n_shingles > 0")
        numbered = written(sets.groupBy("sig").agg(F.min("row").alias("row"), F.min("doc_id").alias("rep"), F.count("*").alias("use")), "nd-numbered")
        of = sets.select("row", "doc_id", "text_key", F.col("n_shingles").alias("n"), "bands", "sketch")
        classes = written(of.join(numbered, "row").withColumnRenamed("row", "cls"), "nd-classes")
        rows = classes.select("cls", F.explode("bands").alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.min("cls").alias("lead"), F.count("*").alias("members"), F.count("*").alias("use")).where("members > 1")
        members = written(spread_join(rows, written(shared, "nd-buckets"), "bucket", "inner"), "nd-members")

        star = written(members.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct(), "nd-star")
        size = classes.select("cls", "n", "sketch")
        leads = star.groupBy("a").agg(F.count("*").alias("use")).join(size.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        near = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        pairs = star.join(size.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        pairs = spread_join(pairs, written(leads, "nd-leads"), "a", "inner").where(near).select("a", "b", "na", "nb", "sa", "sb")
        first = _verified(written(pairs.mapInArrow(*_bounded(percent)), "nd-pairs"), classes, texts, words, percent)
        comps = written(connected_components(first), "nd-components")

        own = members.where("members > 2 and cls <> lead").join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        own = written(own.groupBy("lead", "cls").agg(F.min("component").alias("component")), "nd-own")
        several = own.groupBy("lead").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("use")).where("c0 < c1").select("lead", "use")
        open_ = written(spread_join(own, written(several.withColumn("open", F.lit(True)), "nd-several"), "lead", "inner").drop("open"), "nd-open")
        # what the stars missed, and doc_ids with several texts, links whole components
        more = _several_texts(feats, classes).where("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b"))
        if not open_.isEmpty():
            more = more.unionByName(_crossed(open_, classes, texts, words, percent))
        for side in ("a", "b"):
            more = more.join(comps.select(F.col("node").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
        joined = written(connected_components(more), "nd-joined").select(F.col("node").alias("component"), F.col("component").alias("whole"))

        of = classes.select("cls", "sig", "rep", "use").join(comps.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        sizes = written(of.groupBy("component").agg(F.min("rep").alias("rep"), F.count("*").alias("use")).join(joined, "component", "left").withColumn("whole", F.coalesce("whole", "component")), "nd-sizes")
        wholes = sizes.groupBy("whole").agg(F.min("rep").alias("component_id"), F.count("*").alias("use"))
        ids = spread_join(sizes.select("component", "whole", F.col("use").alias("n")), written(wholes, "nd-wholes"), "whole").select("component", "component_id", F.col("n").alias("use"))
        found = spread_join(of.select("sig", "component", F.col("use").alias("n")), written(ids, "nd-ids"), "component").select("sig", "component_id", F.col("n").alias("use"))
        found = keep(written(found, "nd-found"))
        # rows without words of a doc_id that also has texts with words
        blank = feats.where("doc_id is not null and n_shingles = 0").select("doc_id").distinct()
        shared = sets.select("doc_id", "sig").join(blank, "doc_id", "left_semi").distinct().join(found, "sig").groupBy("doc_id").agg(F.min("component_id").alias("shared"), F.count("*").alias("n"))
        shared = keep(written(shared.select("doc_id", "shared"), "nd-blank"))
    out = spread_join(feats.select("doc_id", "n_shingles", "sig"), found, "sig").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    if not shared.isEmpty():
        empty = out.where("sig is null").drop("component_id").join(shared, "doc_id", "left").withColumnRenamed("shared", "component_id")
        out = out.where("sig is not null").unionByName(empty.select(out.columns))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns unchanged, whose doc_id is the smallest of its near-duplicate component.

    Rows with a null doc_id stay, and so do repeated rows of a doc_id that stays (equal texts are for exact dedup). An empty table
    stays empty. Ids to drop are broadcast while there are at most ``MOST_BROADCAST`` of them, else the join is shuffled.
    """
    with scratch():
        lost = keep(written(near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("_lost")).distinct(), "nd-lost"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"))  # a struct, so that no column of docs can clash
    lost = F.broadcast(lost) if lost.count() <= MOST_BROADCAST else lost
    return rows.join(lost, F.col("_doc.doc_id").cast("long") == F.col("_lost"), "left_anti").select("_doc.*")
