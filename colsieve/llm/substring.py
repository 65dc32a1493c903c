"""Removal of long passages that an earlier document already has: fixed-block anchors, extended to maximal repeats.

Method. Every document is cut into non-overlapping reference blocks of ``block`` words; a window of
``window`` >= 2 * block - 1 words always holds a whole block of the document it is taken from. The blocks are indexed by
a rolling hash and probed with the hash of every run of ``block`` words of every document. A run that meets a block of
another document is an anchor. From its anchors a document's repeats are extended: every window that holds an
anchor is looked up among the windows of all documents that hold one, a window also found in a smaller doc_id is
removed, and the union of such overlapping windows is the maximal repeat.

Scale. Documents are handled in slices of a few megabytes of text. A slice sends one entry for each distinct run, with the
note whether several of its texts have it, and one for each distinct window, with the least doc_id that has it; so a passage
shared by very many documents costs an entry for each slice, not for each document, and answers go back to slices. Entries
are dealt by hash into buckets of a fixed amount of text and packed as a few binary arrays for each bucket and slice, so the
shuffle takes about 5 bytes a word and not a row a word. Where there are more than ``COARSE`` buckets, slices deal to that many
groups of buckets first, and tasks that stream over a group pack the entries of many slices anew for each bucket; so rows stay packed
at any input, for a second shuffle of the entries. Texts move only for documents that have anchors; their keys are broadcast to keep
the others out of the shuffle while there are at most ``MOST_BROADCAST`` (about 100 bytes each), beyond that the join is shuffled.
Windows are compared by 64-bit hashes that depend on every word: two different windows agree with probability 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch, small_batches, written
from .text import joined_buffer, rolling, slices, word_hashes, words

WINDOW, BLOCK = 50, 25
#: Text for each bucket: the least, and the most once there would be more than MANY_BUCKETS.
BUCKET_BYTES, MANY_BUCKETS = (4 << 20, 64 << 20), 16384
COARSE, REPACKED = 4096, 4 << 20
MOST_BROADCAST = 200_000
KEY = 16
_LOW = np.uint64(0xFFFFFFFF)
#: bucket (below 0: a header), slice, two arrays of numbers and one of flags; where buckets are dealt in two steps, slice is null in the end
#: and ``more`` has the slices and their numbers of entries, and after the first step the bucket within its group.
_PACKED = "bucket long, slice long, a binary, b binary, c binary, more binary"


def planes(x: np.ndarray) -> bytes:
    """The bytes of x, all lowest bytes first: slowly changing high bytes compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that grow with the hash, so that sorted hashes are sorted by bucket."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def runs(bound: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-word runs inside texts of at least ``least`` words, and the texts they are in."""
    size = np.diff(bound)
    count = np.where(size >= max(least, n), size - n + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    return np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + bound[:-1][text], text


def _cuts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in arrays that are sorted together, and the end."""
    n = len(sorted_by[0])
    new = np.zeros(n, bool)
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), n)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "slice", "a", "b", "c", "more"])


def _dealt(of: np.ndarray, several: int, name: int, a: np.ndarray, b: np.ndarray, *flags: np.ndarray) -> list[tuple]:
    """Entries, sorted by bucket, as packed rows: one for each bucket, or for each group of several buckets."""
    group = of // several
    cut = _cuts(group).tolist() if len(of) else [0]
    more = lambda i, j: planes((of[i:j] % several).astype("<u4")) if several > 1 else None
    return [(int(group[i]), name, planes(a[i:j]), planes(b[i:j]), _bits(np.concatenate([f[i:j] for f in flags])), more(i, j)) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _repacked(several: int, kind: str, flags: int):
    """Rows of groups of buckets to rows of buckets, each with the entries of as many slices as come together; headers pass."""

    def packed(rows: list[dict]) -> pa.RecordBatch:
        count = [len(r["more"]) // 4 for r in rows]
        of = np.repeat([r["bucket"] * several for r in rows], count) + np.concatenate([unplanes(r["more"], "<u4") for r in rows])
        a, b = (np.concatenate([unplanes(r[c], kind) for r in rows]) for c in "ab")
        bits = np.concatenate([_flags(r["c"], flags * n).reshape(flags, n) for r, n in zip(rows, count, strict=True)], axis=1)
        name = np.repeat(np.array([r["slice"] for r in rows], np.int64), count)
        order = np.argsort(of, kind="stable")
        of, a, b, bits, name = of[order], a[order], b[order], bits[:, order], name[order]
        cut, out = _cuts(of).tolist(), []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            run = _cuts(name[i:j])
            out.append((int(of[i]), None, planes(a[i:j]), planes(b[i:j]), _bits(bits[:, i:j].ravel()), np.stack([name[i:j][run[:-1]], np.diff(run)]).astype("<i8").tobytes()))
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, entries = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    yield _batch([tuple(r.values())])
                    continue
                rows.append(r)
                entries += len(r["more"]) // 4
                if entries >= REPACKED:
                    yield packed(rows)
                    rows, entries = [], 0
        if rows:
            yield packed(rows)

    return run


def _by_bucket(packed: DataFrame, several: int, kind: str, flags: int) -> DataFrame:
    """Packed rows, dealt in two steps if there are groups of several buckets."""
    if several == 1:
        return packed
    salted = packed.repartition("bucket", F.pmod("slice", F.lit(64)))
    return salted.mapInArrow(_repacked(several, kind, flags), _PACKED)


def _slices(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The slices of a bucket's entries, run by run, and how many entries each run has."""
    runs = [np.array([[s], [len(a) // width]], np.int64) if more is None else np.frombuffer(more, "<i8").reshape(2, -1) for s, a, more in zip(pdf["slice"], pdf["a"], pdf["more"], strict=True)]
    names, count = np.concatenate(runs, axis=1)
    return names, count


def _name(*content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(content), digest_size=8).digest(), "little", signed=True)


def _ids(batch: pa.RecordBatch) -> tuple[bytes, bytes]:
    """The doc_ids of a slice and whether they are there, and its text keys (null: zeros)."""
    ids = np.asarray(batch.column("doc_id").fill_null(0), np.int64).tobytes() + np.asarray(batch.column("doc_id").is_valid()).tobytes()
    return ids, b"".join(k or bytes(KEY) for k in batch.column("text_key").to_pylist())


def _probes(buckets: int, several: int, window: int, block: int):
    """Slices of documents to packed entries: a header (bucket < 0) and, for each bucket, the slice's distinct runs.

    An entry is a run's hash, a text that has it, whether it is a block, and whether several texts have it; for these the header lists all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, at = joined_buffer(batch.column("text"))
                starts, ends, bound = words(buf, at)
                raw, (ids, keys) = buf.tobytes(), _ids(batch)
                shas = b"".join(hashlib.sha256(b" ".join(raw[at[i] : at[i + 1]].split())).digest() for i in range(len(batch)))
                name, entries, shared = _name(ids, keys, shas), [], (b"", b"")
                pos, text = runs(bound, block, window)
                if len(pos):
                    h = rolling(word_hashes(buf, starts, ends, False), block)[pos]
                    order = np.argsort(h, kind="stable")
                    h, text, aligned = h[order], text[order], ((pos - bound[:-1][text]) % block == 0)[order]
                    each = _cuts(h, text)[:-1]
                    h, text, aligned = h[each], text[each], np.logical_or.reduceat(aligned, each)
                    first = _cuts(h)
                    many = np.diff(first) > 1
                    of_many = np.repeat(many, np.diff(first))
                    shared = (h[of_many] & _LOW).astype("<u4").tobytes(), text[of_many].astype("<u4").tobytes()
                    first = first[:-1]
                    h, text, aligned = h[first], text[first], np.logical_or.reduceat(aligned, first)
                    entries = _dealt(bucket_of(h, buckets), several, name, (h & _LOW).astype("<u4"), text.astype("<u4"), aligned, many)
                sizes = np.diff(bound).astype("<i8").tobytes()
                head = (-1 - name % buckets, name, ids + sizes + keys + shas, shared[0], shared[1], None)
                yield _batch([head, *entries])

    return run


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's entries to those that are anchors: some block has the hash, and two documents have it."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["slice", "a", "b", "c"]]
    parts = [unplanes(x, "<u4") for x in pdf["a"]]
    flags = [_flags(x, 2 * len(p)).reshape(2, -1) for x, p in zip(pdf["c"], parts, strict=True)]
    aligned, several = np.concatenate(flags, axis=1)
    prints, text = np.concatenate(parts), np.concatenate([unplanes(x, "<u4") for x in pdf["b"]])
    value, which, times = np.unique(prints, return_inverse=True, return_counts=True)
    is_block = np.zeros(len(value), bool)
    is_block[which[aligned]] = True
    many = times > 1
    many[which[several]] = True
    return _answers(pdf, (is_block & many)[which], prints, text)


def _answers(pdf: pd.DataFrame, hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The entries hit, packed by slice; c is null, which tells them from headers."""
    names, count = _slices(pdf, a.itemsize)
    name = np.repeat(names, count)[hit]
    order = np.argsort(name, kind="stable")
    name, a, b = name[order], a[hit][order], b[hit][order]
    cut = _cuts(name).tolist() if len(name) else [0]
    rows = [(name[i], planes(a[i:j]), planes(b[i:j]), None) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame(rows, columns=["slice", "a", "b", "c"])


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """A slice's header and anchors to one row for each document; anchors null if it has none.

    Slices of equal content share one name, and have equal results: copies is how many there are.
    """
    heads = pdf[pdf["c"].notna()]
    head, found = heads.iloc[0], pdf[pdf["c"].isna()]
    n = len(head["a"]) // (8 + 1 + 8 + KEY + 32)
    ids, has_id, size = np.frombuffer(head["a"], "<i8", n), np.frombuffer(head["a"], bool, n, 8 * n), np.frombuffer(head["a"], "<i8", n, 9 * n)
    keys, shas = head["a"][17 * n : (17 + KEY) * n], head["a"][(17 + KEY) * n :]
    anchors: list = [None] * n
    if len(found):
        prints, text = (np.concatenate([unplanes(x, "<u4") for x in found[c]]) for c in ("a", "b"))
        shared, of = np.frombuffer(head["b"], "<u4"), np.frombuffer(head["c"], "<u4")
        also = np.isin(shared, prints)
        prints, text = np.concatenate([prints, shared[also]]), np.concatenate([text, of[also]])
        order = np.argsort(text, kind="stable")
        text, prints = text[order], prints[order]
        cut = _cuts(text)
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            anchors[text[i]] = planes(np.unique(prints[i:j]))
    doc_id = pd.arrays.IntegerArray(ids.copy(), ~has_id)
    pick = lambda x, width: [x[width * i : width * i + width] for i in range(n)]
    return pd.DataFrame({"doc_id": doc_id, "text_key": pick(keys, KEY), "n_words": size, "full_sha": pick(shas, 32), "anchors": anchors, "copies": len(heads)})


def _windows(buckets: int, several: int, window: int, block: int):
    """Documents with anchors to packed entries: a header with the slice's texts, and its distinct windows that hold an anchor.

    An entry is a window's hash, the least doc_id that has it, and whether other doc_ids of the slice do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, at = joined_buffer(batch.column("text"))
                starts, ends, bound = words(buf, at)
                hashes = word_hashes(buf, starts, ends, False)
                ids, some = np.asarray(batch.column("doc_id"), np.int64), []
                for i, anchors in enumerate(batch.column("anchors").to_pylist()):
                    h = hashes[bound[i] : bound[i + 1]]
                    if len(h) >= window:
                        anchor = np.isin((rolling(h, block) & _LOW).astype(np.uint32), unplanes(anchors, "<u4"))
                        before = np.concatenate(([0], np.cumsum(anchor)))
                        n, reach = len(h) - window + 1, window - block + 1
                        w = np.unique(rolling(h, window)[before[reach : reach + n] > before[:n]])
                        some.append((w, np.full(len(w), ids[i], np.int64)))
                if not some:
                    continue
                w, doc = (np.concatenate(x) for x in zip(*some, strict=True))
                if not len(w):
                    continue
                order = np.lexsort((doc, w))
                w, doc = w[order], doc[order]
                first = _cuts(w)
                many = doc[first[1:] - 1] != doc[first[:-1]]
                w, doc = w[first[:-1]], doc[first[:-1]]
                packed, keys = _ids(batch)
                name = _name(packed, keys)
                entries = _dealt(bucket_of(w, buckets), several, name, w, doc.view(np.uint64), many)
                yield _batch([(-1 - name % buckets, name, buf.tobytes(), at.astype("<i8").tobytes(), ids.tobytes() + keys, None), *entries])

    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's windows back to the slices where some doc_id has a smaller one before it, with the least doc_id of all."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["slice", "a", "b", "c"]]
    parts = [unplanes(x, "<u8") for x in pdf["a"]]
    doc = np.concatenate([unplanes(x, "<i8") for x in pdf["b"]])
    several = np.concatenate([_flags(x, len(p)) for x, p in zip(pdf["c"], parts, strict=True)])
    w = np.concatenate(parts)
    value, which = np.unique(w, return_inverse=True)
    least = np.full(len(value), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    least = least[which]
    return _answers(pdf, (doc > least) | several, w, least)


def _removed(window: int, with_text: bool):
    """A slice's texts and repeated windows to what is left: words removed, digest of the words kept, and the words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf[pdf["c"].isna()]
        columns = ["doc_id", "text_key", "n_removed", "kept_sha"] + ["kept_text"] * with_text
        if not len(found):
            return pd.DataFrame([], columns=columns)
        head = pdf[pdf["c"].notna()].iloc[0]
        raw, at = head["a"], np.frombuffer(head["b"], "<i8")
        n = len(at) - 1
        ids, keys = np.frombuffer(head["c"], "<i8", n), head["c"][8 * n :]
        w, least = np.concatenate([unplanes(x, "<u8") for x in found["a"]]), np.concatenate([unplanes(x, "<i8") for x in found["b"]])
        order = np.argsort(w)
        w, least = w[order], least[order]
        buf = np.frombuffer(raw, np.uint8)
        starts, ends, bound = words(buf, at)
        hashes, rows = word_hashes(buf, starts, ends, False), []
        for i in range(n):
            h = hashes[bound[i] : bound[i + 1]]
            own = rolling(h, window)
            place = np.minimum(np.searchsorted(w, own), len(w) - 1)
            hit = np.flatnonzero((w[place] == own) & (least[place] < ids[i]))
            if not len(hit):
                continue
            change = np.zeros(len(h) + 1, np.int64)
            change[hit] += 1
            np.subtract.at(change, hit + window, 1)
            left = np.cumsum(change[:-1]) == 0
            kept = b" ".join(compress(raw[at[i] : at[i + 1]].split(), left.tolist()))
            rows.append((ids[i], keys[KEY * i : KEY * i + KEY], int(len(h) - left.sum()), hashlib.sha256(kept).digest(), kept.decode())[: len(columns)])
        return pd.DataFrame(rows, columns=columns)

    return run, "doc_id long, text_key binary, n_removed long, kept_sha binary" + ", kept_text string" * with_text


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of docs (doc_id, text, ...).

    Words are split at ASCII white space and compared as they are. A word is removed if it lies in a window of
    ``window`` words that also starts in a document with a smaller doc_id; all windows are judged on the input. kept_sha256 is of the kept
    words joined by one space; null and empty texts have no words. Rows that repeat a doc_id are one document as far as "smaller"
    goes, so they take nothing from each other; each gets the answer for its own text, whether the texts are equal or not. A null
    doc_id keeps all its words. kept_text is given only for documents that lose words, null for the others. Columns other than doc_id
    and text are not read.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // min(BUCKET_BYTES[1], max(BUCKET_BYTES[0], total // MANY_BUCKETS))))
    several = max(1, -(-buckets // COARSE))
    with scratch():
        packed = _by_bucket(texts.mapInArrow(_probes(buckets, several, window, block), _PACKED), several, "<u4", 2)
        matched = packed.groupBy("bucket").applyInPandas(_match, "slice long, a binary, b binary, c binary")
        own = matched.groupBy("slice").applyInPandas(_by_document, "doc_id long, text_key binary, n_words long, full_sha binary, anchors binary, copies int")
        own = own.select("doc_id", "text_key", "n_words", "full_sha", "anchors", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
        own = keep(written(own, "ss-documents"))

        same = ["doc_id", "text_key"]
        with_anchors = own.where("anchors is not null and doc_id is not null").select(*same, "anchors").dropDuplicates(same)
        ids = written(with_anchors.select(same), "ss-with-anchors")
        some = texts.join(F.broadcast(ids), same, "left_semi") if ids.count() <= MOST_BROADCAST else texts
        entries = with_anchors.join(some.dropDuplicates(same), same).mapInArrow(_windows(buckets, several, window, block), _PACKED)
        entries = _by_bucket(entries, several, "<u8", 1)
        found = entries.groupBy("bucket").applyInPandas(_repeated, "slice long, a binary, b binary, c binary")
        cut = keep(written(found.groupBy("slice").applyInPandas(*_removed(window, with_text)), "ss-cut"))
    out = own.drop("anchors").join(cut, same, "left")
    sha = F.lower(F.hex(F.coalesce("kept_sha", "full_sha"))).alias("kept_sha256")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), sha, *["kept_text"] * with_text)
