import glob
import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import odd_docs
from pyspark.sql import functions as F

from colsieve.llm.exactdedup import BinaryFuse8, Store, deduplicated, exact_duplicates, sha256


def norm(text):
    return (text or "").encode().lower()


def test_odd_rows(odd):
    groups = defaultdict(list)
    for i, t, *_ in odd_docs():
        groups[norm(t)].append(i)
    got = exact_duplicates(odd).collect()
    assert len(got) == len(odd_docs())
    by_sha = {hashlib.sha256(b).hexdigest(): ids for b, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("is_new", ["false", "true", "doc_id % 3 = 0"])
def test_batches_do_not_change_the_result(odd, is_new):
    pick = lambda df: sorted(map(str, df.select("doc_id", "keep_id", "group_size", "text_sha256").collect()))
    assert pick(exact_duplicates(odd, is_new)) == pick(exact_duplicates(odd))


def test_deduplicated(odd):
    out = deduplicated(odd)
    assert out.columns == odd.columns
    texts = [norm(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, *_ in odd_docs()})


def test_empty(none):
    assert exact_duplicates(none).count() == 0 and deduplicated(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    f = BinaryFuse8.from_bytes(BinaryFuse8.build(np.concatenate([keys, keys])).to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.02
    if n >= 60_000:
        assert len(f.prints) < 1.25 * n


def weak(body):
    """A digest of a few values only, so that many texts share one."""
    return F.unhex(F.substring(F.sha2(body, 256), 1, 1))


@pytest.mark.parametrize("is_new", [None, "false", "true"])
def test_texts_that_share_a_digest_are_told_apart(odd, is_new):
    got = exact_duplicates(odd, is_new, weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    want = exact_duplicates(odd).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("digest", [sha256, weak])
def test_a_store_of_three_batches(spark, tmp_path, digest):
    """Each batch adds a snapshot and changes no file of the earlier ones; together they hold the groups of all rows."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "a", "b", None, "", "Ä", "ä", *(f"text {k}" for k in range(60))])) for i in range(300)]
    store, seen = Store(spark, f"file://{tmp_path}/store", digest), {}
    for n in range(3):
        store.add(spark.createDataFrame(rows[n * 100 : n * 100 + 100], "doc_id long, text string"))
        files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/store/**/*", recursive=True) if os.path.isfile(f)}
        assert all(files.get(f) == t for f, t in seen.items())
        seen = files
    assert len(store.snapshots()) == 3
    want = defaultdict(list)
    for i, t in rows:
        want[norm(t)].append(i)
    texts = defaultdict(list)
    for t, ids in want.items():
        texts[hashlib.sha256(t).digest() if digest is sha256 else bytes([int(hashlib.sha256(t).hexdigest()[0], 16)])].append(ids)
    known = store.known().groupBy("digest").agg(F.sum("texts").alias("texts"), F.sum("size").alias("size"), F.max("keep_id").alias("keep_id")).collect()
    assert {bytes(r.digest): (r.texts, r.size, r.keep_id) for r in known} == {d: (len(g), sum(map(len, g)), max(map(max, g))) for d, g in texts.items()}
