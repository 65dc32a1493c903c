import hashlib
import random
from collections import Counter

import pytest
from helpers import odd_docs, words_of

from colsieve.llm import substring
from colsieve.llm.substring import planes, remove_repeats, unplanes
from colsieve.llm.text import slices


def brute(docs, window):
    first, out = {}, {}
    for i, t, *_ in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if first.setdefault(key, i) < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_odd_rows(odd, none):
    want = brute(odd_docs(), 50)
    got = remove_repeats(odd).collect()
    assert len(got) == len(odd_docs())
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert sum(r.n_removed > 0 for r in got) >= 4
    assert remove_repeats(none).count() == 0


def test_slices_of_equal_content(spark):
    """Parts with the same rows give their rows once each; a null id and id 0 stay apart."""
    docs, want = [d[:2] for d in odd_docs()], brute(odd_docs(), 50)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = remove_repeats(df.union(df).union(df)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in docs * 3)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got if r.doc_id is not None)
    one = [spark.createDataFrame([(i, "a b c")], "doc_id long, text string") for i in (None, 0)]
    assert Counter(r.doc_id for r in remove_repeats(one[0].union(one[1])).collect()) == Counter([None, 0])


@pytest.mark.parametrize(("window", "block", "coarse"), [(50, 25, 4096), (7, 4, 3), (9, 2, 4096), (50, 25, 1)])
def test_planted_passages(spark, monkeypatch, window, block, coarse):
    """Buckets dealt at once, and in two steps; many small slices."""
    monkeypatch.setattr(substring, "COARSE", coarse)
    monkeypatch.setattr(substring, "REPACKED", 50)
    monkeypatch.setattr(substring, "slices", lambda batch, column: slices(batch, column, 2000))
    rng = random.Random(window)
    passages = [[f"p{k}w{j}" for j in range(rng.randrange(window - 2, 3 * window))] for k in range(6)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            w += [f"u{rng.randrange(30)}" for _ in range(rng.randrange(12))] + (p if rng.random() < 0.5 else p[cut:])
        docs.append((i, " ".join(w) if w else None))
    got = {r.doc_id: r[1:4] for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window, block, with_text=True).collect()}
    assert {i: tuple(v) for i, v in got.items()} == brute(docs, window)


@pytest.mark.parametrize("coarse", [4096, 3])
def test_one_doc_id_over_different_texts(spark, monkeypatch, coarse):
    """Every row gets the answer for its own text, and rows of one doc_id take nothing from each other."""
    monkeypatch.setattr(substring, "COARSE", coarse)
    a, c = " ".join(f"a{k}" for k in range(60)), " ".join(f"c{k}" for k in range(20))
    docs = [(1, a), (2, a), (2, c), (2, a + " tail"), (3, c + " " + a), (3, a), (3, a), (0, c), (None, a), (3, ""), (4, None)]
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_text=True).collect()
    want = []
    for i, t in docs:
        w, gone = (t or "").split(), set()
        earlier = {tuple(x[k : k + 50]) for j, u in docs if i is not None and j is not None and j < i for x in [(u or "").split()] for k in range(len(x) - 49)}
        for k in range(len(w) - 49):
            if tuple(w[k : k + 50]) in earlier:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), *r[1:])) for r in got)


def test_window_must_hold_a_block(none):
    with pytest.raises(ValueError):
        remove_repeats(none, 48, 25)


def test_planes():
    import numpy as np

    for kind in ("<u4", "<u8", "<i8"):
        x = np.array([0, 1, 2**31 - 1, 77], kind)
        assert (unplanes(planes(x), kind) == x).all() and len(unplanes(planes(x[:0]), kind)) == 0
