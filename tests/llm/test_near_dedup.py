import numpy as np
from helpers import components, odd_docs, words_of

from colsieve.llm.minhash import _counts, _intersections, _permutations, band_keys, deduplicated, near_duplicates, signature, sketch


def shingles(text, n):
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent=80):
    sets = {}
    for i, t, *_ in docs:
        if i is not None:
            sets[i] = shingles(t, n)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, links)


def check(spark_rows, docs, n):
    sets, comps = brute(docs, n)
    assert len(spark_rows) == len(docs)
    for r in spark_rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comps[r.doc_id], comps[r.doc_id] == r.doc_id)


def test_odd_rows(odd):
    check(near_duplicates(odd, 2).collect(), odd_docs(), 2)


def test_group_of_copies_near_the_threshold(spark):
    """One large group in which many pairs are just above or below 0.8 and not all meet the lead."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 9), replace=False):
            w[k] = f"x{rng.integers(0, 40)}"
        docs.append((i, " ".join(w)))
    check(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect(), docs, 2)


def test_deduplicated_keeps_columns(odd):
    out = deduplicated(odd, words=2)
    _, comps = brute(odd_docs(), 2)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(i for i, *_ in odd_docs() if i is not None and comps[i] == i)


def test_empty(none):
    assert near_duplicates(none, 5).count() == 0 and deduplicated(none).count() == 0


def test_signature_is_circulant_and_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate([a[:2000], rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)])
    one = signature(a[:1], 160)
    first, second = _permutations(160)
    assert len(np.unique(first)) == len(np.unique(second[:, 0])) == 1 << 20
    place = int(first[int(a[0] >> np.uint64(44))])
    assert (one == second[(place + np.arange(160)) % (1 << 20), 0]).all()
    same = np.mean(signature(a, 160) == signature(b, 160))
    assert abs(same - 0.5) < 0.15
    assert len(set(band_keys(signature(a, 160)).tolist())) == 32


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50_000, rng.integers(1, 9000)).astype(np.uint64)) for _ in range(9)]
    got = _intersections(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]


def test_repeated_doc_ids_with_different_texts(spark):
    """One doc_id over several texts is one node with the links of all of them."""
    rng = np.random.default_rng(9)
    some = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**6, 60))
    a, b, c, d = some(), some(), some(), some()
    docs = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (5, c + " z"), (5, d), (5, ""), (6, d + " u"), (7, ""), (7, None), (8, some()), (8, some()), (9, b + " v")] + [(10, some()) for _ in range(20)] + [(10, a + " w")]
    comps = components({i for i, _ in docs}, [(1, 2), (1, 3), (4, 5), (5, 6), (1, 9), (1, 10)])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (2, 5):
        got = near_duplicates(df, n).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(shingles(t, n)), comps[i], comps[i] == i) for i, t in docs)
    assert sorted({r.doc_id for r in deduplicated(df).collect()}) == [1, 4, 7, 8]


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 70_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for share in (0.9, 0.5, 0.0):
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 2**63, n - int(share * n), dtype=np.uint64)]))
            if len(b):
                assert np.minimum(*_counts([sketch(a), sketch(b)])).sum() >= len(np.intersect1d(a, b))


def test_clashing_names_inside(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 3, 4), (None, None, 5, 6)], "doc_id long, text string, _lost long, _doc long")
    out = deduplicated(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 1").collect()))
