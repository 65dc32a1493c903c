import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import odd_docs

from colsieve.llm.mixing import mix, mixed
from colsieve.llm.sharding import greedy_cuts, least_capacity, oversize, shard_by_bytes, shard_cuts, unsettled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, epochs):
    """Clamp and reshare until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(epochs * sizes[s] for s in capped)
        target = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target | {s: float(epochs * sizes[s]) for s in capped}
        capped |= over


def test_mix_odd_rows(odd):
    size = [len(WORD.findall(t or "")) for _, t, *_ in odd_docs()]
    sizes = Counter()
    for (_, _, _, s, _), n in zip(odd_docs(), size, strict=True):
        sizes[s] += n
    want = water(dict(sizes), (5, 2, 1), 3)
    got = mix(odd).collect()
    assert sorted(r["size"] for r in got) == sorted(size)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mix(odd.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    rows = mixed(odd)
    assert rows.columns == odd.columns
    words = Counter()
    for r in rows.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert all(words[s] == taken[s] for s in want)


@pytest.mark.parametrize("seed", range(4))
def test_water_filling_by_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "w " * rng.randrange(0, 30), f"s{int(rng.paretovariate(0.4)) % 13}") for i in range(300)]
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(t) // 2
    want = water(dict(sizes), (5, 2, 1), 3)
    got = {r.source: r.target for r in mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == pytest.approx(want)


def test_mix_empty(none):
    assert mix(none).count() == 0 and mixed(none).count() == 0


def test_shards_of_odd_rows(odd):
    for shards in (1, 3, 24):
        got = shard_by_bytes(odd, shards).collect()
        assert len(got) == len(odd_docs())
        slots, bytes_, total, biggest = defaultdict(list), Counter(), 0, Counter()
        want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in odd_docs())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        for r in got:
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
            slots[r.shard].append(r.slot)
            bytes_[r.shard] += r["size"]
            total += r["size"]
            biggest[r["size"], r.text_crc32] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(bytes_.values()) <= max(total / shards + max(biggest.values()), max(biggest.values()))
        where = defaultdict(set)
        for r in got:
            where[r["size"], r.text_crc32].add(r.shard)
        assert all(len(v) == 1 for v in where.values())


def test_shards_empty(none):
    assert shard_by_bytes(none).count() == 0


def brute_capacity(sizes, shards):
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_least_capacity_by_dynamic_programming(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 9, 60]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 14))]
    shards = rng.randrange(1, 6)
    c = least_capacity(sizes, shards)
    assert c == brute_capacity(sizes, shards)
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    assert greedy_cuts(starts, sum(sizes), c, shards) is not None
    assert c == 1 or greedy_cuts(starts, sum(sizes), c - 1, shards) is None or c == -(-sum(sizes) // shards)


@pytest.mark.parametrize("seed", range(3))
def test_refined_search_is_exact(spark, seed):
    """Cuts found from prefixes only equal the capacity over all groups."""
    rng = random.Random(seed)
    groups = [(hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), rng.choice([10, 10, 10, 400]) * rng.randrange(1, 50)) for i in range(3000)]
    # crowd many groups below few first digits, so that units must be split
    groups = [("00" + k[2:] if i % 2 else k[:2] + "0000" + k[6:], b) for i, (k, b) in enumerate(groups)]
    alone, cuts = shard_cuts(spark.createDataFrame(groups, "key string, bytes long"), 24)
    rest = sorted((k, b) for k, b in groups if k not in alone)
    c = least_capacity([b for _, b in rest], 24 - len(alone))
    load = Counter()
    for k, b in rest:
        load[sum(k >= x for x in cuts)] += b
    assert max(load.values()) == c


def test_oversize_and_unsettled():
    assert oversize([70, 20, 5, 5], 100, 4) == 2 and oversize([], 0, 3) == 0 and oversize([9], 9, 1) == 0
    open_, cuts, capacity = unsettled([("a", 5, 1), ("b", 5, 1), ("c", 5, 1)], 3)
    assert (open_, cuts, capacity) == ([], [1, 2], 5)
