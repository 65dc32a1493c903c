import itertools

import numpy as np
import pytest
from helpers import components

from colsieve.llm import lattice
from colsieve.llm.common import spanning


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(scale=1.5, size=(400, 8))
    got = lattice.decode_e8(x)
    near = lattice.lattice_neighbours()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(axis=1), 2)
    own = ((x - got) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    for v in near:
        assert (own <= ((x - got - v) ** 2).sum(axis=1) + 1e-9).all()
    twice = 2 * got
    assert np.allclose(twice, np.rint(twice)) and (got.sum(axis=1) % 2 == 0).all() and all(len({int(round(2 * c)) % 2 for c in p}) == 1 for p in got)


def vectors(seed=3, n=260, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.2, 0.3]) * np.linalg.norm(base) / 4
        rows.append((i, [float(np.float32(x)) for x in v]))
    odd = [None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], rows[5][1], rows[5][1], [3 * x for x in rows[7][1]], [1e-30] * dim, [1e30] * dim]
    return rows + [(n + i, v) for i, v in enumerate(odd)] + [(None, rows[9][1])]


def brute(rows, least=0.95):
    units = [lattice.unit(v) for _, v in rows]
    n = [0] * len(rows)
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
            n[a] += 1
            n[b] += 1
            links.append((a, b))
    comp = components(range(len(rows)), links)
    smallest = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            smallest[c] = min(smallest.get(c, 10**9), rows[k][0])
    return sorted((str(rows[k][0]), n[k], smallest.get(comp[k])) for k in range(len(rows)))


@pytest.mark.parametrize("small", [0, 10**9])
def test_links_and_components(spark, monkeypatch, small):
    """Open cells in blocks only, and in joins only."""
    monkeypatch.setattr(lattice, "SMALL", small)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], "vec_id long, embedding array<float>, class string, cell string, n int")
    monkeypatch.setattr(lattice, "BLOCK", 8)  # several blocks in a component
    got = lattice.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1000, 50_000, 10**6, 10**9])
def test_recall_of_cells_at_the_threshold(n):
    """Pairs at exactly 0.95 share a cell in some table, and random ones rarely do, with the plan for any number of vectors."""
    how = lattice.plan(n, 0.95)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1)[:, None] * x
    g /= np.linalg.norm(g, axis=1)[:, None]
    (hx, px), (hy, py) = lattice.cells(x, how), lattice.cells(0.95 * x + np.sqrt(1 - 0.95**2) * g, how)
    assert px.shape[1] == how.tables * how.parts * lattice.PROBES
    met = [bool(({*a} & {*c}) or ({*a} & {*d}) or ({*b} & {*c})) for a, b, c, d in zip(hx.tolist(), px.tolist(), hy.tolist(), py.tolist(), strict=True)]
    assert np.mean(met) > 0.99
    same, _, unrelated = lattice._chances(how.width, 0.95)
    assert n * unrelated**how.parts <= lattice.CROWD
    home = sum(len({*a} & {*b}) for a, b in itertools.combinations(hx.tolist(), 2)) / (400 * 399 / 2 * how.tables)
    assert home < 30 * unrelated**how.parts + 1e-4


def test_spanning_links():
    rng = np.random.default_rng(4)
    for _ in range(20):
        linked = rng.random((9, 7)) < rng.choice([0.05, 0.2, 0.9])
        every = [(i, 9 + j) for i, j in zip(*np.nonzero(linked), strict=True)]
        some = [(i, 9 + j) for i, j in spanning(linked)]
        assert set(some) <= set(every) and len(some) < 16
        assert components(range(16), some) == components(range(16), every)
