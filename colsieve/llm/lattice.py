"""Near duplicates of embeddings by hashing into the E8 lattice.

Method. In each table a unit vector is projected onto some times eight random directions, divided by a width, and each
part is decoded to the nearest point of the E8 lattice; the points together are its cell. Besides its own cell it probes those in which
one part moves to one of the ``PROBES`` nearest neighbouring lattice points. Candidates that share a cell are verified by cosine
in double precision.

The number of parts, the width and the number of tables follow from the number of vectors (``plan``): unrelated vectors that share a
cell stay about ``CROWD`` a table for each vector at any size, and a pair at the threshold misses all tables with probability ``MISS``
at most. Both probabilities are measured by simulation; projections of unit vectors are normal in any dimension, so eight
dimensions suffice.

Scale. Equal vectors are one class. In a cell every class is compared with the smallest resident only; of cells that still
hold several components the classes outside the largest one meet the others: in a join where that makes at most ``SMALL`` pairs
a cell, else in pairs of blocks of ``BLOCK`` classes that return only as many links as connect them. A 128-bit sketch of signs
rules out pairs before any vector moves (at 0.95 they differ in 13 bits, 3.4 deviation; up to 33 are let through, so one pair in
10^7 or fewer is lost). A lead that meets very many classes is copied, and these are dealt to its copies. With the components known,
links are counted exactly inside each component, in pairs of blocks, so no task holds more than two blocks and no pair becomes a row.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, keep, scratch, spanning, spread_join, written
from .text import mixed

PROBES, SEED = 4, 8
CROWD, MISS, WIDTHS, MOST_PARTS = 0.25, 1e-4, (2.4, 2.2, 2.0, 1.8, 1.6, 1.4), 5
MOST_DIFFERENT, BLOCK, SMALL = 33, 1024, 1024


def lattice_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_NEIGHBOURS = lattice_neighbours()


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: E8 is D8 and D8 shifted by 1/2."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of lattice points (..., 8)."""
    out = np.full(points.shape[:-1], salt * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(8):
        out = mixed(out ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) + np.uint64(k + 1)
    return out


class Plan(NamedTuple):
    parts: int
    width: float
    tables: int


def _probed(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The ``PROBES`` lattice points around each point that are nearest to x."""
    best = np.argpartition(-((x - point) @ _NEIGHBOURS.T), PROBES, axis=1)[:, :PROBES]
    return point[:, None] + _NEIGHBOURS[best]


@functools.cache
def _chances(width: float, least: float, n: int = 20_000) -> tuple[float, float, float]:
    """For one part: how often a pair at the threshold has one point, or only probes the other's; how often unrelated vectors have one."""
    rng = np.random.default_rng([SEED, 2])
    x = rng.normal(size=(n, 8))
    y = least * x + math.sqrt(1 - least * least) * rng.normal(size=(n, 8))
    x, y = x / width, y / width
    a, b = decode_e8(x), decode_e8(y)
    near = (_probed(x, a) == b[:, None]).all(axis=2).any(axis=1) | (_probed(y, b) == a[:, None]).all(axis=2).any(axis=1)
    _, k = np.unique(_key(a, 0), return_counts=True)
    return float((a == b).all(axis=1).mean()), float(near.mean()), float((k * (k - 1.0)).sum() / (n * (n - 1.0)))


def plan(n: int, least: float) -> Plan:
    """Of the plans that keep cells uncrowded with n vectors, the one with the fewest cells a vector."""
    best = None
    for parts in range(2, MOST_PARTS + 1):
        for width in WIDTHS:
            same, near, unrelated = _chances(width, least)
            meet = min(same**parts + parts * same ** (parts - 1) * near, 1 - 1e-9)
            if n * unrelated**parts <= CROWD and meet > 0:
                tables = math.ceil(math.log(MISS) / math.log(1 - meet))
                cost = tables * (1 + parts * PROBES)
                if best is None or cost < best[0]:
                    best = cost, Plan(parts, width, tables)
    if best is None:
        raise ValueError("no plan for so many vectors at this threshold")
    return best[1]


def cells(units: np.ndarray, how: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n x tables) and probed cells (n x tables * parts * PROBES) of unit vectors."""
    dim = units.shape[1]
    rng = np.random.default_rng([SEED, dim])
    home, probed = [], []
    for t in range(how.tables):
        keys, near = [], []
        for part in range(how.parts):
            x = units @ (rng.normal(size=(dim, 8)) / how.width)
            point = decode_e8(x)
            salt = dim * 1000 + t * how.parts + part
            keys.append(_key(point, salt) * np.uint64(2 * part + 1))
            near.append(_key(_probed(x, point), salt) * np.uint64(2 * part + 1))
        total = functools.reduce(np.add, keys)
        home.append(mixed(total)[:, None])
        probed += [mixed((total - k)[:, None] + m) for k, m in zip(keys, near, strict=True)]
    return np.concatenate(home, axis=1).view(np.int64), np.concatenate(probed, axis=1).view(np.int64)


def sign_sketch(units: np.ndarray) -> np.ndarray:
    """The signs of 128 random projections as two 64-bit words."""
    x = units @ np.random.default_rng([SEED, units.shape[1], 1]).normal(size=(units.shape[1], 128)) > 0
    return np.packbits(x, axis=1).view(np.int64)


def unit(vector) -> np.ndarray | None:
    """The vector in double precision at length 1; None for null, empty, zero, or null or non-finite components."""
    if vector is None or len(vector) == 0:
        return None
    v = np.array([np.nan if x is None else x for x in vector] if not isinstance(vector, np.ndarray) else vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``class``: the same number for equal vectors, null if a vector can't be compared."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            ok = unit(v) is not None
            out.append(int.from_bytes(hashlib.blake2b((np.array(v, np.float64) + 0.0).tobytes(), digest_size=8).digest(), "little", signed=True) if ok else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["vec_id", "embedding", "class"])


def _celled(how: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("class").to_numpy(), [unit(v) for v in batch.column("embedding").to_pylist()]
            for dim in sorted({len(v) for v in vectors}):
                own = [i for i, v in enumerate(vectors) if len(v) == dim]
                for low in range(0, len(own), 1024):
                    part = own[low : low + 1024]
                    u = np.array([vectors[i] for i in part])
                    home, probed = cells(u, how)
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (sign_sketch(u), home, probed)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), *lists], names=["class", "sketch", "home", "probed"])

    return run, "class long, sketch array<long>, home array<long>, probed array<long>"


def _cosines(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(unit(x), unit(y)) for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            c = np.array([float(x @ y) if len(x) == len(y) else 0.0 for x, y in pairs])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(c, pa.float64()), pa.array(c >= least)], names=["a", "b", "cosine", "linked"])

    return run, "a long, b long, cosine double, linked boolean"


def _count_links(least: float):
    """One pair of blocks of one component: for each class the number of vectors linked in the other block."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        by_dim, done = {}, []
        for i, v in enumerate(pdf["embedding"]):
            by_dim.setdefault(len(v), []).append(i)
        for own in by_dim.values():
            part = pdf.iloc[own]
            u, n, cls, block = np.array([unit(v) for v in part["embedding"]]), part["n"].to_numpy(), part["class"].to_numpy(), part["block"].to_numpy()
            sides = [block == key[1], block == key[2]]
            for x, y in [(0, 1)] if key[1] == key[2] else [(0, 1), (1, 0)]:
                linked = u[sides[x]] @ u[sides[y]].T >= least
                done.append(pd.DataFrame({"class": cls[sides[x]], "links": linked @ n[sides[y]]}))
        return pd.concat(done)

    return run, "class long, links long"


def _block_links(least: float):
    """One block of minor classes against one block of all classes of a cell: linked pairs that connect all linked ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, minor, found = [unit(v) for v in pdf["embedding"]], pdf["minor"].to_numpy(), []
        cls, component = pdf["class"].to_numpy(), pdf["component"].to_numpy()
        size = np.array([len(v) for v in vectors])
        for dim in np.unique(size):
            x, y = (np.flatnonzero((size == dim) & (minor == side)) for side in (True, False))
            if len(x) and len(y):
                linked = (np.array([vectors[i] for i in x]) @ np.array([vectors[i] for i in y]).T >= least) & (component[x][:, None] != component[y])
                found += [(cls[x[i]], cls[y[j]]) for i, j in spanning(linked)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run, "a long, b long"


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b) that are linked; an a with very many partners is copied."""
    leads = pairs.groupBy("a").agg(F.count("*").alias("use")).withColumn("copies", F.ceil(F.col("use") / BLOCK).cast("int"))
    leads = written(leads, "lh-leads")
    dealt = spread_join(pairs, leads, "a", "inner").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    left = leads.join(classes.select(F.col("class").alias("a"), F.col("embedding").alias("va")), "a").select("a", "va", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    right = classes.select(F.col("class").alias("b"), F.col("embedding").alias("vb"))
    return written(dealt.join(right, "b").join(left, ["a", "copy"]).mapInArrow(*_cosines(least)).where("linked").select("a", "b"), "lh-verified")


def _crossed(open_: DataFrame, classes: DataFrame, least: float, similar: str) -> DataFrame:
    """Links between different components among the classes (cell, class, component, sketch) that share a cell."""
    order = F.struct("k", "component")
    per_cell = open_.groupBy("cell", "component").agg(F.count("*").alias("k")).groupBy("cell").agg(F.max(order).alias("main"), F.sum("k").alias("k"))
    per_cell = per_cell.select("cell", F.col("main.component").alias("main"), F.col("k").alias("use"), F.ceil((F.col("k") - F.col("main.k")) / BLOCK).cast("int").alias("bx"), F.ceil(F.col("k") / BLOCK).cast("int").alias("by"), ((F.col("k") - F.col("main.k")) * F.col("k") <= SMALL).alias("small"))
    per_cell = written(per_cell, "lh-cells-open")
    small = open_.join(per_cell.where("small").select("cell", "main"), "cell")
    x = small.where("component <> main").select("cell", F.col("class").alias("a"), F.col("component").alias("xk"), F.col("sketch").alias("sa"))
    y = small.select("cell", F.col("class").alias("b"), F.col("component").alias("yk"), F.col("sketch").alias("sb"))
    few = x.join(y, "cell").where(F.expr("xk <> yk") & F.expr(similar)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(written(few, "lh-few"), classes, least)
    large = per_cell.where("not small").drop("small")
    if large.isEmpty():
        return links
    placed = spread_join(open_.select("cell", "class", "component"), large, "cell", "inner").join(classes.select("class", "embedding"), "class")
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = placed.where("component <> main").select("cell", own("bx").alias("i"), all_("by").alias("j"), "class", "component", "embedding", F.lit(True).alias("minor"))
    y = placed.select("cell", all_("bx").alias("i"), own("by").alias("j"), "class", "component", "embedding", F.lit(False).alias("minor"))
    return links.unionByName(x.unionByName(y).groupBy("cell", "i", "j").applyInPandas(*_block_links(least)))


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, ...).

    A link is a cosine of at least ``least`` in double precision between two rows. Vectors that are null, empty, zero,
    or hold null or non-finite components, and vectors of different lengths, link with nothing. Rows that repeat a
    vec_id count as vectors of their own. A null vec_id is linked like any other, and is never the smallest of its
    component unless all are null. Columns other than vec_id and embedding are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    similar = f"bit_count(sa[0] ^ sb[0]) + bit_count(sa[1] ^ sb[1]) <= {MOST_DIFFERENT}"
    with scratch():
        keyed = written(rows.mapInArrow(_classed, "vec_id long, embedding array<double>, class long"), "lh-rows")
        hashed = keep(written(keyed.select("vec_id", "class"), "lh-ids"))
        classes = keyed.where("class is not null").groupBy("class").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"))
        classes = written(classes, "lh-classes")
        coded = written(classes.select("class", "embedding").mapInArrow(*_celled(plan(classes.count(), least))), "lh-cells")
        sketch = coded.select("class", "sketch")
        at = coded.select("class", F.explode("home").alias("cell"), F.lit(True).alias("home")).unionByName(coded.select("class", F.explode("probed").alias("cell"), F.lit(False).alias("home")))
        lead = at.groupBy("cell").agg(F.min(F.when(F.col("home"), F.col("class"))).alias("lead"), F.count("*").alias("members"), F.count("*").alias("use")).where("lead is not null and members > 1")
        members = written(spread_join(at, written(lead, "lh-leads"), "cell", "inner").drop("home"), "lh-members")

        star = written(members.where("class <> lead").select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct(), "lh-star")
        leads = star.groupBy("a").agg(F.count("*").alias("use")).join(sketch.select(F.col("class").alias("a"), F.col("sketch").alias("sa")), "a")
        star = star.join(sketch.select(F.col("class").alias("b"), F.col("sketch").alias("sb")), "b")
        star = written(spread_join(star, written(leads, "lh-leads"), "a", "inner").where(similar).select("a", "b"), "lh-pairs")
        links = _verified(star, classes, least)
        comps = written(connected_components(links), "lh-components")
        own = members.where("members > 2").select("cell", "class").distinct().join(comps.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        own = written(own, "lh-own")
        several = own.groupBy("cell").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("use")).where("c0 < c1").select("cell", "use", F.lit(True).alias("open"))
        open_ = written(spread_join(own, written(several, "lh-several"), "cell", "inner").drop("open").join(sketch, "class"), "lh-open")
        if not open_.isEmpty():
            links = links.unionByName(_crossed(open_, classes, least, similar))
            comps = written(connected_components(links), "lh-components")

        sizes = written(comps.groupBy("component").agg(F.count("*").alias("use")).withColumn("blocks", F.ceil(F.col("use") / BLOCK).cast("int")), "lh-sizes")
        inside = spread_join(comps.select(F.col("node").alias("class"), "component"), sizes, "component", "inner").join(classes, "class")
        inside = inside.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "embedding", "n", "block")
        counted = dealt.groupBy("component", "low", "high").applyInPandas(*_count_links(least)).groupBy("class").agg(F.sum("links").alias("links"))

        # by class: its links, and the smallest vec_id of its component
        of = classes.select("class", "n").join(comps.select(F.col("node").alias("class"), "component"), "class", "left").join(counted, "class", "left")
        ids = keyed.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("id"))
        of = of.join(ids, "class").select("class", "id", F.col("n"), F.coalesce("component", "class").alias("component"), (F.coalesce("links", "n") - 1).cast("long").alias("n_links"))
        of = written(of, "lh-of")
        least_ids = written(of.groupBy("component").agg(F.min("id").alias("smallest"), F.count("*").alias("use")), "lh-smallest")
        of = keep(written(spread_join(of, least_ids, "component").select("class", "n_links", "smallest", F.col("n").alias("use")), "lh-found"))
    out = spread_join(hashed, of, "class").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))
