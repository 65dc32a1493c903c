"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Method. Features are the distinct lower-cased words of a text and their prefixes of 3 to 6 letters; of those in at
least ``LEAST_ROWS`` toxic rows of the training sample the ones most strongly associated with the label are kept by name,
so no two features collide; more than ``MOST_FEATURES`` of them lower the recall on held-out rows (README). One
weight vector serves all thresholds: P(grade <= k) = sigmoid(threshold_k - weights . features), with ordered
thresholds. The score is the expected grade. Labels say toxic or not; training grades of toxic rows grow with the
number of distinct words that hold a strongly toxic feature (1, up to 3, more), clean rows have grade 0.

Scale. The model is fitted on at most ``sample_rows`` labelled documents, chosen by a hash of doc_id, so that it costs
the same at any input; it has at most ``MOST_FEATURES`` weights. Features of the sample's whole texts are counted by tasks;
the driver gets the chosen features and, for each document, which of them it has, never a text. Scoring is one pass without
a shuffle over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, written
from .text import slices

SAMPLE_ROWS = 6000
MOST_FEATURES, LEAST_ROWS, MOST_WORDS = 2048, 3, 150_000
GRADES, REJECT = 4, 0.3
_words = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[str]:
    """The word itself and its prefixes, marked by a trailing star."""
    return [word, *(word[:n] + "*" for n in range(3, 7) if len(word) >= n)]


def text_features(text: str | None) -> set[str]:
    """The distinct features of a text."""
    return {f for w in set(_words((text or "").lower())) for f in word_features(w)}


@dataclass
class Model:
    """Feature indexes by name, weights, and the GRADES - 1 ordered thresholds."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, text: str | None) -> set[int]:
        known, found = self.known, set()
        for w in set(_words((text or "").lower())):
            if (ids := known.get(w)) is None:
                if len(known) >= MOST_WORDS:
                    known.clear()
                ids = known[w] = tuple(self.index[f] for f in word_features(w) if f in self.index)
            if ids:
                found.update(ids)
        return found

    def score(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ...; their sum is the expected grade. All are 0 for a text without features: nothing speaks against it."""
        if not (found := self.features(text)):
            return np.zeros(GRADES - 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[list(found)].sum(), -50, 50)))


def loss_and_gradient(params: np.ndarray, col: np.ndarray, row: np.ndarray, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades plus the penalty, and its gradient.

    params: the weights, the first threshold and the logarithms of the steps to the others, so that they stay ordered.
    (row, col): the features that each row has.
    """
    n, k = len(grade), len(params) - (GRADES - 1)
    w, steps = params[:k], np.exp(params[k + 1 :])
    theta = np.concatenate([[params[k]], params[k] + np.cumsum(steps)])
    z = np.bincount(row, w[col], n)
    cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(theta - z[:, None], -50, 50))), np.ones((n, 1))], axis=1)
    slope, rows = cdf * (1 - cdf), np.arange(n)
    p = np.maximum(cdf[rows, grade + 1] - cdf[rows, grade], 1e-12)
    up, down = slope[rows, grade + 1] / p, slope[rows, grade] / p
    dtheta = np.array([(-up[grade == j].sum() + down[grade == j + 1].sum()) for j in range(GRADES - 1)]) / n
    gradient = np.concatenate([np.bincount(col, (up - down)[row], k) / n + l2 * w, [dtheta.sum()], [dtheta[j + 1 :].sum() * steps[j] for j in range(GRADES - 2)]])
    return float(-np.log(p).mean() + l2 / 2 * (w * w).sum()), gradient


def train(col: np.ndarray, row: np.ndarray, grade: np.ndarray, features: int, rounds: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam."""
    params = np.concatenate([np.zeros(features), [2.0], np.zeros(GRADES - 2)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        _, grad = loss_and_gradient(params, col, row, grade, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:features], np.concatenate([[params[features]], params[features] + np.cumsum(np.exp(params[features + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents, the first by a hash of doc_id; toxic null is left out.

    A doc_id that repeats in labels counts as toxic if any of its rows is; one that repeats in docs gives its last text.
    """
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(5))
    some = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(rows)  # bounded, so it is broadcast
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    return rows_of.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def fit(sample: DataFrame, **training) -> Model:
    """Fits on (text, toxic), as many rows as ``labelled_sample`` gives; without both classes the model scores 0 everywhere."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [sorted(text_features(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], names=["row", "toxic", "features"])

    with scratch():
        numbered = written(sample.withColumn("row", F.monotonically_increasing_id()), "tx-sample")
        n = numbered.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
        nt, nc = n["toxic"] or 0, n["n"] - (n["toxic"] or 0)
        if not nt or not nc:
            return Model({}, np.zeros(0), np.full(GRADES - 1, 50.0))
        rows = written(numbered.select("row", "toxic", "text").mapInArrow(features, "row long, toxic int, features array<string>"), "tx-features")
        counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c"))
        a, c = F.col("a") + 0.5, F.col("c") + 0.5
        odds = F.log(a / (nt - a + 1)) - F.log(c / (nc - c + 1))
        counts = counts.where(f"a >= {LEAST_ROWS}").select("feature", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / c)).alias("strength"))
        best = counts.orderBy(F.desc(F.abs("strength")), "feature").limit(MOST_FEATURES).collect()
        index = {r["feature"]: i for i, r in enumerate(best)}

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [sorted(index[f] for f in found if f in index) for found in batch.column("features").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("toxic"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "toxic", "ids"])

        got = rows.mapInArrow(chosen, "row long, toxic int, ids array<int>").orderBy("row").collect()  # at most MOST_FEATURES numbers a row
    strong = {i: r["feature"].rstrip("*")[:3] for i, r in enumerate(best) if r["strength"] > 4 and r["odds"] > 3}
    toxic = np.array([r["toxic"] for r in got])
    marked = np.array([len({strong[i] for i in r["ids"] if i in strong}) for r in got])
    grade = np.where(toxic == 0, 0, np.where(marked <= 1, 1, np.where(marked <= 3, 2, 3)))
    col = np.array([i for r in got for i in r["ids"]], np.int64)
    row = np.repeat(np.arange(len(got)), [len(r["ids"]) for r in got])
    return Model(index, *train(col, row, grade, len(index), **training))


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for each row of docs (doc_id, text, ...).

    severity: expected grade, 0 to 3; p_toxic: P(grade >= 1); grade: the nearest whole severity; toxic: p_toxic >= ``REJECT``.
    Texts without features, null and empty ones among them, have severity 0. labels: (doc_id, toxic). Repeated rows score alike; a
    null doc_id is scored as any other. Columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    model = fit(labelled_sample(docs, labels, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                p = np.array([own.score(t) for t in batch.column("text").to_pylist()]).reshape(-1, GRADES - 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p.sum(axis=1)), pa.array(p[:, 0])], names=["doc_id", "severity", "p_toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, severity double, p_toxic double")
    return out.select("doc_id", "severity", "p_toxic", F.round("severity").cast("int").alias("grade"), (F.col("p_toxic") >= REJECT).alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns unchanged, that the model does not call toxic; texts without features stay, null and empty ones among them."""
    small_batches(docs.sparkSession)
    model = fit(labelled_sample(docs, labels, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                toxic = [own.score(t)[0] >= REJECT for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array([not x for x in toxic], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
