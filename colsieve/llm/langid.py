"""Language identification by a bidirectional gated recurrent network over bytes.

Method. A text's UTF-8 bytes are read in blocks of ``BLOCK`` with ``CONTEXT`` bytes of the text before and after each, over which the
states warm up; a gated recurrent unit runs over each block in either direction, and both states label every byte of the block with
language probabilities. A document's probabilities are the mean over its letter bytes (ASCII letters and bytes of longer
characters), or over all bytes if it has no such byte. The network is trained in numpy by backpropagation through time, with Adam
and a fixed seed.

Scale. The rows of the training sample are blocks: of each language as many blocks as its share of ``SAMPLE_BLOCKS`` (at least
``LEAST_BLOCKS``), those with the smallest hash among all blocks of all labelled documents, wherever they lie in a text; copies of a text count once. So
training costs the same at any input and any length of text, and a rare language has its share; the number of languages must be modest.
Tasks find the blocks; the driver gets these and a few more by hash, no texts. Prediction reads every block of every text in one pass without
a shuffle; a text of any length is blocks like any other, and work arrays are bounded by ``BATCH`` blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_frame, small_batches
from .text import joined_buffer, slices

BLOCK, CONTEXT, HIDDEN, BATCH = 128, 8, 8, 2048
SAMPLE_BLOCKS, LEAST_BLOCKS = 4000, 50
PAD = 256
UNDETERMINED = "und"
_LETTER = np.zeros(257, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def block_starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of all texts begin, and the text each belongs to."""
    size = np.diff(at)
    count = -(-size // BLOCK)
    text = np.repeat(np.arange(len(size)), count)
    return (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * BLOCK + at[:-1][text], text


def blocks_at(buf: np.ndarray, at: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Some blocks with their context (blocks x (BLOCK + 2 CONTEXT)), padded outside the text."""
    place = start[:, None] + np.arange(-CONTEXT, BLOCK + CONTEXT)
    inside = (place >= at[text][:, None]) & (place < at[text + 1][:, None])
    return np.where(inside, buf[np.clip(place, 0, max(len(buf) - 1, 0))].astype(np.int16), PAD) if len(buf) else np.full(place.shape, PAD)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Weights by name. For each direction d: input table X (bytes x 3H), recurrent U (H x 3H), B (3H); then V, C."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = params

    @classmethod
    def fresh(cls, classes: int, seed: int) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        p = {}
        for d in "fb":
            p["X" + d] = rng.normal(0, 0.3, (257, 3 * h))
            p["U" + d] = rng.normal(0, 0.3, (h, 3 * h))
            p["B" + d] = np.zeros(3 * h)
            p["B" + d][:h] = 1.0  # keep at first
        p["V"], p["C"] = rng.normal(0, 0.3, (2 * h, classes)), np.zeros(classes)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def states(self, x: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States after each step of direction d over x (steps x blocks), in the order of the text."""
        h = HIDDEN
        table, u, b = self.params["X" + d], self.params["U" + d], self.params["B" + d]
        scaled = table[:, : 2 * h] + b[: 2 * h]
        fresh, u2, un, bn = table[:, 2 * h :], np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :]), b[2 * h :]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((len(x), x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gates = _sigmoid(scaled[x[t]] + state @ u2)
            keep, reset = gates[:, :h], gates[:, h:]
            inner = state @ un + bn
            new = _sigmoid(2 * (fresh[x[t]] + reset * inner)) * 2 - 1
            if tape is not None:
                tape.append((t, state, keep, reset, inner, new))
            state = new + keep * (state - new)
            out[t] = state
        return out

    def probabilities(self, x: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        """(steps x blocks x classes) for x (steps x blocks)."""
        both = np.concatenate([self.states(x, d, None if tapes is None else tapes.setdefault(d, [])) for d in "fb"], axis=2)
        if tapes is not None:
            tapes["both"] = both
        z = both.reshape(-1, 2 * HIDDEN) @ self.params["V"] + self.params["C"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray, context: int = CONTEXT) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the letter bytes of x (steps x blocks) but for the context, with block labels y, and its gradients."""
        tapes: dict = {}
        p, h = self.probabilities(x, tapes), HIDDEN
        weight = _LETTER[x].astype(np.float32)
        weight[:context] = weight[len(x) - context :] = 0
        weight /= max(1.0, weight.sum())
        dz = p.copy()
        blocks = np.arange(len(y))
        loss = float(-(np.log(np.maximum(p[:, blocks, y], 1e-9)) * weight).sum())
        dz[:, blocks, y] -= 1
        dz *= weight[:, :, None]
        flat = dz.reshape(-1, dz.shape[2])
        both = tapes["both"].reshape(-1, 2 * h)
        g = {"V": both.T @ flat, "C": flat.sum(axis=0)}
        dboth = (flat @ self.params["V"].T).reshape(*x.shape, 2 * h)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = self.params["U" + d]
            gx, gu, gb = np.zeros_like(self.params["X" + d]), np.zeros_like(u), np.zeros(3 * h, np.float32)
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, state, keep, reset, inner, new in reversed(tapes[d]):
                dh = dboth[t][:, part] + carry
                dkeep = dh * (state - new) * keep * (1 - keep)
                dnew = dh * (1 - keep) * (1 - new * new)
                dreset = dnew * inner * reset * (1 - reset)
                dinner = dnew * reset
                din = np.concatenate([dkeep, dreset, dnew], axis=1)
                drec = np.concatenate([dkeep, dreset, dinner], axis=1)
                gu += state.T @ drec
                gb += drec.sum(axis=0)
                np.add.at(gx, x[t], din)
                carry = dh * keep + drec @ u.T
            g |= {"X" + d: gx, "U" + d: gu, "B" + d: gb}
        return loss, g


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 8, rate: float = 0.01, batch: int = 256, seed: int = 11) -> Network:
    """Trains on blocks x (blocks x (BLOCK + 2 CONTEXT)) with labels y."""
    net, rng = Network.fresh(classes, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    v = {k: np.zeros_like(p) for k, p in net.params.items()}
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            part, step = order[i : i + batch], step + 1
            _, g = net.gradients(np.ascontiguousarray(x[part].T), y[part])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * (1 - step / (total + 1)) ** 0.5
            for k, a in g.items():
                a = a * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * a
                v[k] = np.float32(0.99) * v[k] + np.float32(0.01) * a * a
                net.params[k] = net.params[k] - np.float32(now) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return net


def pooled(net: Network, buf: np.ndarray, at: np.ndarray, classes: int) -> np.ndarray:
    """(texts x classes) mean probabilities; rows of empty texts are 0."""
    total, weight = np.zeros((len(at) - 1, classes)), np.zeros(len(at) - 1)
    letters = np.array([_LETTER[buf[i:j]].any() for i, j in zip(at[:-1], at[1:], strict=True)], bool)
    start, text = block_starts(at)
    for i in range(0, len(start), BATCH):
        of = text[i : i + BATCH]
        x = blocks_at(buf, at, start[i : i + BATCH], of)
        b = x[:, CONTEXT : CONTEXT + BLOCK]
        counts = np.where(letters[of][:, None], _LETTER[b], b != PAD).astype(np.float32)
        p = np.einsum("tbk,bt->bk", net.probabilities(np.ascontiguousarray(x.T))[CONTEXT : CONTEXT + BLOCK], counts)
        np.add.at(total, of, p)
        np.add.at(weight, of, counts.sum(axis=1))
    return total / np.maximum(weight, 1)[:, None]


def held_out():
    """Rows whose crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(rows: DataFrame, sample_blocks: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, blocks (blocks x (BLOCK + 2 CONTEXT)) and their labels from rows (doc_id, text, lang) to learn from."""
    usable = rows.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    usable = usable.withColumn("n", F.ceil(F.octet_length("text") / BLOCK).cast("int")).withColumn("key", F.xxhash64("text"))
    totals = usable.groupBy("lang", "key").agg(F.max("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))  # copies count once
    totals = {r["lang"]: r["n"] for r in totals.collect()}
    langs = sorted(totals)
    if not langs:
        return [], np.empty((0, BLOCK + 2 * CONTEXT), np.int64), np.empty(0, np.int64)
    most = max(LEAST_BLOCKS, sample_blocks // len(langs))
    # a share of all blocks in which there are most with near certainty; the smallest of them by hash are taken
    shares = [(lang, i, min(1.0, (most + 5 * most**0.5 + 10) / totals[lang])) for i, lang in enumerate(langs)]
    usable = usable.join(F.broadcast(local_frame(rows.sparkSession, shares, lang=pa.string(), label=pa.int32(), share=pa.float64())), "lang")
    order = lambda i: F.shiftrightunsigned(F.xxhash64("key", i, F.lit(3)), 11) * 2.0**-53
    blocks = usable.select("label", "key", "text", F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: order(i) < F.col("share"))).alias("i"))
    begin = F.greatest(F.col("i") * BLOCK - CONTEXT, F.lit(0))
    raw = F.substring(F.col("text").cast("binary"), begin + 1, (F.col("i") + 1) * BLOCK + CONTEXT - begin)
    blocks = blocks.select("label", "key", "i", order(F.col("i")).alias("h"), (F.col("i") * BLOCK - begin).alias("left"), raw.alias("raw")).distinct()
    found = sorted(blocks.collect(), key=lambda r: (r["label"], r["h"], r["key"], r["i"], bytes(r["raw"])))  # little more than most of each
    got = [r for _, of in itertools.groupby(found, lambda r: r["label"]) for r in itertools.islice(of, most)]
    x = np.full((len(got), BLOCK + 2 * CONTEXT), PAD, np.int64)
    for k, r in enumerate(got):
        x[k, CONTEXT - r["left"] : CONTEXT - r["left"] + len(r["raw"])] = np.frombuffer(bytes(r["raw"]), np.uint8)
    return langs, x, np.array([r["label"] for r in got], np.int64)


def predict(docs: DataFrame, sample_blocks: int = SAMPLE_BLOCKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang, ...).

    Learns from text and lang of rows that have both and aren't held out. lang_pred is a language learned, or ``und``
    with score 0 where the text is null or has no letter, or where nothing could be learned. score is the pooled
    probability of lang_pred. Repeated rows are predicted alike. Columns other than doc_id, text and lang are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    small_batches(docs.sparkSession)
    langs, x, y = training_sample(rows, sample_blocks)
    net = train(x, y, len(langs)) if langs else None
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else net.params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared.value is None else Network(shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                letter = np.asarray(batch.column("letter"))
                if own is None:
                    best, score = [UNDETERMINED] * len(letter), np.zeros(len(letter))
                else:
                    p = pooled(own, *joined_buffer(batch.column("text")), len(langs))
                    best = [langs[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(axis=1), letter, strict=True)]
                    score = np.where(letter, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    inputs = rows.select("doc_id", "text", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return inputs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
