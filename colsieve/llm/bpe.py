"""Byte-level BPE encoding and decoding.

Method. The adjacent pairs of a piece are the leaves of a segment tree of minima; a leaf holds the pair's merge rank
and its position, so the root is the leftmost pair of the lowest rank. A merge changes three leaves (the pair, its
left and its right neighbour), each in logarithmic time, until the root says that no pair can merge. Pieces come from
the published pattern of the byte-level pre-tokenizer; those up to ``LONGEST_CACHED`` characters are remembered in a
bounded table for the length of a task, as words repeat. Texts are processed whole; a piece of any length costs
O(n log n).

The vocabulary file is read once on the driver from the path given and broadcast as arrays (about 2 MB, whatever the data).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .text import slices, trim

#: Fixed value: the byte-level pre-tokenizer's published pattern.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST_CACHED, MOST_CACHED = 48, 300_000
SLICE_BYTES = 4 << 20
NONE, NO_PAIR = 1 << 62, 1 << 30


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    out, more = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


class Vocabulary(NamedTuple):
    """A vocabulary file as arrays: pairs of ids (sorted) and their ranks, merged ids by rank, ids of single bytes, bytes of ids."""

    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged: np.ndarray
    first: np.ndarray
    raw: bytes
    ends: np.ndarray
    special: dict[str, int]

    @classmethod
    def parse(cls, file: str) -> Vocabulary:
        spec = json.loads(file)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        known = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in special} | {i: s.encode() for s, i in special.items()}
        tokens = [known.get(i, b"") for i in range(max(known) + 1)]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        return cls(pairs[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in merges], np.int32), np.array([vocab[c] for c in symbols], np.int32), b"".join(tokens), ends, special)


class MinTree:
    """A segment tree of minima over ``values``: ``root`` is the least, ``put`` changes one leaf."""

    def __init__(self, values: list[int]):
        self.size = size = 1 << max(0, (len(values) - 1).bit_length())
        tree = [NONE] * size + values + [NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        self.tree = tree

    @property
    def root(self) -> int:
        return self.tree[1]

    def put(self, leaf: int, value: int) -> None:
        tree, i = self.tree, leaf + self.size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            least = value if value < other else other
            if tree[i] == least:
                return
            tree[i] = value = least


class _OddSpace(Exception):
    """White space that isn't a single space or line feed between two other characters."""


_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class _Words(dict):
    """From a word without white space to the ids of ``before`` and the word."""

    def __init__(self, tokenizer: Tokenizer, before: str):
        self.tokenizer, self.before = tokenizer, before

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _OddSpace
        if "\n" in word:
            return self.tokenizer.lines(word, self)
        return Tokenizer._keep(self, word, self.tokenizer.plain(self.before + word))


class Tokenizer(dict):
    """Encodes and decodes with one vocabulary; as a mapping, from a piece to its ids as little-endian bytes."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.pair_keys, self.pair_ranks, self.merged_array, self.first_array = v.pair_keys, v.pair_ranks, v.merged, v.first
        self.first, self.special = v.first.tolist(), v.special
        self.bytes_of = [v.raw[i:j] for i, j in zip(v.ends[:-1].tolist(), v.ends[1:].tolist(), strict=True)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES).findall
        self.word, self.spaced = _Words(self, ""), _Words(self, " ")
        self.line_feed = self["\n"]

    @functools.cached_property
    def merges(self) -> tuple[dict[int, int], list[int]]:
        """Rank by pair and merged id by rank, for pieces that are merged one by one."""
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True)), self.merged_array.tolist()

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids left when no pair can merge."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, merged = self.merges
        bits = n.bit_length()
        place = (1 << bits) - 1
        tree = MinTree([(r << bits | i) if (r := ranks.get(symbols[i] << 20 | symbols[i + 1])) is not None else NONE for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (least := tree.root) < NONE:
            i = least & place
            j = after[i]
            k = after[j]
            symbols[i], symbols[j] = merged[least >> bits], -1
            after[i], before[k] = k, i
            if j < n - 1:
                tree.put(j, NONE)
            r = ranks.get(symbols[i] << 20 | symbols[k]) if k < n else None
            tree.put(i, NONE if r is None else r << bits | i)
            if (p := before[i]) >= 0:
                r = ranks.get(symbols[p] << 20 | symbols[i])
                tree.put(p, NONE if r is None else r << bits | p)
        return [s for s in symbols if s >= 0]

    def leaf_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and position of pairs of ids as one number, NO_PAIR where the pair has no merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at] << 6 | place, NO_PAIR).astype(np.int32)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many pieces of at most LONGEST_CACHED bytes: a segment tree for each, all advanced together."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(x) for x in pieces])
        low = 0
        for size in (1, 2, 4, 8, 16, 32, 64):
            chosen = np.flatnonzero((lengths > low) & (lengths <= size))
            low = size
            for part in np.array_split(chosen, max(1, len(chosen) * size >> 18)):
                if len(part):
                    self._merge_block([pieces[i] for i in part], lengths[part], size, part, out)
        return out

    def _merge_block(self, pieces: list[bytes], n: np.ndarray, size: int, part: np.ndarray, out: list[bytes]) -> None:
        m = len(pieces)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(m, size)
        place = np.arange(size, dtype=np.int32)
        symbols = np.full((m, size + 1), -1, np.int32)
        symbols[:, :size] = np.where(place < n[:, None], self.first_array[raw], -1)
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), (m, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int32), (m, 1))
        tree = np.full((m, 2 * size), NO_PAIR, np.int32)
        tree[:, size:] = self.leaf_keys(symbols[:, :-1], symbols[:, 1:], place)
        w = size
        while w > 1:
            np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2], out=tree[:, w // 2 : w])
            w //= 2
        tree, symbols, after, before = tree.reshape(-1), symbols.reshape(-1), after.reshape(-1), before.reshape(-1)
        rows = np.arange(m) if size > 1 else np.empty(0, np.int64)
        while True:
            least = tree[rows * (2 * size) + 1]
            rows, least = rows[least < NO_PAIR], least[least < NO_PAIR]
            if not len(rows):
                break
            of, root = rows * (size + 1), rows * (2 * size)
            i = least & 63
            j = after[of + i]
            k = np.minimum(after[of + j], size)  # the padding, and the place after the last, hold -1
            new = self.merged_array[least >> 6]
            symbols[of + i], symbols[of + j] = new, -1
            after[of + i], before[of + k] = k, i
            p = before[of + i]
            q = np.maximum(p, 0)
            tree[root + size + np.minimum(j, size - 1)] = NO_PAIR
            tree[root + size + i] = self.leaf_keys(new, symbols[of + k], i)
            has = p >= 0
            tree[(root + size + q)[has]] = self.leaf_keys(symbols[of + q], new, q)[has]
            for leaf in (j, i, q):
                node = (leaf + size) >> 1
                while node[0]:
                    tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])
                    node = node >> 1
        symbols = symbols.reshape(m, size + 1)
        left = symbols >= 0
        ids, ends = symbols[left].astype("<u4").tobytes(), np.cumsum(left.sum(axis=1)) * 4
        begin = 0
        for i, end in zip(part.tolist(), ends.tolist(), strict=True):
            out[i] = ids[begin:end]
            begin = end

    def learn(self, texts: list[str]) -> None:
        """Fills the tables with the words of texts that they lack, merging all new pieces together."""
        for known, new in ((self.word, set()), (self.spaced, set())):
            for text in texts:
                first, *rest = text.split(" ")
                if known is self.spaced:
                    new.update(x.split("\n", 1)[0] if "\n" in x else x for x in rest)
                else:
                    new.update(first.split("\n"))
                    if "\n" in text:
                        new.update(x.split(" ", 1)[0] for x in text.split("\n"))
            new = [x for x in new if x not in known and 0 < len(x) <= LONGEST_CACHED and not (x[0].isspace() or x[-1].isspace())]
            split = [self.pieces(known.before + x) for x in new]
            whole = {s[0]: x for x, s in zip(new, split, strict=True) if len(s) == 1}  # remembered as words, not as pieces too
            fresh = list({x for s in split for x in s if self.met(x) is None})
            ids = {x: None for x in fresh}
            coded = [x.encode() for x in fresh]
            fits = [i for i, x in enumerate(coded) if len(x) <= 64]
            for i, x in zip(fits, self.merge_many([coded[i] for i in fits]), strict=True):
                ids[fresh[i]] = x
            if len(known) + len(new) > MOST_CACHED:
                known.clear()
            if len(self) + len(fresh) > MOST_CACHED:
                self.clear()
            self.update((k, v) for k, v in ids.items() if v is not None and k not in whole and len(k) <= LONGEST_CACHED)
            for x, s in zip(new, split, strict=True):
                known[x] = b"".join([ids.get(y) or self.met(y) or self[y] for y in s])

    def met(self, piece: str) -> bytes | None:
        """The ids of a piece if they are remembered, as a piece or as a word."""
        ids = self.get(piece)
        if ids is None:
            ids = self.spaced.get(piece[1:]) if piece[0] == " " else self.word.get(piece)
        return ids

    def __missing__(self, piece: str) -> bytes:
        first = self.first
        ids = np.array(self.merge([first[b] for b in piece.encode()]), "<u4").tobytes()
        return self._keep(self, piece, ids)

    @staticmethod
    def _keep(known: dict, key: str, ids: bytes) -> bytes:
        if len(key) <= LONGEST_CACHED:
            if len(known) >= MOST_CACHED:
                known.clear()
            known[key] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens, piece by piece."""
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def run(self, text: str) -> bytes:
        """The same as ``plain``, a word at a time where that is exact.

        A space between two characters that aren't white space always begins a piece, and a line feed between two
        such characters is a piece of its own; so ids can be remembered by word.
        """
        first, *rest = text.split(" ")
        try:
            return (self.lines(first, self.word) if first else b"") + b"".join(map(self.spaced.__getitem__, rest))
        except _OddSpace:
            first, *rest = _BETWEEN.split(text)
            return self.plain(first) + b"".join([self.spaced[x] if x.isalnum() else self.plain(" " + x) for x in rest])

    def lines(self, chunk: str, known: _Words) -> bytes:
        """The ids of a chunk that holds no space."""
        if "\n" not in chunk:
            return known[chunk]
        head, *rest = chunk.split("\n")
        return known[head] + b"".join([self.line_feed + self.word[x] for x in rest])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; strings of special tokens are those tokens."""
        if self.split is None or not any(s in text for s in self.special):
            return self.run(text)
        return b"".join([self.special[x].to_bytes(4, "little") if x in self.special else self.run(x) for x in self.split.split(text)])

    def forget(self) -> None:
        """Drops what was remembered, so that an idle worker holds the vocabulary only."""
        for known in (self, self.word, self.spaced):
            known.clear()

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(key: str, shared) -> Tokenizer:
    """One for each Python worker and vocabulary."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(shared.value)
    return _loaded[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]) of each row of docs (doc_id, text, ...).

    ids: little-endian unsigned 32-bit integers as binary. Null texts count as empty and have no ids; decoded is made
    from ids alone. Rows are independent, so repeated rows and null doc_ids come back as they are. Columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        file = f.read()
    key, shared = hashlib.sha256(file.encode()).hexdigest(), spark.sparkContext.broadcast(Vocabulary.parse(file))
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.string())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(key, shared)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                tok.learn(texts)
                ids = list(map(tok.encode, texts))
                cols = [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array(map(tok.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(kinds))
        tok.forget()
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)
