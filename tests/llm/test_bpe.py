import hashlib
import random

import numpy as np
import pytest
from helpers import odd_docs
from tokenizers import Tokenizer as Reference

from colsieve.llm.bpe import MinTree, Tokenizer, Vocabulary, default_vocabulary, tokenize


@pytest.fixture(scope="module")
def both():
    with open(default_vocabulary(), encoding="utf-8") as f:
        return Tokenizer(Vocabulary.parse(f.read())), Reference.from_file(default_vocabulary())


def same(both, text):
    own, ref = both
    ids = ref.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    assert own.decode(own.encode(text)) == ref.decode(ids, skip_special_tokens=False)


def test_min_tree():
    rng, values = random.Random(0), [random.Random(1).randrange(99) for _ in range(37)]
    tree = MinTree(list(values))
    for _ in range(300):
        i, v = rng.randrange(37), rng.randrange(99)
        values[i] = v
        tree.put(i, v)
        assert tree.root == min(values)


@pytest.mark.parametrize("learn", [False, True])
def test_against_the_library(both, learn):
    rng = random.Random(2)
    parts = ["a", "the", "  ", " ", "\n", "\r\n", "'s", "'ll", "é", "e\u0301", "中", "😀", "1", "²", "<|endoftext|>", "don't", "ü", "###", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "Ⅷ", "ab" * 40, "\ufeff", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(800)] + [t or "" for _, t, *_ in odd_docs()]
    own = both[0]
    own.clear(), own.word.clear(), own.spaced.clear()
    if learn:
        own.learn(texts)
    for t in texts:
        same(both, t)


def test_all_code_points(both):
    for low in range(0, 0x110000, 4096):
        chars = [chr(c) for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000]
        same(both, "".join(f"a{c}1{c} {c}{c}. " for c in chars))


def test_long_piece(both):
    same(both, "ab" * 20_000)
    same(both, " " * 5000 + "x")


def test_odd_rows(both, odd, none):
    got = tokenize(odd, default_vocabulary(), decode=True).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in odd_docs())
    assert sorted(hashlib.sha256(r.decoded.encode()).hexdigest() for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert tokenize(none, default_vocabulary()).count() == 0
