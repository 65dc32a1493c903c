import re

import numpy as np
import pyarrow as pa
from helpers import odd_docs

from colsieve.llm.text import joined_buffer, rolling, shingle_sets, word_hashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_equal_the_pattern_and_hashes_equal_iff_words_do():
    texts = [t for _, t, *_ in odd_docs()]
    buf, at = joined_buffer(pa.array(texts, pa.string()))
    starts, ends, bound = words(buf, at)
    raw = buf.tobytes()
    got = [[raw[starts[k] : ends[k]].decode() for k in range(bound[i], bound[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [w for ws in got for w in ws]
    assert len(set(word_hashes(buf, starts, ends, False).tolist())) == len(set(flat))
    lower = {w.encode().lower() for w in flat}
    assert len(set(word_hashes(buf, starts, ends, True).tolist())) == len(lower)


def test_rolling_hash_depends_on_the_words_only():
    h = np.random.default_rng(0).integers(0, 2**63, 500_000, dtype=np.uint64)
    h[400_000:400_060] = h[10:70]
    for n in (2, 5, 25, 50):
        r = rolling(h, n)
        assert len(r) == len(h) - n + 1
        assert (r[10 : 70 - n + 1] == r[400_000 : 400_060 - n + 1]).all()
        assert len(np.unique(r)) == len(r) - (60 - n + 1)


def test_few_words_are_one_shingle():
    sets = list(shingle_sets(*joined_buffer(pa.array(["a", "A", "b", "a b", None, " "])), 2))
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 0]
    assert sets[0] == sets[1] != sets[2]
