"""Fixtures that every operator must survive, and plain versions to compare with."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like columns that operators use inside.
CLASHING = ("size", "slot", "shard", "rep", "n", "bucket", "component", "kept", "digest", "key", "row", "times", "extra", "target", "_text", "order", "cell", "ids", "score", "lead", "class")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})


def odd_docs(seed: int = 0) -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, near copies, other scripts."""
    rng = random.Random(seed)
    words = [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("bcdfgklmnprst") + rng.choice(["", "e", "ing", "Er"]) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, long = some(120), some(70), some(20_000)
    texts = [None, "", " \t\n", "one", "One", "ONE", "two words", base, base, base.upper(), base + " tail", "head " + base, passage, some(30) + " " + passage + " " + some(30), some(10) + "\n" + passage, long, long + " end", "ÄÖü ß É", "äÖü ß É", "<|endoftext|> x", "中文 字 " * 40, "a " * 300, "...", "12 34"]
    texts += [some(rng.randrange(1, 200)) for _ in range(30)]
    docs = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[8], docs[8], docs[13], (None, "no id " + some(60), None, None, None), (None, base, "en", "a", None)]
    return docs


def words_of(text):
    return (text or "").encode().split()


def components(nodes, links):
    """Smallest node reachable, by union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
