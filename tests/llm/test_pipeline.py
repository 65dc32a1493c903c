import hashlib
import math
import random
import re

import pytest
from helpers import DOCS, components, odd_docs, with_clashes
from pyspark.sql import functions as F

import corpus_pipeline
from colsieve.llm import bpe, exactdedup, minhash, mixing, toxicity
from colsieve.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, toxic int"


def labelled_docs():
    """Odd rows, and labelled ones of which a fifth are toxic; some of these repeat or nearly repeat."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1000, 1200):
        words = ["".join(rng.choice("aeioustn") for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(20, 60))]
        toxic = rng.random() < 0.2
        for _ in range(3) if toxic else ():
            words.insert(rng.randrange(len(words)), rng.choice(["grubbish", "snarlfoo", "vileyak"]))
        labels.append((i, int(toxic)))
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b", "c", None]), 1))
        if rng.random() < 0.2:
            rows.append((i + 1000, " ".join(words).title() if rng.random() < 0.5 else " ".join(words) + " end", "en", rng.choice("ab"), None))
    return odd_docs() + rows, labels


def plain_near(rows):
    def shingles(text):
        w = [x.lower() for x in (text or "").encode().split()]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    whole = components({i for i, _ in sets}, links)
    return [r for r in rows if r[0] is None or whole[r[0]] == r[0]]


def plain_mix(rows, order):
    """Clamp and reshare by source, whole repetitions, then one more in seeded order until the target is met."""
    size = lambda r: len(WORD.findall(r[1] or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, set()
    while True:
        rest, free = sum(total.values()) - sum(3 * total[s] for s in capped), [s for s in sources if s not in capped]
        target = {s: 3 * total[s] for s in capped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        times = math.floor(target[s] / total[s]) if total[s] else 0
        need = round(target[s] - times * total[s])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (order[r[0]] % 4096, order[r[0]], -1 if r[0] is None else r[0], size(r))):
            out += [(r[0], r[1])] * times
            if need > 0 and size(r):
                out.append((r[0], r[1] if size(r) <= need else " ".join(WORD.findall(r[1])[:need])))
                need -= min(need, size(r))
    return out


def test_the_chain_by_brute_force(spark, tmp_path):
    """All five stages against plain Python and the tokenizers library; only the model's weights and the seeded order are shared."""
    from tokenizers import Tokenizer as Reference

    d, (rows, labels) = str(tmp_path), labelled_docs()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    got = corpus_pipeline.run(spark, d).collect()

    docs, marks = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled_sample(docs, marks, 10_000))
    words = re.compile(r"[^\W\d_]+")

    def toxic(text):
        found = {f for w in set(words.findall((text or "").lower())) for f in [w, *(w[:n] + "*" for n in range(3, 7) if len(w) >= n)]}
        weights = [model.weights[model.index[f]] for f in found if f in model.index]
        return bool(weights) and 1 / (1 + math.exp(model.thresholds[0] - sum(weights))) >= 0.3

    kept = [r for r in rows if not toxic(r[1])]
    assert 20 < len(rows) - len(kept) < 80
    best = {}
    for r in kept:
        key = (r[1] or "").encode().lower()
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    assert len(best) < len(kept)
    near = plain_near(list(best.values()))
    assert len(near) < len(best)
    ids = spark.createDataFrame([(r[0],) for r in near], "id long").distinct()
    order = {r.id: r.h for r in ids.select("id", F.xxhash64("id", F.lit(17)).alias("h")).collect()}
    tokenizer = Reference.from_file(bpe.default_vocabulary())
    want = []
    for i, text in plain_mix(near, order):
        e = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(e), e, hashlib.sha256(tokenizer.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    import numpy as np

    assert sorted((str(r.doc_id), r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in got) == sorted(want)


@pytest.mark.parametrize("what", ["empty", "clashing"])
def test_stages_on_empty_and_clashing_tables(spark, tmp_path, what):
    """No rows, or extra columns with the names used inside: no stage fails, and all but the last keep the columns."""
    d = str(tmp_path)
    docs = spark.createDataFrame([] if what == "empty" else odd_docs(), DOCS)
    docs = docs if what == "empty" else with_clashes(docs).withColumns({c: F.lit(1) for c in ("_doc", "_lost", "_of", "_is", "_id", "_sha", "doc", "cls", "sig")})
    spark.createDataFrame([(3, 0), (12, 1)] if what == "clashing" else [], LABELS).write.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        docs = stage(spark, now, d)
        assert docs.columns == now.columns, name
    docs.write.parquet(f"{d}/mixed")
    assert (corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{d}/mixed"), d).count() > 0) == (what == "clashing")


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage on the whole output of the one before; the columns of documents stay; the whole equals the operators by hand."""
    d = str(tmp_path)
    docs = spark.createDataFrame(odd_docs(), DOCS)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 0), (7, 0), (12, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, d).write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        assert now.columns == docs.columns, name
    want = sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in now.collect())
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_clean_documents_stay(spark):
    """The filtering stage keeps every clean labelled document of the small tables."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, d).select("doc_id").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_five_stages_and_ten_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encode"]
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 11))
    assert all((bpe, exactdedup, minhash, mixing, toxicity))


def test_oracles_agree(spark):
    """The SQL of the operators that have any gives their rows on the smallest tables."""
    import duckdb

    from colsieve.llm.queries import ORACLE_SQL

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, d)
        names = [c[0] for c in con.execute(sql).description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, con.execute(sql).fetchall()))
