"""Operators that learn: toxicity, language and urls."""

import math
import random
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_docs, with_clashes

from colsieve.llm import common, langid, toxicity, urlfilter
from colsieve.llm.text import joined_buffer


def toy(n=600, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["xx", "yy"])
        letters = "aeioustn" if lang == "xx" else "kzqwxyvr"
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(8, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.choice([1, 2, 5])) if toxic else ():
            words.insert(rng.randrange(len(words)), rng.choice(["grubbish", "snarlfoo", "vileyak" + rng.choice("abc")]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


def test_toxicity(spark, odd, none):
    rows = toy()
    docs = with_clashes(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 2 == 0] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in rows if r[0] % 2]
    assert all(got[r[0]].toxic == bool(r[3]) for r in held)
    assert np.mean([got[r[0]].severity for r in held if r[3]]) > np.mean([got[r[0]].severity for r in held if not r[3]]) + 0.5
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.toxic}
    scored = toxicity.score(odd, labels).collect()
    assert len(scored) == len(odd_docs()) and not any(r.toxic or r.severity for r in scored if r.doc_id in (0, 1, 2))
    assert all(0 <= r.severity <= 3 and r.grade in range(4) for r in scored)
    assert toxicity.score(none, labels).count() == 0
    assert not any(r.toxic for r in toxicity.score(docs, labels.limit(0)).collect())


def test_ordered_thresholds_and_one_weight_vector(spark):
    model = toxicity.fit(spark.createDataFrame([(r[1], r[3]) for r in toy()], "text string, toxic int"))
    assert (np.diff(model.thresholds) > 0).all() and model.weights.ndim == 1
    mild, bad = model.score("grubbish"), model.score("grubbish snarlfoo vileyaka vileyakb")
    assert (np.diff(bad) <= 0).all() and bad.sum() > mild.sum()


def test_ordinal_loss():
    """The loss against a plain loop over rows and grades, its gradient against finite differences."""
    rng = np.random.default_rng(1)
    n, k = 40, 6
    has = rng.random((n, k)) < 0.4
    row, col = np.nonzero(has)
    grade, params = rng.integers(0, toxicity.GRADES, n), rng.normal(size=k + toxicity.GRADES - 1)
    loss, grad = toxicity.loss_and_gradient(params, col, row, grade, 0.01)

    theta = [params[k]]
    for s in params[k + 1 :]:
        theta.append(theta[-1] + math.exp(s))
    at_most = lambda j, z: 0.0 if j < 0 else 1.0 if j == len(theta) else 1 / (1 + math.exp(-(theta[j] - z)))
    zs = [sum(params[f] for f in range(k) if has[i, f]) for i in range(n)]
    want = -sum(math.log(at_most(g, z) - at_most(g - 1, z)) for g, z in zip(grade, zs, strict=True)) / n + 0.005 * sum(p * p for p in params[:k])
    assert loss == pytest.approx(want)
    for i in range(len(params)):
        step = np.zeros(len(params))
        step[i] = 1e-6
        up, down = (toxicity.loss_and_gradient(params + s, col, row, grade, 0.01)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-8)


def test_scores_against_a_plain_loop(spark):
    """Chosen features, sums of weights and expected grades, computed again in plain Python."""
    rows = toy(300)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, 1000), rounds=50)
    seen = [{f for w in r[1].split() for f in [w, *(w[:n] + "*" for n in (3, 4, 5, 6) if len(w) >= n)]} for r in rows]
    nt, counts = sum(r[3] for r in rows), {}
    for s, r in zip(seen, rows, strict=True):
        for f in s:
            counts.setdefault(f, [0, 0])[1 - r[3]] += 1
    nc, strength = len(rows) - nt, {}
    for f, (a, c) in counts.items():
        if a >= toxicity.LEAST_ROWS:
            a, c = a + 0.5, c + 0.5
            strength[f] = (math.log(a / (nt - a + 1)) - math.log(c / (nc - c + 1))) / math.sqrt(1 / a + 1 / c)
    assert set(model.index) == set(sorted(strength, key=lambda f: (-abs(strength[f]), f))[: toxicity.MOST_FEATURES])
    again = toxicity.train(*(np.array(x) for x in zip(*[(model.index[f], i) for i, s in enumerate(seen) for f in sorted(s) if f in model.index], strict=True)), np.array([r[3] for r in rows]), len(model.index), rounds=5)
    assert again[0].shape == model.weights.shape
    for r, s in zip(rows, seen, strict=True):
        z = sum(model.weights[model.index[f]] for f in s if f in model.index)
        some = any(f in model.index for f in s)
        assert model.score(r[1]) == pytest.approx([1 / (1 + math.exp(t - z)) if some else 0 for t in model.thresholds])
    assert 0 < sum(any(f in model.index for f in s) for s in seen)


def test_one_doc_id_many_times(spark, none):
    """A doc_id that repeats gives one row of the sample; an empty table leaves all that is scored clean."""
    docs = spark.createDataFrame([(1, "a b")] * 500 + [(1, None), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.labelled_sample(docs, labels, 10).collect())) == [("a b", 1), ("c d", 0)]
    assert toxicity.clean(none, labels).count() == 0


def test_gradients_of_the_network(monkeypatch):
    """Backpropagation through time against finite differences."""
    net = langid.Network.fresh(3, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    monkeypatch.setattr(np, "float32", np.float64)
    x = np.random.default_rng(0).choice([65, 97, 100, 200, 32, langid.PAD], size=(7, 4))
    y = np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y, 1)
    rng = np.random.default_rng(2)
    for k, p in net.params.items():
        for _ in range(6):
            at = tuple(rng.integers(s) for s in p.shape)
            if k.startswith("X"):
                at = (int(rng.choice(x.ravel())), at[1])
            old, eps = p[at], 1e-5
            p[at] = old + eps
            up, _ = net.gradients(x, y, 1)
            p[at] = old - eps
            down, _ = net.gradients(x, y, 1)
            p[at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-7), (k, at)


def test_language(spark, odd, none):
    rows = toy(900, 4)
    docs = with_clashes(spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + [(9001, None, "xx"), (9002, "12 !", "yy"), (9003, "", None), (None, "aeio", None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert len(got) == len(rows) + 4
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    held = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", docs.lang.substr(5, 1)).where("false")).collect()} == set()
    assert len(langid.predict(odd).collect()) == len(odd_docs())


def test_blocks_cover_the_whole_text():
    texts = ["", "a" * 127, "b" * 128, "c" * 129, None, "d" * 500]
    buf, at = joined_buffer(pa.array(texts))
    start, text = langid.block_starts(at)
    x = langid.blocks_at(buf, at, start, text)
    inside = x[:, langid.CONTEXT : langid.CONTEXT + langid.BLOCK]
    assert [int((inside[text == i] != langid.PAD).sum()) for i in range(6)] == [0, 127, 128, 129, 0, 500]
    assert {chr(c) for c in x[text == 3].ravel() if c != langid.PAD} == {"c"}  # the context never leaves the text


def test_pooled_probabilities_against_a_plain_loop():
    """Every byte of every block by scalar recurrences, averaged over letters."""
    net, n = langid.Network.fresh(3, 5), langid.HIDDEN
    texts = ["plain words", "", "12 .. 34", "é" * 150, "x1 " * 120]
    got = langid.pooled(net, *joined_buffer(pa.array(texts)), 3)
    p = {k: v.astype(float) for k, v in net.params.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    for text, row in zip(texts, got, strict=True):
        raw, sums, weight = text.encode(), np.zeros(3), 0
        letter = lambda c: c >= 128 or chr(c).isalpha()
        some = any(map(letter, raw))
        for begin in range(0, len(raw), langid.BLOCK):
            places = range(begin - langid.CONTEXT, begin + langid.BLOCK + langid.CONTEXT)
            codes = [raw[i] if 0 <= i < len(raw) else langid.PAD for i in places]
            states = {}
            for d in "fb":
                h = np.zeros(n)
                for t in range(len(codes)) if d == "f" else reversed(range(len(codes))):
                    given, rec = p["X" + d][codes[t]], h @ p["U" + d]
                    z, r = sig(given[:n] + rec[:n] + p["B" + d][:n]), sig(given[n : 2 * n] + rec[n : 2 * n] + p["B" + d][n : 2 * n])
                    h = z * h + (1 - z) * np.tanh(given[2 * n :] + r * (rec[2 * n :] + p["B" + d][2 * n :]))
                    states[d, t] = h
            for t, i in enumerate(places):
                if begin <= i < min(begin + langid.BLOCK, len(raw)) and (letter(raw[i]) or not some):
                    e = np.exp(np.concatenate([states["f", t], states["b", t]]) @ p["V"] + p["C"])
                    sums, weight = sums + e / e.sum(), weight + 1
        assert row == pytest.approx(sums / max(weight, 1), abs=1e-4)


def test_training_sample(spark):
    """Every language has its share, blocks come from all over long texts, held-out rows give none, repeated rows give one."""
    letters = {"en": "abcdefgh", "xx": "ijklmnop", "rare": "qrstuvwx"}
    rows = [(i, f"{i} " + letters[lang][i % 8] * n, lang) for lang, ids, n in (("en", range(300), 3000), ("xx", range(300, 400), 900), ("rare", range(400, 403), 20_000)) for i in ids]
    rows += [rows[0]] * 400 + [(None, "z" * 500, "en"), (5, None, "en"), (6, "12", "en"), (7, "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, x, y = langid.training_sample(docs, 300)
    assert langs == ["en", "rare", "xx"] and all(80 <= (y == k).sum() <= 100 for k in range(3))
    for k, lang in enumerate(langs):
        assert {chr(c) for c in x[y == k].ravel() if c != langid.PAD} <= set(letters[lang] + " 0123456789")
    left = (x[:, : langid.CONTEXT] != langid.PAD).all(axis=1)
    assert 0.5 < left.mean() < 1  # some are first blocks, most are not
    assert len(np.unique(np.concatenate([x, y[:, None]], axis=1), axis=0)) > 20
    again = langid.training_sample(docs.repartition(7), 300)
    assert (again[1] == x).all() and (again[2] == y).all()


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org", "https://a.example.org/en/12", "https://b.org/en/1", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/de", "http://xcom/fr/", "http://a.net?u=http://b.org/", "ftp://u@h.com:80/fr/#/de/",
    "http://badexample.org/es/1", "http://x.com#/fr/", "http://É.com/de/ü", "a://b://c.org/x",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_urls(spark):
    rows = [(i, u, None, "own") for i, u in enumerate(URLS)] + [(4, URLS[4], "<title>T</title>", "own"), (None, "http://q.net/en/5", None, "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule), u
        assert by_id[i].verdict == verdict if verdict else by_id[i].verdict in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert urlsplit(URLS[6]).path == by_id[6].path


def test_viterbi_is_the_best_split():
    seg = urlfilter.Segmenter({"cheap": 5, "pills": 5, "pill": 3, "s": 1, "casino": 9, "win": 9, "now": 2})
    assert seg.split("cheappills") == ["cheap", "pills"] and seg.split("casinowinnow") == ["casino", "win", "now"] and seg.split("") == []

    def cost(parts):
        return sum(seg.cost.get(w, seg.unknown + (len(w) - 1) * np.log(10)) for w in parts)

    def splits(name):
        return [[name]] + [[name[:k], *rest] for k in range(1, len(name)) for rest in splits(name[k:])]

    for name in ("winpillsq", "spillscas", "zzwinzz"):
        assert cost(seg.split(name)) == pytest.approx(min(map(cost, splits(name))))


def test_bayes_learns_from_rules(spark):
    rows = [(i, f"http://{'casino' if i % 2 else 'garden'}{'win' if i % 4 else 'now'}.{'com' if i % 2 else 'org'}/{'de' if i % 2 else 'en'}/{i}") for i in range(200)]
    rows += [(1000, "http://casinonow.net/xx/1"), (1001, "http://gardenwin.net/en/1")]
    titles = "<title>casino garden win now</title>"
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame([(i, u, titles) for i, u in rows], "page_id long, url string, html string")).collect()}
    assert (got[1000].verdict, got[1001].verdict) == ("block", "allow")


def test_held_out_pages(spark):
    """Ruled pages that are held out get a verdict from the others: here the words tell it exactly."""
    rows = [(i, f"http://{'casino' if i % 3 else 'garden'}.com/{'de' if i % 3 else 'fr'}/{i % 7}", None) for i in range(300)] + [(None, None, None)]
    got = urlfilter.held_out_quality(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    held = [i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert (got["pages"], got.blocked, got.caught, got.wrong) == (len(held), sum(i % 3 > 0 for i in held), sum(i % 3 > 0 for i in held), 0)
    assert (got.precision, got.recall) == (1, 1)
    assert urlfilter.held_out_quality(spark.createDataFrame(rows[-1:], "page_id long, url string, html string")).first().recall is None


def test_a_long_url(spark):
    """One host label of many letters and a path of many tokens."""
    url = "http://" + "casinowin" * 60 + ".net/" + "/".join(f"t{i}" for i in range(20_000))
    rows = [(1, url, "<title>casino win</title>"), (2, "http://casino.com/de/t1", None), (3, "http://garden.com/fr/x", "<title>" + "y" * 3000 + "</title>")]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].verdict == "block" and len(got[1].path) > 100_000


def test_every_token_weighs(spark, monkeypatch):
    """More tokens than were once kept: the rarest and last by alphabet decide a verdict, and all scores are those of plain naive Bayes."""
    monkeypatch.setattr(common, "HOT", 100)
    paths = [("com", "de", [f"b{i}x{j}" for j in range(1000)]) for i in range(105)] + [("com", "fr", [f"a{i}x{j}" for j in range(1000)]) for i in range(106)]
    paths[0][2].append("zzz")
    rows = [(i, f"http://{h}/{p}/{'/'.join(t)}") for i, (h, p, t) in enumerate(paths)] + [(1000, "http://net/zzz"), (1001, "http://net/never/b7x7"), (1002, "http://net"), (1003, "http://net/a5x5/a5x6/b1x1"), (1003, "http://net/zzz/zzz")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    count = {"block": {}, "allow": {}}
    for h, p, tokens in paths:
        for t in ["h:" + h, *("p:" + t for t in [p, *tokens])]:
            of = count["block" if p == "de" else "allow"]
            of[t] = of.get(t, 0) + 1
    known = count["block"].keys() | count["allow"].keys()
    assert len(known) > 210_000
    weigh = lambda t: np.log((count["block"].get(t, 0) + 1) / (sum(count["block"].values()) + len(known) + 1)) - np.log((count["allow"].get(t, 0) + 1) / (sum(count["allow"].values()) + len(known) + 1))
    want = {u: np.log(106 / 107) + sum(weigh("p:" + t) for t in u.split("/")[3:] if "p:" + t in known) for i, u in rows if i >= 1000}
    assert len(got) == len(rows) and all((r.score is None) == (r.page_id < 1000) for r in got)
    for r in got:
        if r.score is not None:
            assert r.score == pytest.approx(want[f"http://{r.host}{r.path}"], abs=1e-9) and r.verdict == ("block" if r.score > 0 else "allow")
    assert {r.verdict for r in got if r.page_id == 1000} == {"block"}


def test_every_word_splits(spark):
    """More words than were once kept: two of the rarest split a host, and their weights decide its verdict."""
    letters = str.maketrans("0123456789", "abcdefghij")
    fillers = [f"q{i}".translate(letters) for i in range(201_000)]
    rows = [(i, f"http://a.com/fr/{i}", f"<title>{' '.join(fillers[1000 * i : 1000 * i + 1000] * 2)}</title>") for i in range(201)]
    rows += [(300, "http://a.com/fr/x", "<title>zyzzyva zizania</title>"), (301, "http://zyzzyva.com/de/x", None), (302, "http://zizania.com/de/x", None), (303, "http://zyzzyvazizania.net", None)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[303].verdict == "block"


def test_splits_of_a_table(spark, monkeypatch):
    """Names split by a table of words as by all words at once, also by words of more than 24 letters."""
    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(urlfilter, "BATCH_CHARS", 500)
    rng = random.Random(3)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 50) for _ in range(150)} | {"a" * 12 + "b" * 20: 3}
    names = ["", "b7a", "é", "1" * 30, "x" * 60, "b" + "a" * 12 + "b" * 20 + "7"] + ["".join(rng.choice("abé7") for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    names = list(dict.fromkeys(names))
    got = urlfilter.segmented(spark.createDataFrame([(n, 1) for n in names], "name string, use long"), spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    whole = urlfilter.Segmenter(counts)
    assert {r.name: r.words for r in got} == {n: whole.split(n) for n in names} and len(got) == len(names)
    assert whole.split("b" + "a" * 12 + "b" * 20)[-1] == "a" * 12 + "b" * 20 and whole.split("x" * 60) == ["x" * 60]
