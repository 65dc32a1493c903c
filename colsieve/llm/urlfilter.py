"""URL filtering: rules first, then host word segmentation and naive Bayes.

Method. A url that a rule fits gets the verdict of the longest rule. For the others, the labels of the host are split
into words: a unigram model of words gives each split a probability, and the best split is found by Viterbi over the
positions of the label. Segmented host words and path tokens are scored by multinomial naive Bayes with add-one
smoothing, trained on the urls that rules fit, their verdicts as labels. The unigram model counts words of all pages' titles and
paths and the labels that hosts share; a word it lacks has a probability that falls tenfold with each letter.

Scale. Pages are read once; hosts, paths and titles are written down. Counts of tokens and of labels are partial sums over
all urls. Words, tokens and their weights stay tables without a limit: each distinct label is split once with the counts of its own
substrings, and a url's score is the sum over a join of its tokens with all weights. What is used most of substrings, labels, tokens or hosts is
joined by broadcast (``spread_join``), so no task gets all rows of a hot one. A label of n letters has up to n * n / 2 substrings, each a row of a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch, spread_join, written

#: (verdict, host, path): a rule fits the host and its subdomains if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of the substrings in an Arrow batch.
BATCH_CHARS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_tokens, _letters = re.compile(r"[^\W_]+").findall, re.compile(r"\D+").findall


def after_scheme(url: Column) -> Column:
    """What follows the first ://; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; both null if none does. Of equally long rules the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi: the most probable split of a name into words.

    total: the sum of all words' counts, if counts has only some of the words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.unknown = math.log(total)  # of a word outside the model, and a factor of ten for each letter after the first

    def split(self, name: str) -> list[str]:
        best, start, ten = [0.0], [0], math.log(10)
        for end in range(1, len(name) + 1):
            options = []
            for begin in range(end):
                c = self.cost.get(name[begin:end]) if end - begin <= self.longest else None
                options.append((best[begin] + (self.unknown + (end - begin - 1) * ten if c is None else c), begin))
            cost, begin = min(options)
            best.append(cost)
            start.append(begin)
        out, end = [], len(name)
        while end:
            out.append(name[start[end] : end])
            end = start[end]
        return out[::-1]


def train_words(urls: DataFrame) -> DataFrame:
    """(word, n): unigrams of (host, path, title), words of titles and paths, and parts of labels that several hosts share.

    A label of one host only is a name to be split, not a word, so it doesn't count; each host counts a label once.
    """
    split = lambda c: F.explode(F.split(F.lower(F.regexp_replace(c, "[^\\p{L}]+", " ")), " ")).alias("word")
    running = urls.select(split("title")).unionByName(urls.select(split("path"))).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    labels = urls.select("host").distinct().select("host", split("host")).where("word <> ''").groupBy("word").agg(F.countDistinct("host").alias("n")).where("n > 1")
    return running.unionByName(labels).groupBy("word").agg(F.sum("n").alias("n"))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts to the names in their labels."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([_tokens(h) for h in batch.column("host").to_pylist()], pa.list_(pa.string()))], names=["host", "names"])


def _substrings(longest: int):
    """Names to their substrings up to the longest word; words are of letters, so none holds a digit."""

    def packed(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["name", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for word in (x[i:j] for x in _letters(name) for i in range(len(x)) for j in range(i + 1, min(len(x), i + longest) + 1)):
                    rows.append((name, word))
                    chars += len(name) + len(word)
                    if chars > BATCH_CHARS:
                        yield packed(rows)
                        rows, chars = [], 0
        if rows:
            yield packed(rows)

    return run, "name string, word string"


def _splits(total: int):
    """Names and the counts of the words in them to the words of the best split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, known = (batch.column(c).to_pylist() for c in ("name", "known"))
            found = [Segmenter({w["word"]: w["n"] for w in k or ()}, total).split(name) for name, k in zip(names, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("use"), pa.array(found, pa.list_(pa.string()))], names=["name", "use", "words"])

    return run, "name string, use long, words array<string>"


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, use, words) for each row of names (name, use), names distinct: the best split by all of words (word, n)."""
    size = words.agg(F.sum("n").alias("total"), F.max(F.length("word")).alias("longest")).first()
    inside = written(names.select("name").mapInArrow(*_substrings(size["longest"] or 0)), "uf-substrings")
    used = inside.groupBy("word").agg(F.count("*").alias("use")).join(words, "word", "left")
    known = spread_join(inside, used, "word").where("n is not null").groupBy("name").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    return names.join(known, "name", "left").select("name", "use", "known").mapInArrow(*_splits(size["total"] or 0))


def _path_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to the tokens of their paths, marked p: and cut to their kind if they are numbers."""
    for batch in batches:
        found = [["p:" + (t if not t.isdigit() else f"#{len(t)}") for t in _tokens(p.lower())] for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("verdict"), pa.array(found, pa.list_(pa.string()))], names=["row", "verdict", "features"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages (page_id, url, ...).

    host: after the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #; both empty for a null
    url or one without ://. rule: the longest that fits, else null. verdict: the rule's, else block if the log-odds
    ``score`` of naive Bayes are above 0, else allow; score is null where a rule fits. A token that no trained url has weighs nothing.
    Without trained urls the prior is even and
    the verdict allow. Repeated rows are judged alike. Columns other than page_id, url and html (if there) are not read.
    """
    out = _judged(pages, rules, F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "score")


def held_out_quality(pages: DataFrame, rules=RULES, folds: int = 5) -> DataFrame:
    """One row (pages, blocked, caught, wrong, precision, recall): naive Bayes against the rules on pages it has not learned from.

    Of the pages that a rule fits, those whose page_id has a CRC-32 divisible by folds are judged as if none did. blocked: how many of
    them the rules block; caught: how many of these naive Bayes blocks; wrong: how many it blocks that the rules allow.
    """
    held = F.coalesce(F.crc32(F.col("page_id").cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))
    out = _judged(pages, rules, held).where("ruled is not null and learned is not null")
    count = lambda c: F.count_if(F.expr(c))
    out = out.agg(F.count("*").alias("pages"), count("ruled = 'block'").alias("blocked"), count("ruled = 'block' and learned = 'block'").alias("caught"), count("ruled = 'allow' and learned = 'block'").alias("wrong"))
    return out.withColumn("precision", F.try_divide("caught", F.expr("caught + wrong"))).withColumn("recall", F.try_divide("caught", "blocked"))


def _judged(pages: DataFrame, rules, held: Column) -> DataFrame:
    """(page_id, host, path, rule, ruled, learned, score): the rule's verdict, and the method's where no rule fits or the page is held out."""
    url = F.col("url").cast("string")
    title = F.regexp_extract(F.col("html").cast("string"), r"(?is)<title>(.*?)</title>", 1) if "html" in pages.columns else F.lit("")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), title.alias("title"))
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", name).withColumn("ruled", ruled).withColumn("verdict", F.when(~held, F.col("ruled"))).withColumn("row", F.monotonically_increasing_id())
    with scratch():
        urls = keep(written(urls, "uf-urls"))
        is_block, is_allow, is_open = F.col("verdict") == "block", F.col("verdict") == "allow", F.col("verdict").isNull()
        hosts = written(urls.groupBy("host").agg(F.count_if(is_block).alias("block"), F.count_if(is_allow).alias("allow"), F.count_if(is_open).alias("use")), "uf-hosts")

        named = hosts.select("host").mapInArrow(_names, "host string, names array<string>").select("host", F.explode("names").alias("name"))
        splits = written(segmented(named.groupBy("name").agg(F.count("*").alias("use")), written(train_words(urls), "uf-words")), "uf-splits")
        of_host = spread_join(named, splits, "name").select("host", F.explode("words").alias("word"))
        of_host = hosts.join(of_host, "host").select("host", "block", "allow", (F.col("use") > 0).cast("long").alias("use"), F.concat(F.lit("h:"), "word").alias("feature"))
        of_host = written(of_host, "uf-host-tokens")
        of_path = urls.select("row", "path", "verdict").mapInArrow(_path_tokens, "row long, verdict string, features array<string>").select("row", "verdict", F.explode("features").alias("feature"))
        by_path = of_path.groupBy("feature").agg(F.count_if(is_block).alias("block"), F.count_if(is_allow).alias("allow"), F.count_if(is_open).alias("use"))
        counted = of_host.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("block", "allow", "use")]).unionByName(by_path)  # h: and p: share no token
        counted = written(counted, "uf-tokens")

        totals = counted.where("block + allow > 0").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n")).first()
        nb, na = ((totals[k] or 0) + totals["n"] + 1 for k in ("block", "allow"))
        prior = hosts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
        base = math.log(((prior["block"] or 0) + 1) / ((prior["allow"] or 0) + 1))
        weight = F.log((F.col("block") + 1) / F.lit(nb)) - F.log((F.col("allow") + 1) / F.lit(na))
        # decimals add up to the same sum in any order
        weights = counted.where("use > 0").select("feature", F.when(F.expr("block + allow > 0"), weight).otherwise(0.0).cast("decimal(28,20)").alias("w"), "use")
        by_host = spread_join(of_host.where("use > 0").select("host", "feature"), weights, "feature").groupBy("host").agg(F.sum("w").alias("of_host"))
        by_row = spread_join(of_path.where(is_open).select("row", "feature"), weights, "feature").groupBy("row").agg(F.sum("w").alias("of_path"))
        by_host = keep(written(hosts.where("use > 0").select("host", "use").join(by_host, "host", "left"), "uf-host-scores"))
        by_row = keep(written(by_row, "uf-path-scores"))

    opened = spread_join(urls.where(is_open).drop("title"), by_host, "host").join(by_row, "row", "left")
    none = F.lit(0).cast("decimal(38,20)")
    score = F.lit(base) + (F.coalesce("of_host", none) + F.coalesce("of_path", none)).cast("double")
    opened = opened.withColumn("score", score).withColumn("learned", F.when(F.col("score") > 0, "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "ruled", "learned", "score"]
    sure = urls.where("verdict is not null").withColumn("learned", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    return sure.select(columns).unionByName(opened.select(columns))
