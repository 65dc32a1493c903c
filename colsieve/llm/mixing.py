"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Method. A source's target is the lesser of ``epochs`` times its size and level times its weight; the level is the
one at which the targets add up to the wanted total. That is the fixed point of clamping and resharing the excess by
weight, and it is found without a loop: with sources ordered by the level at which they clamp, it is the first one
whose level, given all before it clamped, does not reach its own. Each document is then taken a whole number of
times, and a seeded order of the documents decides which are taken once more, up to the source's remaining words; the
document at the edge is taken in part, so that a source meets its target to the word.

Scale. Sizes of sources are partial sums, so a hot source costs nothing extra. The seeded order is cut into
``SLOTS`` slots a source; running sums go over slots, and over single rows only within the slot at the edge. The
table of sources is broadcast only while it has at most ``MOST_BROADCAST`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

WORD = r"[^\\x20\\x09-\\x0D]+"
SLOTS = 4096
MOST_BROADCAST = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], epochs: float, share: float) -> DataFrame:
    """(source, source_size, target) of a table of sources (source, source_size).

    Weights repeat over the sources in code point order, null last; together the targets are ``share`` of all sizes.
    """
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    caps = sources.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size")).withColumn("clamps_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("clamps_at", F.asc_nulls_last("source"))
    everything = W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = caps.withColumn("level", (share * F.sum("source_size").over(everything) - before) / rest)
    # from the first level that reaches no clamp on, levels only fall
    level = F.max(F.when(F.col("level") <= F.col("clamps_at"), F.col("level"))).over(everything)
    return levels.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """(_id, _source, _size, _order, _slot, more): what the mix needs of each row."""
    order = F.xxhash64(docs["doc_id"].cast("long"), F.lit(seed))
    source = docs["source"].cast("string").alias("_source")
    return docs.select(docs["doc_id"].cast("long").alias("_id"), source, n_words().alias("_size"), order.alias("_order"), F.pmod(order, F.lit(SLOTS)).alias("_slot"), *more)


def _plan(sized: DataFrame, weights: tuple[float, ...], epochs: int, share: float) -> DataFrame:
    """(source, source_size, target, times, need, edge, passed): how often a source is taken whole, how many words more,
    the slot where these end and the words in the slots before it."""
    slots = written(sized.groupBy(F.col("_source").alias("of"), F.col("_slot").alias("slot")).agg(F.sum("_size").alias("words")), "mix-slots")
    plan = targets(slots.groupBy(F.col("of").alias("source")).agg(F.sum("words").alias("source_size")), tuple(weights), float(epochs), share)
    plan = plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("need", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    through = slots.withColumn("through", F.sum("words").over(W.partitionBy("of").orderBy("slot")))
    edge = through.join(plan.select("source", "need"), F.expr("of <=> source")).where("need > 0 and through >= need")
    # running sums grow with the slot, so the first slot that reaches the need also has the least sum before it
    edge = edge.groupBy("of").agg(F.min("slot").alias("edge"), F.min(F.col("through") - F.col("words")).alias("passed"))
    plan = written(plan.join(edge, F.expr("source <=> of"), "left").drop("of"), "mix-plan")
    discard(slots)
    return plan


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized with the columns of its source's plan and ``extra``, the words of a further repetition."""
    few = plan.count() <= MOST_BROADCAST
    rows = sized.join(F.broadcast(plan) if few else plan, F.expr("_source <=> source"))
    before = F.sum("_size").over(W.partitionBy("_source").orderBy("_order", "_id", "_size").rowsBetween(W.unboundedPreceding, -1))
    left = F.col("need") - F.col("passed") - F.coalesce(before, F.lit(0))
    at_edge = rows.where("_slot = edge").withColumn("extra", F.least("_size", F.greatest(F.lit(0), left)))
    others = rows.where("edge is null or _slot <> edge").withColumn("extra", F.when(F.col("_slot") < F.col("edge"), F.col("_size")).otherwise(0))
    return others.unionByName(at_edge)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, extra, taken) for each row of docs (doc_id, text, source, ...).

    size: number of words, 0 for null. times: whole repetitions; extra: words of one further, seeded repetition
    (all, none, or at one document of a source a part). taken = times * size + extra, at most epochs * size. Null is
    a source of its own. Sources without words have target 0. Reruns agree; repeated rows with equal doc_id and size
    share a place in the order, and it makes no difference which of them is taken. Columns other than doc_id, text
    and source are not read.
    """
    sized = written(_sized(docs, seed), "mix-sizes")
    out = _taken(sized, _plan(sized, weights, epochs, share))
    taken = (F.col("times") * F.col("_size") + F.col("extra")).alias("taken")
    return out.select(F.col("_id").alias("doc_id"), "source", F.col("_size").alias("size"), "source_size", "target", "times", "extra", taken)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken.

    A row taken in part comes with its first words, joined by one space, as text, and their length as n_chars if docs has that
    column. Rows taken not at all are absent.
    """
    sized = _sized(docs, seed, F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    plan = _plan(written(_sized(docs, seed), "mix-sizes"), weights, epochs, share)
    rows = _taken(sized, plan).withColumn("_copies", F.col("times") + (F.col("extra") > 0).cast("long")).where("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    part = (F.col("_copy") > F.col("times")) & (F.col("extra") < F.col("_size"))
    words = F.expr(f"array_join(slice(regexp_extract_all(_doc.text, '{WORD}', 0), 1, cast(extra as int)), ' ')")
    rows = rows.withColumn("_text", F.when(part, words).otherwise(F.col("_doc.text")))
    column = {"text": F.col("_text"), "n_chars": F.when(part, F.char_length("_text")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(column[c] if c in column else F.col(f"_doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
