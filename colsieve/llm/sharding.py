"""Sharding by minimax contiguous partition of ordered atomic groups.

Method. Rows with equal texts form a group that must not be split. Groups larger than an even share come first in the
order, each a shard of its own; the others follow in the order of their text's digest. The order is cut into
contiguous shards so that the largest is as small as possible: binary search over the capacity, each guess checked by
filling shards greedily; the cuts are those of the smallest feasible capacity.

Scale. The search never sees all groups. The driver holds units, each a run of neighbouring groups known by its digest
prefix, its bytes and its number of groups; the first list has at most 16^4 units. Cuts at unit boundaries give an
upper bound of the capacity, and units taken as divisible give a lower one. Greedy cuts move monotonically with the
capacity, so only units between the cuts of the two bounds can hold a true cut; those are split by further
digits of the digest and the search is repeated until all of them are single groups. So the result is exact, and
the driver's memory follows the number of shards, not the data. A group holding a third of the rows is one row after
partial aggregation, and slots are numbered within hash cells of doc_id, not within whole shards.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, local_frame, written

FIRST_DIGITS, MORE_DIGITS = 4, 2
CELLS = 2048


def greedy_cuts(starts: list[int], total: int, capacity: int, shards: int, single: list[bool] | None = None) -> list[int] | None:
    """The positions in bytes at which shards 1, 2, ... begin if each is filled up to capacity; None if it can't be.

    starts: the bytes before each unit. Cuts fall on unit boundaries; with ``single`` given, units that aren't single
    groups may be cut anywhere.
    """
    cuts, at = [], 0
    for _ in range(shards):
        limit = at + capacity
        if total <= limit:
            return cuts
        i = bisect_right(starts, limit) - 1
        after = starts[i] if single is None or single[i] else limit
        if after <= at:
            return None
        cuts.append(after)
        at = after
    return None


def least_capacity(sizes: list[int], shards: int, single: list[bool] | None = None) -> int:
    """The smallest capacity for which ``greedy_cuts`` finds cuts."""
    starts, total = [0, *accumulate(sizes)][:-1], sum(sizes)
    low, high = -(-total // shards), max(total, 1)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(starts, total, middle, shards, single) is None:
            low = middle + 1
        else:
            high = middle
    return low


def unsettled(units: list[tuple[str, int, int]], shards: int) -> tuple[list[int], list[int], int]:
    """Units (prefix, bytes, groups) that may hold a cut but aren't single groups; the unit-level cuts; their capacity."""
    sizes, single = [u[1] for u in units], [u[2] == 1 for u in units]
    starts, total = [0, *accumulate(sizes)][:-1], sum(sizes)
    most, least = least_capacity(sizes, shards), least_capacity(sizes, shards, single)
    spans: set[int] = set()
    low = high = 0
    for _ in range(shards - 1):
        i = bisect_right(starts, min(low + least, total - 1)) - 1
        j = bisect_right(starts, min(high + most, total - 1)) - 1
        spans.update(range(i, j + 1))
        low, high = starts[i], starts[j] if single[j] else min(high + most, total)
    cuts = [bisect_right(starts, at) - 1 for at in greedy_cuts(starts, total, most, shards) or []]
    return [i for i in sorted(spans) if not single[i]], cuts, most


def oversize(largest: list[int], total: int, shards: int) -> int:
    """How many of the groups, largest first, are more than an even share of what is left for the shards left."""
    n = 0
    while n < len(largest) and n < shards - 1 and largest[n] * (shards - n) > total:
        total -= largest[n]
        n += 1
    return n


def shard_cuts(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """Of groups (key, bytes): the keys that are shards of their own, and the key prefixes at which later shards begin."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = [(r["key"], r["bytes"]) for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()]
    alone = [k for k, _ in top[: oversize([b for _, b in top], total, shards)]]
    rest, left = groups.where(~F.col("key").isin(alone)) if alone else groups, shards - len(alone)

    def units(df: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        runs = df.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        return sorted((r["prefix"], r["b"], r["n"]) for r in runs.collect())

    have, digits = units(rest, FIRST_DIGITS), FIRST_DIGITS
    while have:
        open_, cuts, _ = unsettled(have, left)
        if not open_:
            return alone, [have[i][0] for i in cuts]
        # a unit's prefix may be shorter than the new one; it stays as it is unless it may hold a cut
        prefixes = {have[i][0] for i in open_}
        by_length: dict[int, list[str]] = {}
        for x in prefixes:
            by_length.setdefault(len(x), []).append(x)
        more = []
        for n, some in by_length.items():
            wanted = local_frame(groups.sparkSession, [(x,) for x in some], p=pa.string())
            more += units(rest.join(F.broadcast(wanted), F.substring("key", 1, n) == F.col("p"), "left_semi"), n + MORE_DIGITS)
        have = sorted([u for u in have if u[0] not in prefixes] + more)
        digits += MORE_DIGITS
    return alone, []


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text, ...).

    size: the text's UTF-8 bytes plus ``overhead``. Rows with equal texts share a shard; null texts are one group of
    size ``overhead`` each and CRC 0. Slots count from 0 within a shard without gaps, in an order by hash of doc_id;
    repeated rows get slots of their own. Shards that get nothing exist only by number. law is ``bytes``, so
    grown_shard is null. Columns other than doc_id and text are not read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead
    key = F.concat(F.md5(F.coalesce("text", F.lit(""))), F.when(F.col("text").isNull(), "-").otherwise(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), key.alias("key"))
    rows = written(rows, "sh-rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "sh-groups")
    alone, cuts = shard_cuts(groups, shards)
    discard(groups)
    shard = F.lit(len(alone))
    for c in cuts:
        shard = shard + (F.col("key") >= c).cast("int")
    for i, k in enumerate(alone):
        shard = F.when(F.col("key") == k, F.lit(i)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    first = F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")
    cells = cells.select("shard", "cell", first.alias("first"))  # at most shards * CELLS rows
    within = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "key")) - 1
    out = placed.withColumn("within", within).join(F.broadcast(cells), ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
