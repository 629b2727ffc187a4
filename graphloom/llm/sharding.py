"""Sharding by law `bytes`: a minimax contiguous partition of ordered atomic groups.

Documents with equal texts form a group that stays in one shard. Groups are ordered by the
SHA-256 of their text, which deals sources and lengths evenly; a range sort by (digest, doc_id)
with running sums per partition, plus one offset per partition, gives every row its place in that
order, so that a group of any size is spread over as many tasks as it needs.

The smallest capacity that lets a greedy pass end within the given number of shards is found by
binary search. The driver never holds the group sizes: it holds a bounded set of known group ends
and marks the stretches between them that may hide others. A greedy pass that may cut only at known
ends gives an upper bound of the capacity, one that may cut anywhere in a hidden stretch gives a
lower bound. Only the stretches where the two disagree are binned anew by a distributed pass over
the group ends, until the bounds meet; each pass narrows them about `BINS` times.

Defined results: null and empty texts are one group of size 1 a row; a null doc_id sorts first in
its group; repeated rows take a slot each; with fewer groups than shards the last shards are empty;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize, partitions, table

BINS = 2048


def ordered_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the row's place (rows_to, bytes_to) in the global order by (digest, doc_id)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    ranged = materialize(rows, "shard-rows").repartitionByRange(partitions(spark), "digest", "doc_id").withColumn("part", F.spark_partition_id())
    in_part = Window.partitionBy("part").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (F.count(F.lit(1)).over(in_part).alias("rows_to"), F.sum("size").over(in_part).alias("bytes_to"))
    placed = materialize(materialize(ranged, "shard-ranges").select("*", *running), "shard-order")
    # One row per partition, whatever the number of documents.
    parts = sorted(placed.groupBy("part").agg(F.max("rows_to"), F.max("bytes_to")).collect())
    offsets, n, size = [], 0, 0
    for part, more, wide in parts:
        offsets.append((part, n, size))
        n, size = n + more, size + wide
    by_part = spark.createDataFrame(offsets, "part int, rows_before long, bytes_before long")
    return placed.join(F.broadcast(by_part), "part").select(
        "doc_id", "size", "text_crc32", "digest", (F.col("rows_before") + F.col("rows_to")).alias("rows_to"), (F.col("bytes_before") + F.col("bytes_to")).alias("bytes_to")
    )


class KnownEnds:
    """Known group ends in order; hidden[i] tells whether unknown ends may lie between ends[i] and ends[i + 1]."""

    def __init__(self, total: int):
        self.ends, self.hidden = [0, total], [True]

    def greedy(self, capacity: int, shards: int, anywhere: bool) -> list[int] | None:
        """Cuts of a greedy pass, or None if it needs more shards; anywhere: hidden stretches may be cut at any place."""
        cuts, at, total = [], 0, self.ends[-1]
        while at < total:
            if len(cuts) == shards:
                return None
            i = bisect_right(self.ends, at + capacity) - 1
            to = at + capacity if anywhere and i < len(self.hidden) and self.hidden[i] else self.ends[i]
            if to <= at:
                return None
            cuts.append(to)
            at = to
        return cuts

    def smallest(self, shards: int, anywhere: bool) -> int:
        low, high = -(-self.ends[-1] // shards), self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.greedy(mid, shards, anywhere) else (mid + 1, high)
        return low

    def refine(self, low: int, high: int, found: list[tuple[int, int, int]]) -> None:
        """Replace what lies between the known ends low and high by bins of (first end, last end, count), in order."""
        i, j = self.ends.index(low), self.ends.index(high)
        ends, hidden = [low], []
        for first, last, count in found:
            if first >= high:
                break
            hidden.append(False)
            ends.append(first)
            if last > first:
                hidden.append(count > 2)
                ends.append(last)
        if ends[-1] != high:
            hidden.append(False)
            ends.append(high)
        self.ends[i : j + 1], self.hidden[i:j] = ends, hidden


def minimax_cuts(group_ends: DataFrame, total: int, shards: int) -> list[int]:
    """Ends of the shards under the smallest feasible capacity; group_ends has the column `end`."""
    known = KnownEnds(total)
    while True:
        low, high = known.smallest(shards, True), known.smallest(shards, False)
        cuts = known.greedy(high, shards, False)
        if low == high:
            return cuts
        least, most = known.greedy(low, shards, True), known.greedy(high, shards, True)
        floor, at = [], 0
        for _ in range(shards):  # the lowest place that any pass in question may reach
            at = known.ends[bisect_right(known.ends, at + low) - 1]
            floor.append(at)
        spans: list[list[int]] = []
        for a, b in zip(floor, [*most, *[total] * shards], strict=False):
            i = bisect_right(known.ends, a) - 1
            j = min(bisect_right(known.ends, max(b, a)), len(known.ends) - 1)
            while i < j and not known.hidden[i]:
                i += 1
            while j > i and not known.hidden[j - 1]:
                j -= 1
            if i < j:
                spans.append([known.ends[i], known.ends[j]])
        spans.sort()
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        assert merged, (low, high, least)
        span, inside = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, (a, b) in enumerate(merged):
            here = (F.col("end") > a) & (F.col("end") < b)
            width = max(1, -(-(b - a) // BINS))
            span = F.when(here, F.lit(k)).otherwise(span)
            inside = F.when(here, F.floor((F.col("end") - a) / width)).otherwise(inside)
        binned = group_ends.select("end", span.alias("span"), inside.alias("bin")).where("span is not null")
        found = sorted(binned.groupBy("span", "bin").agg(F.min("end"), F.max("end"), F.count(F.lit(1))).collect())  # BINS rows a span at most
        for k, (a, b) in enumerate(merged):
            known.refine(a, b, [tuple(r[2:]) for r in found if r[0] == k])


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    rows = materialize(ordered_rows(docs), "shard-places")
    total = rows.agg(F.max("bytes_to")).first()[0]
    cuts = []
    if total:
        ends = materialize(rows.groupBy("digest").agg(F.max("bytes_to").alias("end")).select("end"), "shard-ends")
        cuts = minimax_cuts(ends, total, shards)
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("bytes_to") > c).cast("int")
    numbered = rows.withColumn("shard", number)
    before, n = F.lit(0).cast("long"), 0
    for k, rows_in in sorted(numbered.groupBy("shard").count().collect()):  # a row per shard
        before = F.when(F.col("shard") == k, F.lit(n)).otherwise(before)
        n += rows_in
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_to") - 1 - before).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
