"""Minimax contiguous sharding of atomic groups.

Rows with equal texts form an atomic group; groups are ordered by the 64-bit
hash of their text (texts that share a hash share a group). The smallest shard
capacity for which a greedy pass over the ordered groups needs no more shards
than asked is found by binary search, and the groups are cut there.

The order is never brought to the driver. It sees sums over hash ranges: first
a fixed number of equal ranges, then, round by round, finer ones only where a
cut can still fall. A capacity that works for whole ranges works; one that fails
when ranges may be split anywhere fails; the two bounds close in until every
range that may hold a cut is one group. Each round brings about
``RANGES`` rows, whatever the input; the rounds grow with its logarithm.

Shards follow from a row's hash by comparison with the cuts, without a join.
Slots come from counts per shard and bucket plus a rank inside the bucket, so
no shard is ever one task.

Null texts read as empty, of no bytes. Empty tables give no rows. Repeated rows
are rows of their own, in one shard, each with its own slot; among equal ids and
texts the order of slots is open. A group larger than a fair share sets the
capacity. Shards may be empty when there are fewer groups than shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellgauge.llm.common import text_or_empty
from shellgauge.session import scratch

#: Bytes added to every row's text.
OVERHEAD = 16
#: Hash ranges whose sums the driver may hold at once.
RANGES = 1 << 14
#: Bits by which every round narrows the ranges it reads again, at least.
LEAST_GAIN = 3
#: Rows of a slot bucket, about.
BUCKET_ROWS = 1000
#: Hashes are not negative.
LOWEST, HIGHEST = 0, (1 << 63) - 1


@dataclass
class Ranges:
    """Ordered hash ranges: first and last hash that occur, bytes, and the width in bits they were read at."""

    first: np.ndarray
    last: np.ndarray
    size: np.ndarray
    bits: np.ndarray

    @property
    def atomic(self) -> np.ndarray:
        return self.first == self.last

    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)


def furthest(bounds: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Greedy cuts (indexes into the groups), the latest possible; None if they do not fit."""
    cuts, at = [0], 0
    for _ in range(shards):
        at = int(np.searchsorted(bounds, bounds[at] + capacity, side="right")) - 1
        cuts.append(at)
    return np.array(cuts) if at == len(bounds) - 1 else None


def earliest(bounds: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Greedy cuts from the end, the earliest possible."""
    mirrored = furthest(bounds[-1] - bounds[::-1], capacity, shards)
    return None if mirrored is None else (len(bounds) - 1 - mirrored)[::-1]


def smallest_capacity(bounds: np.ndarray, shards: int) -> int:
    """Binary search for the smallest capacity that the greedy check accepts."""
    low, high = int(-(-bounds[-1] // shards)), int(bounds[-1])
    while low < high:
        middle = (low + high) // 2
        if furthest(bounds, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cut_evenly(bounds: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Cuts within the capacity, each as near its even place as the others allow."""
    late, early = furthest(bounds, capacity, shards), earliest(bounds, capacity, shards)
    cuts = [0]
    for j in range(1, shards):
        reach = int(np.searchsorted(bounds, bounds[cuts[-1]] + capacity, side="right")) - 1
        low, high = max(int(early[j]), cuts[-1]), min(int(late[j]), reach)
        ideal = bounds[-1] * j / shards
        k = int(np.searchsorted(bounds, ideal))
        if k and ideal - bounds[k - 1] < bounds[min(k, len(bounds) - 1)] - ideal:
            k -= 1
        cuts.append(min(max(k, low), high))
    return np.array([*cuts, len(bounds) - 1])


def _sums(sized: DataFrame, zoom: list[tuple[int, int, int]]) -> Ranges:
    """Sums over the pieces of each zoomed range; ``zoom`` holds first, last and bits to drop."""
    starts = F.array(*[F.lit(z[0]) for z in zoom])
    # the ranges are ordered and apart: the last that starts at or before the hash is the only candidate
    lines = "CASE " + " ".join(f"WHEN h >= {a}L THEN {i}" for i, (a, _, _) in reversed(list(enumerate(zoom)))) + " END"
    part = sized.withColumn("z", F.expr(lines)).filter(F.col("z").isNotNull())
    ends = F.array(*[F.lit(z[1]) for z in zoom])
    drop = F.array(*[F.lit(z[2]) for z in zoom])
    at = F.col("z")
    rows = (
        part.filter(F.col("h") <= F.get(ends, at))
        .withColumn("piece", F.call_function("shiftrightunsigned", F.col("h") - F.get(starts, at), F.get(drop, at)))
        .groupBy("z", "piece")
        .agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("size"))
        .orderBy("first")
        .collect()
    )
    return Ranges(
        np.array([r["first"] for r in rows], dtype=np.int64),
        np.array([r["last"] for r in rows], dtype=np.int64),
        np.array([r["size"] for r in rows], dtype=np.int64),
        np.array([zoom[r["z"]][2] for r in rows], dtype=np.int64),
    )


def _open_ranges(ranges: Ranges, shards: int) -> list[np.ndarray]:
    """Runs of ranges in which a cut may still fall and that are not all single groups; fewer than shards."""
    bounds = ranges.bounds()
    high = smallest_capacity(bounds, shards)
    late, early = furthest(bounds, high, shards), earliest(bounds, high, shards)
    total, marked = int(bounds[-1]), np.zeros(len(ranges.size), dtype=bool)
    for j in range(1, shards):
        # where ranges may be split, greedy cuts reach up to j * high; one range of slack covers the rest
        low = min(int(early[j]), int(np.searchsorted(bounds, max(0, total - (shards - j) * high), side="right")) - 1)
        top = max(int(late[j]), int(np.searchsorted(bounds, min(total, j * high), side="left")))
        marked[max(0, low - 1) : top + 1] = True
    at = np.flatnonzero(marked)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return [run for run in runs if len(run) and not ranges.atomic[run].all()]


def plan_cuts(sized: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hashes of shards 1.. (ascending) and the capacity, for rows of ``h`` and ``size``."""
    ranges = _sums(sized, [(LOWEST, HIGHEST, HIGHEST.bit_length() - (RANGES.bit_length() - 1))])
    if not len(ranges.size):
        return [], 0
    while runs := _open_ranges(ranges, shards):
        share = max(2, RANGES // len(runs))
        zoom = []
        for run in runs:
            a, b = int(ranges.first[run[0]]), int(ranges.last[run[-1]])
            even = (b - a).bit_length() - (share.bit_length() - 1)
            zoom.append((a, b, max(0, min(even, int(ranges.bits[run].min()) - LEAST_GAIN))))
        finer = _sums(sized, zoom)
        keep = np.ones(len(ranges.size), dtype=bool)
        for run in runs:
            keep[run[0] : run[-1] + 1] = False
        merged = [np.concatenate([getattr(ranges, c)[keep], getattr(finer, c)]) for c in ("first", "last", "size", "bits")]
        order = np.argsort(merged[0], kind="stable")
        ranges = Ranges(*[m[order] for m in merged])
    bounds = ranges.bounds()
    capacity = smallest_capacity(bounds, shards)
    cuts = cut_evenly(bounds, capacity, shards)
    starts = [int(ranges.first[c]) if c < len(ranges.first) else None for c in cuts[1:-1]]
    return [s for s in starts if s is not None], capacity


def shard(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``size``, ``text_crc32``, ``shard`` and ``slot``, beside its key.

    ``slot`` counts from 0 without gaps inside a shard, in an order that depends
    on keys and texts alone.
    """
    spark = df.sparkSession
    whole = text_or_empty(text)
    at = scratch(spark, "shards")
    df.select(
        F.col(key),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).bitwiseAND(F.lit(HIGHEST)).alias("h"),
        F.xxhash64(F.col(key), whole).alias("k"),
    ).write.parquet(at)
    sized = spark.read.parquet(at)
    starts, _ = plan_cuts(sized, shards)
    number = sum((F.when(F.col("h") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    dealt = sized.withColumn("shard", number.cast("int"))
    rows = sized.count()
    buckets = max(1, -(-rows // (BUCKET_ROWS * shards)))
    dealt = dealt.withColumn("bucket", F.pmod(F.col("k"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "bucket").count()
        .select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("k", key))
    return (
        dealt.withColumn("rank", rank)
        .join(offsets, ["shard", "bucket"])
        .select(key, "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))
    )
