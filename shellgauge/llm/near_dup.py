"""Near-duplicate classes by order MinHash.

A text is its sequence of 5-word windows, each labelled with its occurrence
number. A sketch takes the windows with the smallest hashes under one seed and
hashes them in the order in which they stand in the text, so it agrees only when
both the windows and their order do. Texts that share a sketch are candidates;
a banded alignment of their labelled windows verifies them: the longest chain of
equal windows that rises in both texts, over the windows of either, must reach
the similarity. A chain that long cannot leave the band, so the band loses
nothing.

Copies (texts of equal words) are one node. In every bucket of equal sketches
the members are first compared with one leader; connected components then tell
which members are still apart. Small buckets compare those pairs directly; the
members of crowded buckets meet through their rarest windows, which is exact and
keeps apart texts that have too many windows of their own. A group of near
copies costs its size, not its square, and no link that could join two classes
is left out. Buckets meet by counts combined before they move, and joins on them
are ordinary shuffles.

Defaults miss a pair of similarity 0.8 with a chance of about one in ten
million. Texts of few windows have sketches of fewer minima, and texts of less
than four windows are similar only to their copies.

Null and empty texts have no words and are copies of each other. Rows with equal
words are one class, whatever their keys. A class is named by its smallest key;
rows without a key name a class only if no row of it has one. Repeated rows each
give a row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellgauge.llm.common import BLANKS, in_small_batches, text_or_empty, words, worker_keeps
from shellgauge.session import checkpoint, scratch, small

WINDOW, SIMILARITY = 5, 0.8
#: Sketches and minima of a sketch; for texts of at most SHORT windows also the second kind.
SKETCHES, MINIMA = 40, 5
SHORT, SHORT_SKETCHES, SHORT_MINIMA = 40, 20, 2
LONG = 20
#: Members of a bucket that are compared with each other directly; beyond, pairs are found by prefixes.
DIRECT = 12
SEED = 77
#: Hashes of a text's windows under several seeds at once take at most this many cells.
CELLS = 1 << 20
#: Rows of the largest set of dropped documents that is broadcast.
MAX_DROPPED = 200_000
#: Parts of the hash by which windows are counted, a power of two.
COUNTED = 128
#: Edges a task of the components takes, about.
TASK_EDGES = 500_000
#: Words whose hash a worker remembers.
CACHE_WORDS = 200_000
WORD = re.compile(rf"[^{BLANKS}]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; the constants are arbitrary odd numbers."""
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def windows(sequence: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word windows, labelled with their occurrence numbers; one window for a shorter text."""
    if not len(sequence):
        return np.zeros(0, dtype=np.uint64)
    step = sequence.astype(np.uint64)
    size = min(WINDOW, len(step))
    n = len(step) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0x100000001B3) + mixed(step[j : j + n])
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        label = np.empty(n, dtype=np.uint64)
        label[order] = (at - first).astype(np.uint64)
        h = mixed(h + label * _ODD)
    return h


def sketch(h: np.ndarray, count: int, minima: int, seed: int) -> np.ndarray:
    """``count`` hashes, each of the ``minima`` smallest windows in text order."""
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20))
    out = np.empty(count, dtype=np.uint64)
    step = max(1, CELLS // len(h))
    for a in range(0, count, step):
        own = seeds[a : a + step, None]
        values = mixed(h[None, :] ^ own)
        least = np.sort(np.argpartition(values, minima - 1, axis=1)[:, :minima], axis=1)
        chosen = np.take_along_axis(values, least, axis=1)
        total = own[:, 0].copy()
        for k in range(minima):
            total = mixed(total * np.uint64(0x100000001B3) + chosen[:, k])
        out[a : a + step] = total
    return out


def sketches(h: np.ndarray) -> np.ndarray:
    parts = []
    if len(h) >= LONG:
        parts.append(sketch(h, SKETCHES, MINIMA, SEED))
    if SHORT_MINIMA <= len(h) <= SHORT and len(h) > 3:
        parts.append(sketch(h, SHORT_SKETCHES, SHORT_MINIMA, SEED + 1))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two window sequences: the longest banded rising chain of equal windows over all windows."""
    total = len(a) + len(b)
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (1 - 2 * SIMILARITY / (1 + SIMILARITY)) * total + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < SIMILARITY * (total - len(i)):
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        ends: list[int] = []
        for x in j.tolist():
            k = bisect_left(ends, x)
            ends[k : k + 1] = [x]
        chain = len(ends)
    return chain / (total - chain)


def text_id(text: Column) -> Column:
    """One id for all texts of the same words."""
    return F.unhex(F.md5(F.array_join(words(text), " ").cast("binary")))


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``tid``, ``n`` windows, ``sequence`` of word hashes and ``sketches`` of every row."""
    source = in_small_batches(docs).select(F.col(key).alias("key"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_keeps(("near_dup",), WordHashes)
        for batch in batches:
            tids, sizes, sequences, found = [], [], [], []
            for t in batch.column(1).to_pylist():
                own = WORD.findall(t)
                tids.append(hashlib.md5(" ".join(own).encode()).digest())
                sequence = np.fromiter(map(hashes.__getitem__, own), dtype=np.uint64, count=len(own)).astype(np.uint32)
                h = windows(sequence)
                sizes.append(len(h))
                sequences.append(sequence.tobytes())
                found.append(sketches(h).view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sequences, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                ["key", "tid", "n", "sequence", "sketches"],
            )

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, tid binary, n int, sequence binary, sketches array<long>")


def verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose alignment reaches the similarity."""
    own = lambda side: sequences.select(F.col("node").alias(side), F.col("sequence").alias(f"s{side}"))
    both = pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda raw: windows(np.frombuffer(raw, dtype=np.uint32))
        for batch in batches:
            good = [aligned(read(x), read(y)) >= SIMILARITY for x, y in zip(batch["sa"], batch["sb"])]
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def prefix_pairs(open_nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of different roots that may be similar, for nodes of crowded buckets.

    Windows are ordered from rare to common. If two texts are similar, the first
    window they share leaves each of them enough windows for the chain, so it
    stands in a short prefix. A text with many edits of its own has only windows
    of its own there and meets nobody; what is left of a crowd mostly has one
    root, and only members of other roots are joined with the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [windows(np.frombuffer(raw, dtype=np.uint32)).view(np.int64) for raw in batch.column(2).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found]))
            parts = [np.bincount(f & (COUNTED - 1), minlength=COUNTED).astype(np.int32) for f in found]
            counts = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *parts])), COUNTED)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat), counts.cast(pa.list_(pa.int32()))],
                ["node", "root", "w", "counts"],
            )

    source = open_nodes.join(sequences, "node").select("node", "root", "sequence")
    windowed = _written(source.mapInArrow(run, "node long, root long, w array<long>, counts array<int>"), "near-windows")
    each = windowed.select("node", "root", F.size("w").alias("n"), F.explode("w").alias("w"))
    common = each.groupBy("w").agg(F.count("*").alias("texts"))
    ordered = each.join(common, "w").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "w"))).alias("l"))
    short = F.slice("l", 1, (F.col("n") - F.ceil(F.col("n") * SIMILARITY) + 1).cast("int"))
    prefix = ordered.select("node", "root", "n", F.posexplode(short).alias("pos", "x")).filter("x.texts > 1")
    prefix = prefix.select("node", "root", "n", "pos", F.col("x.w").alias("w")).join(windowed.select("node", "counts"), "node")
    prefix = _written(prefix, "near-prefixes")
    of_root = prefix.groupBy("w", "root").count().groupBy("w").agg(F.max_by("root", "count").alias("main"), F.count("*").alias("roots"))
    crowd = prefix.join(of_root.filter("roots > 1").drop("roots"), "w")
    one = crowd.filter(F.col("root") != F.col("main")).select("w", *[F.col(c).alias(f"{c}_1") for c in ("node", "root", "n", "pos", "counts")])
    other = crowd.select("w", "main", *[F.col(c).alias(f"{c}_2") for c in ("node", "root", "n", "pos", "counts")])
    chain = (F.col("n_1") + F.col("n_2")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    apart = F.aggregate(F.zip_with("counts_1", "counts_2", lambda x, y: F.abs(x - y)), F.lit(0), lambda a, x: a + x)
    return (
        one.join(other, "w")
        .filter((F.col("root_1") != F.col("root_2")) & ((F.col("root_2") == F.col("main")) | (F.col("node_1") < F.col("node_2"))))
        .filter((F.col("n_1") - F.col("pos_1") >= chain) & (F.col("n_2") - F.col("pos_2") >= chain))
        .filter(F.col("n_1") + F.col("n_2") - apart >= 2 * chain)
        .select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node with an edge.

    Nodes take the least root among their neighbours, then the root of their
    root, until nothing changes; each round is checkpointed.
    """
    tasks = 1 + 2 * edges.count() // TASK_EDGES
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().coalesce(tasks))
    roots = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")).coalesce(tasks))
    while True:
        offered = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("offer"))
        nearer = roots.join(offered, F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root")
        )
        of_root = nearer.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = checkpoint(
            nearer.join(of_root, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
            .coalesce(tasks)
        )
        changed = moved.filter(F.col("old") != F.col("root")).limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots


def _written(df: DataFrame, name: str) -> DataFrame:
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``tid``, ``class`` (its least node) and ``class_id`` (its least key) of every row."""
    rows = _written(measured(docs, key, text), "near-rows")
    once = rows.groupBy("tid").agg(F.min("key").alias("least_key"), F.max(F.struct("n", "sketches")).alias("s"))
    nodes = _written(
        once.select(F.monotonically_increasing_id().alias("node"), "tid", "least_key", F.col("s.n").alias("n"), F.col("s.sketches").alias("sketches")),
        "near-nodes",
    )
    buckets = nodes.select("node", "n", F.explode("sketches").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("leader")).filter(F.col("members") > 1)
    members = _written(buckets.join(shared.drop("members"), "bucket"), "near-members")
    # sequences of the texts that share a bucket, once for each node
    wanted = members.select("node").distinct().join(nodes.select("node", "tid"), "node")
    first = rows.select("tid", "sequence").join(wanted, "tid").groupBy("node").agg(F.max("sequence").alias("sequence"))
    sequences = _written(first, "near-sequences")
    stars = members.filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    edges = _written(verified(stars, sequences), "near-edges")
    roots = components(edges)
    # members of a bucket that are still in different components
    placed = members.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    still = _written(placed.join(apart.filter("low <> high").select("bucket", "members"), "bucket"), "near-open")
    few, many = still.filter(F.col("members") <= DIRECT), still.filter(F.col("members") > DIRECT)
    direct = few.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "n", "root"))).alias("m"))
    direct = direct.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).filter(
        (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
        & (F.least("a.n", "b.n") >= SIMILARITY * F.greatest("a.n", "b.n"))
    )
    rest = direct.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).union(
        prefix_pairs(many.select("node", "root").distinct(), sequences)
    ).distinct().join(stars, ["a", "b"], "left_anti")
    more = _written(verified(rest, sequences), "near-edges")
    joined = components(edges.unionByName(more))
    of_node = nodes.select("node", "tid", "least_key").join(joined, "node", "left").withColumn("class", F.coalesce("root", "node"))
    named = of_node.groupBy("class").agg(F.min("least_key").alias("class_id"))
    of_text = of_node.select("tid", "class").join(named, "class")
    return rows.select(F.col("key").alias(key), "tid").join(of_text, "tid").select(key, "tid", "class", "class_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``class_id`` of every row."""
    return classes(docs, key, text).select(key, "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay when each class keeps one: the least key, then the least text id."""
    found = _written(classes(docs, key, text).select(F.col(key).alias("key"), "tid", "class"), "near-classes")
    chosen = found.groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid")).alias("c"))
    pairs = found.groupBy("key", "tid", "class").count()
    told = pairs.join(chosen, "class").withColumn(
        "stays", F.col("key").eqNullSafe(F.col("c.key")) & (F.col("tid") == F.col("c.tid"))
    )
    dropped = told.filter(~F.col("stays")).select("key", "tid")
    repeated = told.filter(F.col("stays") & (F.col("count") > 1)).select("key", "tid")
    packed = docs.select(F.struct("*").alias("__doc")).withColumns(
        {"__key": F.col("__doc")[key], "__tid": text_id(text_or_empty(F.col("__doc")[text]))}
    )
    same = F.col("__key").eqNullSafe(F.col("key")) & (F.col("__tid") == F.col("tid"))
    out = small(dropped.unionByName(repeated), MAX_DROPPED)
    single = packed.join(out, same, "left_anti")
    again = packed.join(small(repeated, MAX_DROPPED), same, "left_semi")
    number = F.row_number().over(Window.partitionBy("__key", "__tid").orderBy(F.xxhash64("__doc")))
    first = again.withColumn("__n", number).filter(F.col("__n") == 1).drop("__n")
    return single.unionByName(first).select("__doc.*")
