"""Phrases whose words occur together more often than apart.

A suffix is a word of a piece of text with the words behind it, up to ``LONGEST``.
The suffixes of all texts that begin with the same words are brought together and
sorted by multikey three-way quicksort, word by word and no deeper than ``LONGEST``:
the suffixes that equal the pivot at a depth share that many leading words, so the
size of that part is the count of the phrase, and it alone goes on to the next
depth. A part that holds fewer than the least count is abandoned: nothing in it can
be a candidate. All parts of a bucket are cut at once, one pivot each, so a bucket
takes as many passes as its longest chain of pivots.

Single words are counted first. Equal suffixes of one task are counted before they
are routed, and go as compressed blocks of one bucket each. They are routed by group
and leading word; those of a hot word by two words, and where the second is hot too,
by three. What is split so is never abandoned above the depth it is split at, and its
counts are added up after.

Counts of the parts of a phrase come from the same table. The most frequent phrases
are parts of many others, so they are sent to all tasks (they are few: a share of
all words each); all others are joined, where none is a part of many.

Phrases: texts lose the case of A-Z, are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces
and those at spaces and tabs into words. A phrase of two or three words is cut after
the word where ``floor(1000000 a a / (l r))`` is least, ties to the first cut; a, l
and r count the phrase and its two sides. A phrase is dropped if a longer candidate
holds it and occurs at least ``SWALLOWED`` percent as often.

Null texts read as empty and give no words; a null group is named ``und``, and one table with
those of that name. Ties of score and count fall by phrase, in byte order. Repeated
rows count each. Empty tables give no rows. Other columns are ignored, whatever
their names. A text of any length is read in whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellgauge.llm.common import in_small_batches, text_or_empty
from shellgauge.session import scratch

#: Words of a phrase, at most; occurrences of a candidate, at least.
LONGEST, LEAST = 3, 10
#: Per cent of a phrase's occurrences that a longer candidate must have to drop it.
SWALLOWED = 50
#: Phrases that are returned for each group.
TOP = 2000
#: Fixed value: the group of rows that have none.
UNKNOWN = "und"
#: Words that a task holds before it hands on their counted suffixes.
HELD = 1 << 20
#: Words of a bucket, about; a word that occurs more often than this is hot, and how many are, at most.
BUCKET_ROWS, SPLIT_ROWS, MOST_SPLIT = 500_000, 200_000, 4_000_000
#: A phrase that occurs as often as this part of all words is looked up without a shuffle; so are three times as many, at most.
HEAD_PART = 10_000
#: Parts of a group that rank their own phrases before the group does.
RANKS = 32

BREAK = b"\n"
#: Marks that end a piece become line feeds, tabs become spaces.
CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


class Numbers(dict):
    """Numbers of words in the order they are met; the break is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_and_breaks(text: str) -> list[bytes]:
    """The words of a text, with a break between pieces and at the end."""
    cut = text.encode("utf-8").lower().translate(CUTS).replace(BREAK, b" \n ").split(b" ")
    return [w for w in cut if w] + [BREAK]


def distinct_triples(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct suffixes of a sequence of word numbers (0 is a break) and how often each occurs."""
    x = np.append(x, [0, 0])
    first = np.flatnonzero(x)
    one, two = x[first], x[first + 1]
    three = np.where(two > 0, x[np.minimum(first + 2, len(x) - 1)], 0)
    bits = int(x.max()).bit_length()
    if 3 * bits < 64:
        distinct, n = np.unique(one << 2 * bits | two << bits | three, return_counts=True)
        mask = (1 << bits) - 1
        return distinct >> 2 * bits, distinct >> bits & mask, distinct & mask, n
    pairs, of = np.unique(one << 32 | two, return_inverse=True)
    distinct, n = np.unique(of << 32 | three, return_counts=True)
    mask = (1 << 32) - 1
    pair = pairs[distinct >> 32]
    return pair >> 32, pair & mask, distinct & mask, n


def source(docs: DataFrame, text: str, group: str) -> DataFrame:
    """``g``, never NULL, and ``t``."""
    return in_small_batches(docs).select(F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)).alias("g"), text_or_empty(text).alias("t"))


def count_words(texts: DataFrame) -> DataFrame:
    """``g``, ``phrase`` (one word) and ``f`` over all texts; a task counts up to ``HELD`` different words before it hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for g, own in counts.items():
                own.pop(BREAK, None)
                words = pa.array(list(own), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], ["g", "phrase", "f"])

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(g, Counter()).update(words_and_breaks(t))
            if sum(map(len, counts.values())) > HELD:
                yield from counted()
                counts.clear()
        yield from counted()

    return texts.mapInArrow(run, "g string, phrase string, f long").groupBy("g", "phrase").agg(F.sum("f").alias("f"))


def word_hash(g: str, word: bytes) -> int:
    """What Spark's ``xxhash64`` gives for the group, a break and the word, without a sign."""
    return xxhash.xxh64_intdigest(g.encode() + BREAK + word, 42)


def packed(words: list[bytes], triples: list[np.ndarray], n: np.ndarray, split: np.ndarray) -> bytes:
    """Suffixes of one bucket as compressed bytes: their own words once, and the numbers of these, sorted."""
    own, of = np.unique(np.concatenate(triples), return_inverse=True)
    text = BREAK.join(map(words.__getitem__, own.tolist()))
    numbers = of.reshape(3, -1).astype(np.int32)
    head = np.array([len(text), len(n)], dtype=np.int64)
    return zstandard.compress(head.tobytes() + text + numbers.tobytes() + n.astype(np.int64).tobytes() + split.astype(np.int8).tobytes(), 3)


def unpacked(blob: bytes, numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of three words, numbered by ``numbers``, their counts and their splits."""
    raw = zstandard.decompress(blob)
    size, rows = np.frombuffer(raw, np.int64, 2).tolist()
    own = np.array([numbers[w] if w else 0 for w in raw[16 : 16 + size].split(BREAK)], dtype=np.int64)
    at = 16 + size
    keys = np.frombuffer(raw, np.int32, 3 * rows, at).reshape(3, -1)
    n = np.frombuffer(raw, np.int64, rows, at + 12 * rows)
    return own[keys].T, n, np.frombuffer(raw, np.int8, rows, at + 20 * rows).astype(np.int64)


def routed(texts: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """``bucket``, ``g`` and ``suffixes``: those of two words or more that a task met, by leading words.

    A suffix goes by its first word; by two, where the first is hot; by three, where the second is hot too.
    No bucket key then has more suffixes than a word that is not hot, but one whole phrase of three.
    """
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        numbers, size = Numbers(), 0

        def by_bucket() -> Iterator[pa.RecordBatch]:
            words = [b"", *list(numbers)[1:]]
            for g, sequence in held.items():
                *triples, n = distinct_triples(np.array(sequence, dtype=np.int64))
                used = triples[1] > 0
                one, two, three = (x[used] for x in triples)
                n = n[used]
                hashes = np.array([word_hash(g, w) for w in words], dtype=np.uint64)
                is_hot = np.isin(hashes, sent.value)
                first, second = is_hot[one], is_hot[one] & is_hot[two]
                route = hashes[one] + np.where(first, hashes[two], 0) * np.uint64(0x9E3779B97F4A7C15)
                route ^= np.where(second, hashes[three], 0) * np.uint64(0xC2B2AE3D27D4EB4F)
                bucket = ((route * np.uint64(0x9E3779B185EBCA87)) >> np.uint64(24)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets))), len(order))
                split = first.astype(np.int8) + second
                rows: list[tuple[int, bytes]] = []
                for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    part = order[low:high]
                    rows.append((int(bucket[part[0]]), packed(words, [x[part] for x in (one, two, three)], n[part], split[part])))
                for at in range(0, len(rows), 1000):
                    some = rows[at : at + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _ in some], pa.int64()), pa.array([g] * len(some), pa.string()), pa.array([x for _, x in some], pa.binary())],
                        ["bucket", "g", "suffixes"],
                    )

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_and_breaks(t)
                held.setdefault(g, []).extend(map(numbers.__getitem__, found))
                size += len(found)
                if size > HELD:
                    yield from by_bucket()
                    held, numbers, size = {}, Numbers(), 0
        yield from by_bucket()

    return texts.mapInArrow(run, "bucket long, g string, suffixes binary")


def count_prefixes(keys: np.ndarray, n: np.ndarray, split: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of rows of ``keys``, each ``n`` times; 0 ends a row.

    Gives an example row, the length and the count of every prefix whose count is at
    least ``least``, and of all prefixes of up to ``split`` keys: those are counted
    elsewhere too. Rows with equal prefixes agree on whether ``split`` reaches them.
    """
    none = np.zeros(0, dtype=np.int64)
    rows, found, turn = np.arange(len(keys)), [(none, none, none)], 0
    starts = np.zeros(min(len(keys), 1), dtype=np.int64)
    depths = np.zeros(len(starts), dtype=np.int64)
    while len(starts):
        sizes = np.diff(np.append(starts, len(rows)))
        part = np.repeat(np.arange(len(starts)), sizes)
        # the pivot's place in its part changes from pass to pass
        turn += 1
        pivot_at = starts + (sizes * (turn * 0.6180339887 % 1)).astype(np.int64)
        own = keys[rows, depths[part]]
        pivot = own[pivot_at][part]
        piece = part * 3 + 1 + (own > pivot) - (own < pivot)
        order = np.argsort(piece, kind="stable")
        rows, piece = rows[order], piece[order]
        cuts = np.flatnonzero(np.diff(piece, prepend=-1))
        piece = piece[cuts]
        counts = np.add.reduceat(n[rows], cuts)
        depths, equal = depths[piece // 3], piece % 3 == 1
        kept = (counts >= least) | (np.maximum.reduceat(split[rows], cuts) > depths)
        ended = equal & (keys[rows[cuts], depths] == 0)
        out = equal & kept & ~ended
        found.append((rows[cuts[out]], depths[out] + 1, counts[out]))
        # the equal part goes one key deeper, the others come again
        depths = depths + equal
        on = kept & ~ended & (depths < keys.shape[1])
        lengths = np.diff(np.append(cuts, len(rows)))
        rows = rows[np.repeat(on, lengths)]
        starts, depths = np.cumsum(np.append(0, lengths[on]))[:-1], depths[on]
    row, length, count = (np.concatenate(x) for x in zip(*found))
    return row, length, count


def count_phrases(suffixes: DataFrame) -> DataFrame:
    """``g``, ``phrase`` and ``f``, the count of every phrase of two words or more that occurs ``LEAST`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        numbers, groups = Numbers(), {}
        blocks, counts, splits = [], [], []
        for g, blob in zip(table.column("g").to_pylist(), table.column("suffixes").to_pylist()):
            words, n, split = unpacked(blob, numbers)
            # the group is the first key of all rows, and split everywhere
            group = np.full((len(n), 1), groups.setdefault(g, len(groups) + 1))
            blocks.append(np.hstack([group, words]))
            counts.append(n)
            splits.append(split + 1)
        keys = np.concatenate(blocks)
        row, length, count = count_prefixes(keys, np.concatenate(counts), np.concatenate(splits))
        wanted = length > 2
        row, k, count = row[wanted], length[wanted], count[wanted]
        names, of_group = [w.decode() for w in numbers], list(groups)
        found = [(of_group[x[0] - 1], " ".join([names[i] for i in x[1:m]])) for x, m in zip(keys[row].tolist(), k.tolist())]
        return pa.table(
            [pa.array([g for g, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array(count, pa.int64())],
            names=["g", "phrase", "f"],
        )

    counted = suffixes.groupBy("bucket").applyInArrow(run, "g string, phrase string, f long")
    return counted.groupBy("g", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= LEAST)


def frequent(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``g``, ``phrase`` and ``f`` of all phrases that occur ``LEAST`` times or more; ``words`` counts all single ones."""
    total = words.agg(F.sum("f")).first()[0] or 0
    # more than MOST_SPLIT words cannot be so frequent
    share = max(SPLIT_ROWS, total // MOST_SPLIT)
    key = F.xxhash64(F.concat_ws("\n", "g", "phrase")).alias("h")
    hot = words.filter(F.col("f") > share).select(key).toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    suffixes = routed(texts, max(1, total // BUCKET_ROWS), np.sort(hot))
    return words.filter(F.col("f") >= LEAST).unionByName(count_phrases(suffixes))


def with_count(rows: DataFrame, part: str, phrases: DataFrame, head: DataFrame, name: str) -> DataFrame:
    """The rows with the count of their phrase ``part``, of which every row has one."""
    quick = head.select("g", F.col("phrase").alias(part), F.col("f").alias("__quick"))
    known = rows.join(F.broadcast(quick), ["g", part], "left")
    # rows that have their count must not meet in one task: their key is their own, and no phrase holds a break
    own = F.when(F.col("__quick").isNull(), F.col(part)).otherwise(F.concat(F.lit("\n"), F.col("phrase")))
    slow = phrases.select("g", F.col("phrase").alias("__part"), F.col("f").alias("__slow"))
    found = known.withColumn("__part", own).join(slow, ["g", "__part"], "left")
    return found.withColumn(name, F.coalesce("__quick", "__slow")).drop("__part", "__quick", "__slow")


def score_of(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 a a / (left right))``, exact for counts below 10^14."""
    whole = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right))


def scored(phrases: DataFrame, words: int) -> DataFrame:
    """``g``, ``phrase``, ``a``, ``l``, ``r`` and ``score`` of the candidates that no longer one drops; ``words`` are all there are."""
    head = phrases.filter(F.col("f") * HEAD_PART > words)
    candidates = phrases.select("g", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).withColumn("k", F.size("w")).filter("k > 1")
    side = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cut = F.col("cut")
    cuts = candidates.select("g", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("g", "phrase", "a", "cut", side(F.lit(1), cut).alias("left"), side(cut + 1, F.col("k") - cut).alias("right"))
    sided = with_count(with_count(cuts, "left", phrases, head, "l"), "right", phrases, head, "r")
    by_cut = F.struct(score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")
    lowest = sided.groupBy("g", "phrase", "a").agg(F.min(by_cut).alias("low"))
    inside = candidates.filter(F.col("k") == LONGEST).select("g", "a", F.explode(F.array(side(F.lit(1), F.lit(2)), side(F.lit(2), F.lit(2)))).alias("phrase"))
    longer = inside.groupBy("g", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(longer, ["g", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < SWALLOWED * F.col("a")))
    return left.select("g", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each group: the group, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the group) and ``score``."""
    spark = docs.sparkSession
    words_at, phrases_at = scratch(spark, "words"), scratch(spark, "phrases")
    texts = source(docs, text, group)
    count_words(texts).write.parquet(words_at)
    words = spark.read.parquet(words_at)
    frequent(texts, words).write.parquet(phrases_at)
    sizes = words.groupBy("g").agg(F.sum("f").alias("n"))
    found = scored(spark.read.parquet(phrases_at), words.agg(F.sum("f")).first()[0] or 0)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("g", F.pmod(F.xxhash64("phrase"), F.lit(RANKS))).orderBy(*order)
    best = found.withColumn("__n", F.row_number().over(part)).filter(F.col("__n") <= top).drop("__n")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(sizes, "g").select(
        F.col("g").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
