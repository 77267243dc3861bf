"""Language-model scores from Brown word classes.

Every training word has a class of its own, found by exchange in two stages.

1. Units, the most frequent words and groups of all others by their last letters,
   are exchanged one by one until none gains: a unit moves to the class that raises
   the likelihood of the class bigrams most. A word starts in its unit's class.
2. All training words are exchanged themselves, in Spark. Tasks count the classes
   before and after each word, the counts of a word meet in a shuffle, and the word
   goes to the class under which its neighbours are likeliest, if that gains more
   than ``STAY`` over the class it has. One part of the words moves at a time
   (by hash) and the next part sees the head words where they went, so that words
   do not swap past each other. As a neighbour, a word beyond the head counts
   under the class it started in.

Transitions are then counted over all training texts with the classes found.
Only a word that no training text holds takes the class of its last letters. A
text's probability is the product, over its words and its end, of a class
transition and a word emission, mixed with the plain word probability:

    P(w | v) = (c(w) + A) * (MIX * T(class(v), class(w)) / D(class(w)) + (1 - MIX) / D)

with c the count in training, D = N + A * (V + 1) over all tokens, and D(k) the
same over the tokens of class k. Both parts spread A over every word and one
unseen word. Since both hold c(w) + A, counts are needed only as a sum over the
words of a text.

Words, their counts and classes stay distributed and grow with the corpus. The
driver holds the units' neighbour counts (``UNITS`` squared numbers) and the
classes' transitions, and the tasks hold counts and classes of the ``HEAD`` most
frequent words; all other words of a text meet theirs in a shuffle join, where
by construction no word is frequent in training. A task counts in tables of
bounded size.

Null texts read as empty: one token, the end. Lower case changes A-Z only.
Rows without a key fold like empty text. Repeated rows are counted and scored
each. With nothing to learn from, every token has the probability 1 of the base
formula, and the model gives the same. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellgauge.llm.common import fold, in_small_batches, text_or_empty, worker_keeps
from shellgauge.session import scratch

FOLDS, HELD_OUT = 10, 0
#: Count added to every word.
ADDED = 0.1
#: Words whose counts every task holds, at most.
HEAD = 120_000
#: Frequent words that are units of their own, at most; groups of the other words; classes beside the end's.
FREQUENT, GROUPS, CLASSES = 700, 323, 24
UNITS = 1 + FREQUENT + GROUPS
#: Rounds of exchange, at most.
ROUNDS = 12
#: Weight of the class model in the mixture, and count added to every transition.
MIX, TRANSITION = 0.95, 0.5
#: Parts of the words that are exchanged in turn, and what a word's neighbours must gain (natural log) for it to move.
PARTS, STAY = 2, 4.0
#: Marks a word whose class is not known in the task; classes are fewer.
UNKNOWN = 255
#: Distinct words a task counts before it hands them on, and tokens it looks at once.
FLUSH, TOKENS = 400_000, 1 << 19
#: Fixed value: the end of a text is the empty word, unit 0 and class 0.
END = b""


def tokens(text: str) -> list[bytes]:
    """Lowered words: bytes are lowered in A-Z and split at ASCII white space only."""
    return text.encode("utf-8").lower().split()


def group_of(word: bytes) -> int:
    """The unit of a word that is not frequent, by its last three bytes."""
    return 1 + FREQUENT + crc32(word[-3:]) % GROUPS


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` and ``c`` over all texts of column ``t``, their ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(tokens(t))
                if len(counts) > FLUSH:
                    yield rows()
                    counts.clear()
            counts[END] += batch.num_rows
        if counts:
            yield rows()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counted: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above a count chosen so that they are at most ``most``, most frequent first."""
    # counts are compared in steps of a 64th of a power of two, so this is a bounded table
    step = F.floor(F.log2("c") * 64).alias("step")
    steps = sorted(((r["step"], r["count"]) for r in counted.groupBy(step).count().collect()), reverse=True)
    taken, least = 0, None
    for s, n in steps:
        if (taken := taken + n) > most:
            break
        least = s
    if least is None:
        return []
    rows = counted.filter(F.floor(F.log2("c") * 64) >= least).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def neighbour_counts(texts: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """How often each unit follows each, over all texts of column ``t``; the end stands before the first word."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = {w: i + 1 for i, w in enumerate(sent.value)}
        total = np.zeros(UNITS * UNITS, dtype=np.int64)

        def add(sequence: list[int]) -> None:
            s = np.array(sequence, dtype=np.int64)
            pairs, n = np.unique(s[:-1] * UNITS + s[1:], return_counts=True)
            total[pairs] += n

        for batch in batches:
            sequence = [0]
            for t in batch.column(0).to_pylist():
                sequence += [unit.get(w) or group_of(w) for w in tokens(t)]
                sequence.append(0)
                if len(sequence) > TOKENS:
                    add(sequence)
                    sequence = [0]
            if len(sequence) > 1:
                add(sequence)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    out = np.zeros(UNITS * UNITS)
    summed = texts.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out[summed["pair"].to_numpy(np.int64)] = summed["n"].to_numpy(np.float64)
    return out.reshape(UNITS, UNITS)


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit; unit 0 stays alone in class 0.

    The likelihood of the class bigrams, up to a constant, is the sum of x log x
    over their counts less the same sums over the classes' totals on either side.
    """
    weight = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-weight, kind="stable")
    order = order[(order != 0) & (weight[order] > 0)]
    of = np.zeros(len(pairs), dtype=np.int64)
    others = np.arange(1, len(pairs))
    of[others] = 1 + others % classes
    of[order] = 1 + np.arange(len(order)) % classes
    k = classes + 1
    member = np.zeros((len(pairs), k))
    member[np.arange(len(pairs)), of] = 1
    joint = member.T @ pairs @ member
    after, before = pairs @ member, pairs.T @ member

    def x_log_x(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(rounds):
        moves = 0
        for u in order:
            old, own = of[u], pairs[u, u]
            right, left = after[u].copy(), before[u].copy()
            right[old] -= own
            left[old] -= own
            joint[old, :] -= right
            joint[:, old] -= left
            joint[old, old] -= own
            rows, columns = joint.sum(1), joint.sum(0)
            corner = joint.diagonal()
            both = x_log_x(corner + right + left + own) - x_log_x(corner)
            gain = (x_log_x(joint + right) - x_log_x(joint)).sum(1) - (x_log_x(corner + right) - x_log_x(corner))
            gain += (x_log_x(joint.T + left) - x_log_x(joint.T)).sum(1) - (x_log_x(corner + left) - x_log_x(corner)) + both
            out, into = right.sum() + own, left.sum() + own
            gain -= x_log_x(rows + out) - x_log_x(rows) + x_log_x(columns + into) - x_log_x(columns)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            joint[new, :] += right
            joint[:, new] += left
            joint[new, new] += own
            if new != old:
                moves += 1
                of[u] = new
                after[:, old] -= pairs[:, u]
                after[:, new] += pairs[:, u]
                before[:, old] -= pairs[u]
                before[:, new] += pairs[u]
        if not moves:
            break
    return of


@dataclass(frozen=True)
class Head:
    """The most frequent words, the end last, with the logs of their counts; they are known in every task."""

    words: list[bytes]
    logs: np.ndarray


@dataclass(frozen=True)
class Classes:
    """The classes of the head's words, and of all others by the group of their last letters."""

    of_head: np.ndarray
    of_group: np.ndarray


def _lookup(head: Head) -> dict[bytes, int]:
    """The head words' numbers, built once for a worker and head."""
    kept = worker_keeps(("class_lm",), dict)
    if kept.get("head") is not head:
        kept["head"], kept["index"] = head, {w: i for i, w in enumerate(head.words)}
    return kept["index"]


def contexts(texts: DataFrame, head: Head, classes: Classes, part: int) -> DataFrame:
    """For words of one part: how often each class follows (``codes`` below the number of classes) and precedes them.

    A word has a row for each task and table that holds it.
    """
    context = texts.sparkSession.sparkContext
    sent, placed = context.broadcast(head), context.broadcast(classes)
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = sent.value, placed.value
        index, h = _lookup(own), len(own.words)
        moves_head = np.fromiter((crc32(w) % PARTS == part for w in own.words), dtype=bool, count=h)
        moves_head[-1] = False
        tail: dict[bytes, int] = {}
        tail_classes: list[int] = []
        tail_moves: list[bool] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []

        def add(sequence: list[bytes]) -> None:
            ids = np.fromiter((index.get(w, -1) for w in sequence), dtype=np.int64, count=len(sequence))
            for i in np.flatnonzero(ids < 0).tolist():
                w = sequence[i]
                j = tail.get(w)
                if j is None:
                    j = tail[w] = len(tail)
                    tail_classes.append(now.of_group[crc32(w[-3:]) % GROUPS])
                    tail_moves.append(crc32(w) % PARTS == part)
                ids[i] = h + j
            of = np.append(now.of_head, np.array(tail_classes, dtype=np.int64))[ids]
            at = np.flatnonzero(np.append(moves_head, np.array(tail_moves, dtype=bool))[ids])
            base = ids[at] * (2 * k)
            counted.append(np.unique(np.concatenate([base + of[at + 1], base + k + of[at - 1]]), return_counts=True))

        def rows() -> Iterator[pa.RecordBatch]:
            keys, at = np.unique(np.concatenate([x for x, _ in counted]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x for _, x in counted]), minlength=len(keys)).astype(np.int64)
            ids, codes = keys // (2 * k), keys % (2 * k)
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            names, offsets = [*own.words, *tail], np.append(starts, len(ids)).astype(np.int32)
            words = pa.array([names[i] for i in ids[starts].tolist()], pa.binary())
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (codes.astype(np.int16), n)]
            whole = pa.RecordBatch.from_arrays([words, *lists], ["word", "codes", "ns"])
            for i in range(0, whole.num_rows, 10_000):
                yield whole.slice(i, 10_000)
            for x in (tail, tail_classes, tail_moves, counted):
                x.clear()

        sequence = [END]
        for batch in batches:
            for t in batch.column(0).to_pylist():
                sequence += tokens(t)
                sequence.append(END)
                if len(sequence) > TOKENS:
                    add(sequence)
                    sequence = [END]
                    if len(tail) > FLUSH or sum(len(x) for x, _ in counted) > 8 * FLUSH:
                        yield from rows()
        if len(sequence) > 1:
            add(sequence)
        if counted:
            yield from rows()

    return texts.mapInArrow(run, "word binary, codes array<short>, ns array<long>")


def gains(joint: np.ndarray) -> np.ndarray:
    """The log-likelihood that one neighbour (row: a code of ``contexts``) adds under each class (column)."""
    smooth = joint + TRANSITION
    ratio = np.log(smooth / (smooth.sum(1, keepdims=True) * smooth.sum(0, keepdims=True)))
    return np.vstack([ratio.T, ratio])


def reassign(vectors: np.ndarray, now: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word, by its neighbours' counts, its class so far and ``gains``; ties go to the lowest class."""
    value = vectors @ table
    value[:, 0] = -np.inf
    value[np.arange(len(now)), now] += STAY
    return value.argmax(1)


def exchange_words(texts: DataFrame, head: Head, classes: Classes, joint: np.ndarray) -> tuple[DataFrame, Classes]:
    """``word``, ``c`` and class ``k`` of every training word, and the classes of the head."""
    spark = texts.sparkSession
    context = spark.sparkContext
    table, width, sent = gains(joint), 2 * (CLASSES + 1), context.broadcast(head)
    at = scratch(spark, "classes")

    for part in range(PARTS):
        placed = context.broadcast(classes)

        def run(batches: Iterator[pa.RecordBatch], placed=placed) -> Iterator[pa.RecordBatch]:
            index, before = _lookup(sent.value), placed.value

            def rows(words: list[bytes], vectors: np.ndarray) -> pa.RecordBatch:
                at_head = np.fromiter((index.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                now = np.fromiter((before.of_group[crc32(w[-3:]) % GROUPS] for w in words), dtype=np.int64, count=len(words))
                now[at_head >= 0] = before.of_head[at_head[at_head >= 0]]
                k = reassign(vectors, now, table)
                c = vectors[:, : CLASSES + 1].sum(1)
                columns = [pa.array(words, pa.binary()), pa.array(c.astype(np.int64)), pa.array(k.astype(np.int16)), pa.array(at_head.astype(np.int32))]
                return pa.RecordBatch.from_arrays(columns, ["word", "c", "k", "head"])

            # rows come sorted by word, so only the last word of a batch can go on in the next
            word, open_vector = None, np.zeros(width)
            for batch in batches:
                if not batch.num_rows:
                    continue
                coded = batch.column(0).dictionary_encode()
                words, lists = coded.dictionary.to_pylist(), batch.column(1)
                of_row = np.repeat(coded.indices.to_numpy(), lists.value_lengths().to_numpy())
                cells = of_row.astype(np.int64) * width + lists.flatten().to_numpy()
                vectors = np.bincount(cells, batch.column(2).flatten().to_numpy(), len(words) * width).reshape(-1, width)
                if words[0] == word:
                    vectors[0] += open_vector
                elif word is not None:
                    yield rows([word], open_vector[None, :])
                word, open_vector = words[-1], vectors[-1].copy()
                if len(words) > 1:
                    yield rows(words[:-1], vectors[:-1])
            if word is not None:
                yield rows([word], open_vector[None, :])

        met = contexts(texts, head, classes, part).repartition("word").sortWithinPartitions("word")
        met.mapInArrow(run, "word binary, c long, k short, head int").write.parquet(f"{at}/part={part}")
        moved = spark.read.parquet(f"{at}/part={part}").filter("head >= 0").select("head", "k").toPandas()
        of_head = classes.of_head.copy()
        of_head[moved["head"].to_numpy(np.int64)] = moved["k"].to_numpy(np.int64)
        classes = Classes(of_head, classes.of_group)
    learned = spark.read.schema("word binary, c long, k short, head int").parquet(*[f"{at}/part={p}" for p in range(PARTS)])
    return learned.select("word", "c", "k"), classes


def learn_classes(counted: DataFrame, texts: DataFrame) -> tuple[Head, Classes, DataFrame]:
    """Head, classes, and the table of all training words' counts and classes, from word counts and training texts (column ``t``)."""
    most = [x for x in most_frequent(counted, HEAD) if x[0] != END]
    ends = counted.filter(F.length("word") == 0).agg(F.max("c").alias("c")).first()["c"] or 0
    # the end is the last of the head
    head = Head([*(w for w, _ in most), END], np.log10(np.array([*(c for _, c in most), ends], dtype=np.float64) + ADDED))
    frequent = head.words[:-1][:FREQUENT]
    pairs = neighbour_counts(texts, frequent)
    of_unit = exchange(pairs)
    unit = {w: i + 1 for i, w in enumerate(frequent)}
    of_head = np.array([of_unit[unit.get(w) or group_of(w)] for w in head.words[:-1]] + [0], dtype=np.int64)
    member = np.zeros((UNITS, CLASSES + 1))
    member[np.arange(UNITS), of_unit] = 1
    learned, classes = exchange_words(texts, head, Classes(of_head, of_unit[1 + FREQUENT :]), member.T @ pairs @ member)
    return head, classes, learned


def class_sequences(source: DataFrame, head: Head, classes: Classes, learned: DataFrame, ends_known: bool) -> DataFrame:
    """``key``, ``n_tokens``, ``known``, ``logs`` (of counts) and ``seq``, a byte for each token's class, of rows with ``key`` and ``t``.

    ``seq`` stands between two ends. What meets in a group by ``row`` are the distinct rare words of one text.
    """
    spark = source.sparkSession
    sent, placed = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast(classes)
    kind = source.schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = sent.value, placed.value
        index = _lookup(own)
        row, last = TaskContext.get().partitionId() << 40, len(own.words) - 1
        names = ["row", "key", "n_tokens", "known", "logs", "seq", "spots", "tail", "times", "ending"]
        types = [pa.int64(), None, pa.int64(), pa.int64(), pa.float64(), pa.binary(), *(pa.list_(x) for x in (pa.int32(), pa.binary(), pa.int64(), pa.int16()))]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for t in batch.column(1).to_pylist():
                found = tokens(t)
                at = np.fromiter((index.get(w, -1) for w in found), dtype=np.int64, count=len(found))
                away = np.flatnonzero(at < 0)
                seq = np.zeros(len(found) + 2, dtype=np.uint8)
                seq[1:-1] = now.of_head[at]
                seq[away + 1] = UNKNOWN
                tail: dict[bytes, int] = {}
                spots = [tail.setdefault(found[i], len(tail)) for i in away.tolist()]
                ending = [int(now.of_group[crc32(w[-3:]) % GROUPS]) for w in tail]
                logs = float(own.logs[at[at >= 0]].sum()) + float(own.logs[last])
                times = np.bincount(np.array(spots, dtype=np.int64), minlength=len(tail)).tolist()
                values = (len(found) + 1, len(found) - len(away) + ends_known, logs, seq.tobytes(), spots, list(tail), times, ending)
                for column, value in zip(columns[2:], values):
                    column.append(value)
            columns[0] = list(range(row, row + batch.num_rows))
            row += batch.num_rows
            arrays = [batch.column(0) if i == 1 else pa.array(columns[i], types[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = []
            for seq, spots, found in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6))):
                if spots:
                    whole = np.frombuffer(seq, dtype=np.uint8).copy()
                    whole[whole == UNKNOWN] = np.array(found, dtype=np.uint8)[spots]
                    seq = whole.tobytes()
                filled.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(filled, pa.binary())], ["key", "n_tokens", "known", "logs", "seq"])

    parts_at, whole_at = scratch(spark, "scores"), scratch(spark, "sequences")
    fields = f"row long, key {kind}, n_tokens long, known long, logs double, seq binary, spots array<int>, tail array<binary>, times array<long>, ending array<short>"
    source.mapInArrow(read, fields).write.parquet(parts_at)
    parts = spark.read.parquet(parts_at)
    rare = parts.select("row", F.posexplode(F.arrays_zip("tail", "times", "ending")).alias("pos", "x"))
    rare = rare.select("row", "pos", F.col("x.tail").alias("word"), F.col("x.times").alias("times"), F.col("x.ending").alias("ending"))
    c = F.coalesce("c", F.lit(0))
    summed = rare.join(learned, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + ADDED)).alias("rare_logs"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("k", "ending").alias("k")))).alias("found"),
    )
    whole = parts.drop("tail", "times", "ending").join(summed, "row", "left").select(
        "key",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("known"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))).alias("logs"),
        "seq",
        "spots",
        F.col("found.k").alias("found"),
    )
    whole.mapInArrow(fill, f"key {kind}, n_tokens long, known long, logs double, seq binary").write.parquet(whole_at)
    return spark.read.parquet(whole_at)


def _pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class pairs of a batch of sequences, as first times classes plus second; where each row starts; and whether a pair lies within a row."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8).astype(np.int64)
    starts = np.cumsum([0, *map(len, rows)])
    within = np.ones(len(flat), dtype=bool)
    within[starts[1:] - 1] = False
    return np.append(flat[:-1] * (CLASSES + 1) + flat[1:], 0), starts[:-1], within


def transitions(sequences: DataFrame) -> np.ndarray:
    """How often each class follows each over all sequences."""
    cells = (CLASSES + 1) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                pairs, _, within = _pairs_of(batch.column(0))
                total += np.bincount(pairs[within], minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    out = np.zeros(cells)
    for r in sequences.select("seq").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(CLASSES + 1, CLASSES + 1)


def pair_terms(joint: np.ndarray, learned: DataFrame, ends: int, n: int, v: int) -> np.ndarray:
    """The log10 factor of each class pair that stands beside the log of a word's count."""
    if not n:
        return np.full_like(joint, -np.log10(ADDED))
    size, distinct = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    size[0], distinct[0] = ends, 1
    for r in learned.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        size[r["k"]], distinct[r["k"]] = r["c"], r["v"]
    transition = (joint + TRANSITION) / (joint.sum(1, keepdims=True) + TRANSITION * (CLASSES + 1))
    spread = size + ADDED * (distinct + 1)
    return np.log10(MIX * transition / spread + (1 - MIX) / (n + ADDED * (v + 1)))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    spark = docs.sparkSession
    source = in_small_batches(docs).select(F.col(key).alias("key"), text_or_empty(text).alias("t"))
    train = source.filter(fold(F.col("key"), FOLDS) != HELD_OUT).select("t")
    counts_at = scratch(spark, "words")
    count_words(train).write.parquet(counts_at)
    counted = spark.read.parquet(counts_at)
    totals = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    n, v = totals["n"] or 0, totals["v"]
    head, classes, learned = learn_classes(counted, train)
    sequences = class_sequences(source, head, classes, learned, bool(n))
    joint = transitions(sequences.filter(fold(F.col("key"), FOLDS) != HELD_OUT))
    sent = spark.sparkContext.broadcast(pair_terms(joint, learned, totals["ends"] or 0, n, v).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        for batch in batches:
            if batch.num_rows:
                pairs, starts, within = _pairs_of(batch.column(4))
                summed = np.add.reduceat(np.where(within, terms[pairs], 0.0), starts)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(summed)], ["key", "n_tokens", "known", "logs", "terms"])

    kind = source.schema[0].dataType.simpleString()
    scored = sequences.mapInArrow(run, f"key {kind}, n_tokens long, known long, logs double, terms double")
    return scored.select(
        F.col("key").alias(key),
        (fold(F.col("key"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + ADDED * (v + 1)))).alias("base_score"),
        (F.col("logs") + F.col("terms")).alias("score"),
    )
