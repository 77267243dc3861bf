"""Alignment of two tokenizers over the same texts.

A text is encoded by a byte-level vocabulary (A, after a space in front) and by a
piece model (B, which puts that space there itself). Both give the same bytes, cut
in different places. The ends of A's and B's tokens are two ascending lists of
byte offsets, and their common offsets cut the tokens into groups. They are found
by galloping: the shorter list is looked up in the longer. Of every ``STRIDE``-th
offset the place is found from the one before by doubling steps and a binary
search between the last two; the offsets in between are searched in the bracket
of their two neighbours, all at once. The places of the common offsets in both
lists slice the groups, and differences of places are how many tokens of A
and of B cover the same bytes.

Tokens whose bytes end together are linked. Links of a pair of ids are counted
over all texts: first in the task, then by a shuffle. The most frequent pairs
(``HEAD``, with their counts) are then sent to all tasks; the links of all other
pairs meet their counts in a join, where no key is frequent.

A text whose tokens do not spell it out has no tokens, as has a null or an empty
one. Special tokens are plain text. Repeated rows are rows of their own and count
each. Tied pairs are all best. Rows without a key keep it. Empty tables give no
rows. Other columns are ignored, whatever their names. Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellgauge.llm.common import in_small_batches, text_or_empty, worker_keeps
from shellgauge.session import scratch

#: Offsets of the shorter list between two that gallop on their own.
STRIDE = 32
#: Characters that are encoded at once, but for longer texts.
CHARACTERS = 1 << 18
#: Parts of texts whose ids a Python worker keeps, and their characters.
KEPT_PARTS, KEPT_CHARACTERS = 200_000, 1 << 22
#: Where texts are cut into parts: at a space that has other than white space in front. Most have no other spaces.
BOUNDARY, OTHER_SPACE = re.compile(r"(?<=\S) "), re.compile(r"\A |\s ")
#: Fixed value: the pattern of words of a byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts that all engines cut into the same words, whatever their Unicode tables: printable, of long known letters, and short.
PLAIN = re.compile("[\n!-~¡-ɏ]{1,200}")
NONE = np.zeros(0, dtype=np.int64)
#: Pairs whose counts every task holds, at most, and pairs that a task counts before it hands them on.
HEAD, FLUSH = 200_000, 300_000
#: The mark that pieces have for a space, and the form of pieces that are one byte.
SPACE, BYTE_PIECE = "▁", "<0x%02X>"


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, have the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def quick_encoder(vocabulary: dict, to_byte: dict[str, int]) -> tiktoken.Encoding | None:
    """An encoder that merges by rank, where the vocabulary says the same by its merges: ids in their order, plain words.

    A merge's two sides are what its text comes to on its own just before it, and whatever stands around it has not
    touched it by then, so there is no other pair with the same text: merging by text or by pair is the same.
    """
    model, before = vocabulary["model"], vocabulary["pre_tokenizer"] or {}
    single = sorted(i for t, i in model["vocab"].items() if len(t) == 1)
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    same = (
        vocabulary["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        and not any(model.get(name) for name in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        and single == list(range(256)) and all(model["vocab"].get(t) == 256 + k for k, t in enumerate(merged))
    )
    if not same:
        return None
    known = [t for t, i in model["vocab"].items() if i < 256 + len(merged)]
    return tiktoken.Encoding("alignment", pat_str=WORDS, mergeable_ranks={bytes(map(to_byte.get, t)): model["vocab"][t] for t in known}, special_tokens={})


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The place of each offset of ``short`` in ``long``: the first that is not below it. Both ascend."""
    heads = short[::STRIDE].tolist()
    places, values, n, at = [], long.tolist() if len(long) < 4 * len(heads) else long, len(long), 0
    for x in heads:
        step, low = 1, at
        while at < n and values[at] < x:
            low, at = at + 1, at + step
            step *= 2
        high = min(at, n)
        while low < high:
            middle = (low + high) // 2
            if values[middle] < x:
                low = middle + 1
            else:
                high = middle
        at = low
        places.append(low)
    of = np.arange(len(short)) // STRIDE
    bounds = np.append(np.array(places, dtype=np.int64), n)
    low, high = bounds[of], bounds[of + 1]
    while (unsure := low < high).any():
        middle = (low + high) // 2
        below = unsure & (long[np.minimum(middle, n - 1)] < short)
        low = np.where(below, middle + 1, low)
        high = np.where(unsure & ~below, middle, high)
    return low


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and in ``b`` of the offsets that both hold."""
    if len(a) > len(b):
        in_b, in_a = common_ends(b, a)
        return in_a, in_b
    if not len(a):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place = gallop(a, b)
    in_a = np.flatnonzero(b[np.minimum(place, len(b) - 1)] == a)
    return in_a, place[in_a]


@dataclass(frozen=True)
class Aligned:
    """Ids of both sides, and the last token of each group on both."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        """The links, each as one number."""
        return self.a[self.last_a] << 32 | self.b[self.last_b]


class Encoders:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, byte_vocabulary: str, piece_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_vocabulary)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        to_byte = byte_of_character()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if token in special else bytes(to_byte[c] for c in token)
        single = {BYTE_PIECE % b: bytes([b]) for b in range(256)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [single.get(p) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # where no piece holds a space behind another character, nothing is merged across the start of a space, and A never
        # joins a space to what is before it: the parts of a text between such places can be encoded on their own
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.quick = quick_encoder(json.loads(byte_vocabulary), to_byte)
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}
        self.kept_size = 0
        # the ids as text, each before every separator that can follow it
        self.shown = [f"{i}{s}" for ids, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for s in marks for i in range(len(ids))]

    def align(self, texts: list[str]) -> Iterator[Aligned]:
        """Each text's tokens and groups; a text is encoded with its neighbours, up to ``CHARACTERS``."""
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and (size := size + len(texts[stop])) <= CHARACTERS:
                stop += 1
            parts = [self.parts(t) for t in texts[start:stop]]
            self.learn(set().union(*parts))
            for t, own in zip(texts[start:stop], parts):
                yield self.groups(*self.encode(t, own)) if t else self.groups(NONE, NONE)
            start = stop

    def parts(self, text: str) -> list[str]:
        """The parts of a text that can be encoded on their own, each without the space in front; none where that is not known."""
        if not self.apart or not text:
            return []
        return BOUNDARY.split(text) if OTHER_SPACE.search(text) else text.split(" ")

    def learn(self, parts: set[str]) -> None:
        """Keep the ids of these parts of texts, or that a part is not spelled out by its tokens."""
        if len(self.kept) + len(parts) > KEPT_PARTS or self.kept_size > KEPT_CHARACTERS:
            self.kept, self.kept_size = {}, 0
        new = [p for p in parts if p not in self.kept]
        self.kept_size += sum(map(len, new))
        self.kept.update(zip(new, self.encode_whole(new)))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids; short plain texts by an equal encoder that needs less time for each."""
        if self.quick is None:
            return [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        plain, quick = PLAIN.fullmatch, self.quick.encode_ordinary
        ids = [quick(" " + t) if plain(t) else None for t in texts]
        others = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(others, self.a.encode_batch_fast([" " + texts[i] for i in others], add_special_tokens=False)):
            ids[i] = x.ids
        return ids

    def encode_whole(self, texts: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """The ids of both sides as packed integers; None where tokens do not spell a text out."""
        for t, a, b in zip(texts, self.encode_a(texts), self.b.encode(texts, num_threads=1)):
            whole = b" " + t.encode("utf-8")
            same = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            yield (array("i", a).tobytes(), array("i", b).tobytes()) if same else None

    def encode(self, text: str, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text, from those of its parts; as a whole where it has no parts, or one is not spelled out."""
        found = list(map(self.kept.__getitem__, parts))
        if not found or None in found:
            found = list(self.encode_whole([text]))
            if found == [None]:
                return NONE, NONE
        a, b = (np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in zip(*found))
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray) -> Aligned:
        return Aligned(a, b, *common_ends(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])))

    def show(self, x: Aligned) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group."""
        if not len(x.last_a):
            return ""
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        code_a, code_b = x.a.copy(), x.b + 2 * n_a
        code_a[x.last_a] += n_a
        code_b[x.last_b] += n_b
        # a token of A comes after all tokens of the groups before it, one of B also after A's of its own
        group_a = np.searchsorted(x.last_a, np.arange(len(x.a)))
        group_b = np.searchsorted(x.last_b, np.arange(len(x.b)))
        before_b = np.append(0, x.last_b + 1)[group_a]
        out = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        out[np.arange(len(x.a)) + before_b] = code_a
        out[np.arange(len(x.b)) + (x.last_a + 1)[group_b]] = code_b
        return "".join(map(self.shown.__getitem__, out.tolist()))[:-1]


def shared_encoders(spark: SparkSession, byte_vocabulary: str, piece_model: str) -> Callable[[], Encoders]:
    """What gives a task its encoders; a Python worker makes them once."""
    with open(byte_vocabulary, encoding="utf-8") as f:
        a = f.read()
    with open(piece_model, "rb") as f:
        b = f.read()
    owner, sent = ("alignment", hashlib.sha256(a.encode() + b).hexdigest()), spark.sparkContext.broadcast((a, b))
    return lambda: worker_keeps(owner, lambda: Encoders(*sent.value))


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return in_small_batches(docs).select(F.col(key).alias("key"), text_or_empty(text).alias("t"))


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the ids ``a`` and ``b``, and ``groups``: first token and number of tokens of A and of B in each, in order."""
    encoders = shared_encoders(docs.sparkSession, byte_vocabulary, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders()
        for batch in batches:
            a, b, groups = [], [], []
            for x in own.align(batch.column(1).to_pylist()):
                a.append(x.a)
                b.append(x.b)
                first_a, first_b = (np.append(0, last + 1)[: len(last)] for last in (x.last_a, x.last_b))
                groups.append([
                    {"first_a": p, "n_a": q, "first_b": r, "n_b": s}
                    for p, q, r, s in zip(first_a.tolist(), (x.last_a + 1 - first_a).tolist(), first_b.tolist(), (x.last_b + 1 - first_b).tolist())
                ])
            group = pa.struct([("first_a", pa.int32()), ("n_a", pa.int32()), ("first_b", pa.int32()), ("n_b", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), pa.array(groups, pa.list_(group))],
                ["key", "a", "b", "groups"],
            )

    source = _source(docs, key, text)
    kind = source.schema[0].dataType.simpleString()
    found = source.mapInArrow(run, f"key {kind}, a array<int>, b array<int>, groups array<struct<first_a:int,n_a:int,first_b:int,n_b:int>>")
    return found.select(F.col("key").alias(key), "a", "b", "groups")


def linked(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a number), ``key``, sizes, the digest of the groups, and the text's distinct ``pairs`` with their ``times``."""
    encoders = shared_encoders(docs.sparkSession, byte_vocabulary, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, digests, pairs, times = [], [], [], []
            for x in own.align(batch.column(1).to_pylist()):
                sizes.append((len(x.a), len(x.b), len(x.last_a)))
                digests.append(hashlib.sha256(own.show(x).encode()).hexdigest() if len(x.a) else "")
                distinct, counts = np.unique(x.pairs, return_counts=True)
                pairs.append(distinct)
                times.append(counts)
            ends = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
            flat = [pa.array(np.concatenate(part) if part else np.zeros(0), pa.int64()) for part in (pairs, times)]
            measures = [pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), *measures, pa.array(digests, pa.string()),
                 *[pa.ListArray.from_arrays(ends, part) for part in flat]],
                ["row", "key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )
            row += batch.num_rows

    source = _source(docs, key, text)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(
        run, f"row long, key {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    )


def count_pairs(links: DataFrame) -> DataFrame:
    """``pair``, its ``count`` over all texts, and whether it is the ``best`` of its B id; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            distinct, of = np.unique(np.concatenate(pairs), return_inverse=True)
            return distinct, np.bincount(of, np.concatenate(times), len(distinct)).astype(np.int64)

        pairs, times, held = [], [], 0
        for batch in batches:
            for part, k in ((pairs, 0), (times, 1)):
                part.append(batch.column(k).flatten().to_numpy(zero_copy_only=False))
            held += len(pairs[-1])
            if held > FLUSH:
                p, t = summed(pairs, times)
                if 2 * len(p) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(t)], ["pair", "n"])
                    p, t = p[:0], t[:0]
                pairs, times, held = [p], [t], len(p)
        if pairs:
            p, t = summed(pairs, times)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(t)], ["pair", "n"])

    counted = links.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    own_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counted.groupBy(own_b.alias("b")).agg(F.max("count").alias("highest"))
    return counted.withColumn("b", own_b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def frequent_pairs(counted: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs above a count chosen so that they are at most ``most``: ascending, with counts and whether best."""
    # counts in steps of a 64th of a power of two make a bounded table
    step = F.floor(F.log2("count") * 64)
    taken, least = 0, None
    for s, n in sorted(((r["s"], r["count"]) for r in counted.groupBy(step.alias("s")).count().collect()), reverse=True):
        if (taken := taken + n) > most:
            break
        least = s
    rows = counted.filter(step >= least).toPandas().sort_values("pair") if least is not None else None
    if rows is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    return rows["pair"].to_numpy(np.int64), rows["count"].to_numpy(np.int64), rows["best"].to_numpy(bool)


def measure(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row."""
    spark = docs.sparkSession
    links_at, counts_at, sums_at = scratch(spark, "links"), scratch(spark, "pairs"), scratch(spark, "link-sums")
    linked(docs, byte_vocabulary, piece_model, key, text).write.parquet(links_at)
    links = spark.read.parquet(links_at)
    count_pairs(links).write.parquet(counts_at)
    counted = spark.read.parquet(counts_at)
    sent = spark.sparkContext.broadcast(frequent_pairs(counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, best = sent.value
        for batch in batches:
            n, lists = batch.num_rows, batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            pairs, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            of = np.repeat(np.arange(n), sizes)
            at = np.minimum(np.searchsorted(head, pairs), max(len(head) - 1, 0))
            known = head[at] == pairs if len(head) else np.zeros(len(pairs), dtype=bool)
            found, there, t = at[known], of[known], times[known]
            links_best = np.bincount(there, t * best[found], n).astype(np.int64)
            # sums of counts may pass what a double holds exactly
            count_sum = np.zeros(n, dtype=np.int64)
            np.add.at(count_sum, there, t * counts[found])
            rest = ~known
            ends = pa.array(np.append(0, np.cumsum(np.bincount(of[rest], minlength=n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(links_best), pa.array(count_sum),
                 *[pa.ListArray.from_arrays(ends, pa.array(x[rest], pa.int64())) for x in (pairs, times)]],
                ["row", "head_best", "head_sum", "pairs", "times"],
            )

    head = links.select("row", "pairs", "times").mapInArrow(run, "row long, head_best long, head_sum long, pairs array<long>, times array<long>")
    head.write.parquet(sums_at)
    sums = spark.read.parquet(sums_at)
    tail = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    own = tail.join(counted, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("tail_best"), F.sum(F.col("n") * F.col("count")).alias("tail_sum")
    )
    both = links.drop("pairs", "times").join(sums.drop("pairs", "times"), "row").join(own, "row", "left")
    plus = lambda name: F.col(f"head_{name}") + F.coalesce(f"tail_{name}", F.lit(0))
    return both.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        plus("best").alias("n_best"), plus("sum").alias("count_sum"), "groups_sha256",
    )
