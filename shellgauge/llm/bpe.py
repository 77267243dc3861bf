"""Byte-pair encoding and decoding with a published vocabulary.

A text is cut at white space, each chunk at the vocabulary's word pattern, and
each word is merged on its own: the word holds its part boundaries and, in one
contiguous array, the rank of the pair on either side of each inner boundary.
The smallest rank is found by a scan, its boundary is deleted, and the two
neighbouring ranks are refreshed. Words too long for quadratic scans take the
same merges from a heap.

The vocabulary file is read once on the driver and broadcast (a fixed file of a
few MB, checked); a worker keeps a bounded cache of chunks it has encoded.
Nothing is shuffled.

Null texts read as empty and encode to no ids. Repeated rows and repeated ids
each give their own row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shellgauge.llm.common import in_small_batches, sha256_hex, text_or_empty, worker_keeps

#: A vocabulary file larger than this is refused, since every worker holds it.
MAX_VOCABULARY_BYTES = 64 << 20
#: Chunks a worker remembers, in each of two generations.
CACHE_CHUNKS = 200_000
#: Words of more characters than this take their merges from a heap.
SCAN_CHARS = 64
#: Chunks of more characters than this are not remembered.
CACHE_CHARS = 64

#: Fixed value: one character that stands for the end-of-word mark inside a word.
END = "\ue000"
NO_RANK = 1 << 60
#: Fixed value: the first character past the Latin blocks.
LATIN_END = "\u0250"
#: Unicode white space; str.split() also cuts at these four controls.
CONTROLS = regex.compile("[\x1c-\x1f]")
NOT_SPACE = regex.compile(r"\P{White_Space}+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and patterns of one vocabulary file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model = spec["model"]
        mark = model["end_of_word_suffix"] or ""
        own = lambda s: s[: -len(mark)] + END if mark and s.endswith(mark) else s
        self.suffix = END if mark else ""
        self.ids = {own(token): i for token, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(own(a), own(b)): r for r, (a, b) in enumerate(pairs)}
        # ranks of two single characters, the last of a word with its mark, by their joint text
        self.letter_pairs = {a + b: r for (a, b), r in self.ranks.items() if len(a) == 1 and a != END and len(b.removesuffix(END)) == 1}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.bytes = byte_characters()
        self.library = Tokenizer.from_buffer(content)

    def split_words(self, chunk: str) -> list[str]:
        """The words of a chunk, normalised, as byte characters.

        Beyond Latin letters the classes and compositions depend on the Unicode
        version, so there the tokenizers library normalises and splits.
        """
        if chunk.isascii() and chunk.isprintable():
            return self.word.findall(chunk.lower())
        if max(chunk) < LATIN_END:
            chunk = unicodedata.normalize("NFC", chunk).lower()
            byte = self.bytes
            return ["".join([byte[b] for b in word.encode()]) for word in self.word.findall(chunk)]
        chunk = self.library.normalizer.normalize_str(chunk)
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as byte characters."""
        word += self.suffix
        bounds = [*range(len(word) - len(self.suffix)), len(word)]
        cut = self.scan if len(bounds) <= SCAN_CHARS else self.heap
        bounds = cut(word, bounds)
        return [self.ids[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def scan(self, word: str, bounds: list[int]) -> list[int]:
        rank = self.ranks.get
        # ranks[k] belongs to the inner boundary bounds[k + 1]; at first every part is one character
        pair, last = self.letter_pairs.get, len(bounds) - 3
        ranks = [pair(word[k : k + 2], NO_RANK) for k in range(last)]
        if last >= 0:
            ranks.append(pair(word[last:], NO_RANK))
        while ranks and (least := min(ranks)) < NO_RANK:
            k = ranks.index(least)
            del ranks[k], bounds[k + 1]
            a, b = bounds[k], bounds[k + 1]
            merged = word[a:b]
            if k:
                ranks[k - 1] = rank((word[bounds[k - 1] : a], merged), NO_RANK)
            if k < len(ranks):
                ranks[k] = rank((merged, word[b : bounds[k + 2]]), NO_RANK)
        return bounds

    def heap(self, word: str, bounds: list[int]) -> list[int]:
        """The same merges for long words; parts are linked by their start."""
        rank, after = self.ranks.get, dict(zip(bounds, bounds[1:]))
        before = {b: a for a, b in after.items()}
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int | None) -> None:
            if a is not None and (b := after.get(a)) is not None and (c := after.get(b)) is not None:
                if (r := rank((word[a:b], word[b:c]), NO_RANK)) < NO_RANK:
                    heapq.heappush(queue, (r, a, b, c))

        for a in bounds:
            offer(a)
        while queue:
            _, a, b, c = heapq.heappop(queue)
            if after.get(a) == b and after.get(b) == c:
                after[a], before[c] = c, a
                del after[b], before[b]
                offer(before.get(a))
                offer(a)
        return [0, *(b for _, b in sorted(after.items()))]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space, as packed integers."""
        ids: list[int] = []
        for word in self.split_words(chunk):
            ids += self.encode_word(word)
        return array("i", ids).tobytes()

    def encode(self, text: str, chunks: Cache) -> bytes:
        """Ids of a whole text, as packed integers."""
        if self.special_at is not None and "<" in text and self.special_at.search(text):
            parts = self.special_at.split(text)
            return b"".join(
                np.int32(self.special[p]).tobytes() if k % 2 else self.encode_plain(p, chunks) for k, p in enumerate(parts)
            )
        return self.encode_plain(text, chunks)

    def encode_plain(self, text: str, chunks: Cache) -> bytes:
        parts = NOT_SPACE.findall(text) if CONTROLS.search(text) else text.split()
        return b"".join(map(chunks.__getitem__, parts))


class Cache(dict):
    """Encoded chunks: two bounded generations, the older dropped when the younger is full."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.vocabulary.encode_chunk(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got


def _loaded(content: bytes) -> tuple[Vocabulary, Cache]:
    vocabulary = Vocabulary(content)
    return vocabulary, Cache(vocabulary)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, after a check of its size."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return content


def _shared(spark: SparkSession, path: str) -> Callable[[], tuple[Vocabulary, Cache]]:
    content = read_vocabulary(path)
    owner, sent = ("bpe", len(content), crc32(content)), spark.sparkContext.broadcast(content)
    return lambda: worker_keeps(owner, lambda: _loaded(sent.value))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text, by the vocabulary at ``path``."""
    loaded = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, chunks = loaded()
        for batch in batches:
            packed = [vocabulary.encode(t, chunks) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [key, "ids"])

    source = in_small_batches(df).select(F.col(key), text_or_empty(text).alias("__text"))
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``decoded``: the tokens of the ids, special ones too, joined by a space.

    The vocabulary names no decoder, so tokens keep their byte characters and
    end-of-word marks. NULL ids decode to empty text.
    """
    loaded = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded()
        tokens = pa.array(vocabulary.tokens)
        for batch in batches:
            lists = batch.column(1)
            # one offset more than rows, counted from the slice's own start
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(ends), tokens.take(lists.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pc.binary_join(parts, " ")], [key, "ids", "decoded"])

    source = in_small_batches(df).select(F.col(key), F.col(ids).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest columns of the encoded and decoded texts: one row for every row given."""
    both = decode(encode(df, path, key, text), path, key)
    return both.select(
        F.col(key),
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )
