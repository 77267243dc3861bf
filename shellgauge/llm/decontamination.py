"""Benchmark decontamination by templates.

Texts become templates: words are lowered, and numbers, units and names (words with one capital, inside a sentence) become typed
placeholders that remember their value.
Windows of eight tokens of a document meet windows of benchmark items in an
equi-join on their template's hash. Slots are judged window by window: no two
values of the item may stand for the same value of the document in one window.
The matches of one document and one item that stand at the same distance are one
reading of the item, and names must also agree over all of it: windows with a
name of the document that stands for two names of the item do not count. A window
whose values all equal the item's always counts, whatever stands around it. A value
of the item that is repeated may take different values. A document is
contaminated by an item when enough of the item's windows count, each once, so a
question with other numbers, names or units is caught, and windows without slots
always count.

A window is read in up to three ways, of which only those that differ are kept:
with its names and units as placeholders, the same where the end of a line ends a
sentence too, and with all words in lower case as they are. The last finds copies
whose capitals or lines have changed.

Document windows are tested against a bitmap of the items' hashes, of fixed
size, before they leave the task; what passes is joined exactly. Item windows
are broadcast after a check of their size and joined by shuffle beyond it.

Null texts have no windows and are never contaminated. Items shorter than a
window are matched by one window of their own length; items of less than
``LEAST_WORDS`` plain words match nothing. Repeated rows and repeated items each
give their rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shellgauge.functions.text import let
from shellgauge.llm.common import in_small_batches, text_or_empty, worker_keeps
from shellgauge.session import scratch, small

WINDOW = 8
#: Plain words a window must hold; windows of placeholders say nothing.
LEAST_WORDS = 4
#: Windows of an item that make a reading: this many (thirteen tokens in a row), or this share of a short item.
ENOUGH, SHARE = 6, 0.5
#: Bits of the bitmap, as a power of two.
BITMAP = 24
#: Tokens that are worked on at once, chunks a worker remembers, and dropped rows that are broadcast.
TOKENS, CACHE_CHUNKS, MAX_DROPPED = 1 << 18, 200_000, 200_000

#: Units of measure and money.
UNITS = set(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons ms s sec min h hr second seconds minute minutes hour hours "
    "day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents "
    "mph kmh kph hz khz mhz ghz w kw mw v kv j kj kwh pa kpa bar k c f degrees % $ € £ °".split()
)
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£°]")
SENTENCE_END = re.compile(r"[.!?:]['\")\]]*$")
LITERAL, NUMBER, UNIT, CAPITAL = range(4)
_PLACE = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], dtype=np.uint64)
_PRIME = np.uint64(0x100000001B3)


class Tokens(dict):
    """Chunks as packed token numbers; the tokens' kinds, values and sentence ends in tables."""

    def __init__(self) -> None:
        super().__init__()
        self.kind: list[int] = []
        self.value: list[int] = []
        self.ends: list[bool] = []
        self.known = (np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool))

    def __missing__(self, chunk: str) -> bytes:
        found = TOKEN.findall(chunk)
        start = len(self.kind)
        for token in found:
            low = token.lower()
            self.kind.append(
                NUMBER if token[0].isdigit() else UNIT if low in UNITS and (len(found) > 1 or token == low) else CAPITAL if token[0].isupper() and token[1:].islower() else LITERAL
            )
            self.value.append(xxhash.xxh64_intdigest(low))
            self.ends.append(False)
        if found and SENTENCE_END.search(chunk):
            self.ends[-1] = True
        got = self[chunk] = np.arange(start, len(self.kind), dtype=np.int32).tobytes()
        return got

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, values and sentence ends as arrays, of which only the new part is converted."""
        n = len(self.known[0])
        if n < len(self.kind):
            self.known = tuple(np.concatenate([old, np.array(new[n:], dtype=old.dtype)]) for old, new in zip(self.known, (self.kind, self.value, self.ends)))
        return self.known

    def trim(self) -> None:
        if len(self) > CACHE_CHUNKS:
            self.__init__()
            self.clear()


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def templates(tokens: Tokens, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens, one after another: their codes in each way of reading, slot values, all values, and where each text ends.

    Slots are those of the first way. The lowest bit is set in slot values of names, and nowhere else.
    """
    lines = [[b"".join(map(tokens.__getitem__, line.split())) for line in t.splitlines()] for t in texts]
    ends = np.cumsum([sum(map(len, parts)) // 4 for parts in lines])
    line_ends = np.cumsum([len(p) // 4 for parts in lines for p in parts], dtype=np.int64)
    at = np.frombuffer(b"".join(chain.from_iterable(lines)), dtype=np.int32)
    kind, value, sentence_ends = (t[at] for t in tokens.tables())
    starts = np.concatenate([[True], sentence_ends[:-1]]) if len(at) else np.zeros(0, dtype=bool)
    starts[ends[:-1][ends[:-1] < len(at)]] = True
    line_starts = starts.copy()
    line_starts[line_ends[line_ends < len(at)]] = True
    capital, plain = kind == CAPITAL, kind == LITERAL
    literal = plain | (capital & starts)
    words = spread(value)
    codes = [np.where(kept, words, _PLACE[kind]) for kept in (literal, plain | (capital & line_starts), kind != NUMBER)]
    values = value & ~np.uint64(1)
    return codes, np.where(literal, np.uint64(0), values | capital), values, ends


def hashed(codes: np.ndarray, at: np.ndarray | None, size: int) -> np.ndarray:
    """Hashes of the windows of a size that start at the given places, or of all."""
    n = len(codes) - size + 1
    h = np.full(n if at is None else len(at), size, dtype=np.uint64)
    for j in range(size):
        h = h * _PRIME + (codes[j : j + n] if at is None else codes[at + j])
    return spread(h)


def held(marks: np.ndarray, size: int) -> np.ndarray:
    """How many marked tokens each window of a size holds."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[size:] - total[:-size]


HIT = "row long, key {key}, text_md5 string, pos int, size int, hash long, slots array<long>"


def windows_of(df: DataFrame, key: str, text: str, sizes: list[int], bitmap: np.ndarray | None) -> DataFrame:
    """Windows of the texts, those the bitmap passes where one is given.

    Without a bitmap (items) a text gives windows of eight tokens, or one of all
    its tokens if it has fewer, that hold enough plain words, and their slots.
    With one (documents) the slots hold the values of all tokens.
    """
    source = in_small_batches(df).select(F.col(key).alias("key"), text_or_empty(text).alias("t"))
    sent = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)
    key_type = source.schema[0].dataType.simpleString()

    def found(tokens: Tokens, texts: list[str]) -> Iterator[tuple[int, int, int, int, list[int]]]:
        """Text number, position, size, hash and slots of the windows that pass."""
        codes, slots, values, ends = templates(tokens, texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for size in sizes:
            if len(slots) < size:
                continue
            for own in codes:
                places = None if own is codes[0] else np.flatnonzero(held(own != codes[0], size))
                h = hashed(own, places, size)
                places = np.arange(len(h)) if places is None else places
                if sent is None:
                    good = held(slots == 0, size)[places] >= LEAST_WORDS
                else:
                    bit = h & np.uint64((1 << BITMAP) - 1)
                    good = (sent.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                at, h = places[good], h[good]
                of = np.searchsorted(ends, at, side="right")
                inside = at + size <= ends[of]
                if sent is None:
                    inside &= ((ends - starts)[of] == size) | (size == WINDOW)
                kept = slots if sent is None else values
                for p, k, x in zip(at[inside].tolist(), of[inside].tolist(), h[inside].view(np.int64).tolist()):
                    yield k, p - int(starts[k]), size, x, kept[p : p + size].view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_keeps(("decontamination",), Tokens)
        row = TaskContext.get().partitionId() << 40
        schema = pa.schema([("row", pa.int64()), ("key", source_type), ("text_md5", pa.string()), ("pos", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.int64()))])
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= 6 * TOKENS):
                    chars += len(texts[b])
                    b += 1
                hits = list(found(tokens, texts[a:b]))
                if hits:
                    digests = {k: hashlib.md5(texts[a + k].encode()).hexdigest() for k in {x[0] for x in hits}}
                    of = pa.array([a + x[0] for x in hits])
                    columns = [pa.array([row + a + x[0] for x in hits], pa.int64()), keys.take(of), pa.array([digests[x[0]] for x in hits])]
                    columns += [pa.array([x[i] for x in hits], schema.field(i + 2).type) for i in (1, 2, 3, 4)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                tokens.trim()
                a = b
            row += len(texts)

    source_type = to_arrow_type(source.schema[0].dataType)
    return source.mapInArrow(run, HIT.format(key=key_type))


def bitmap_of(items: DataFrame) -> np.ndarray:
    """One bit for each hash, as 64-bit words; at most 2**(BITMAP - 6) rows reach the driver."""
    bit = F.col("hash").bitwiseAND(F.lit((1 << BITMAP) - 1))
    word = F.shiftright(bit, 6).cast("int").alias("word")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    out = np.zeros(1 << (BITMAP - 6), dtype=np.uint64)
    for r in items.groupBy(word).agg(F.bit_or(one).alias("bits")).collect():
        out[r["word"]] = np.uint64(r["bits"] & ((1 << 64) - 1))
    return out


def merged(pairs: Column) -> Column:
    """Document values that stand for two values of the item, of distinct pairs."""
    values = F.transform(pairs, lambda p: p["d"])
    twice = F.filter(pairs, lambda p: F.exists(pairs, lambda o: (o["d"] == p["d"]) & (o["i"] != p["i"])))
    alone = F.size(F.array_distinct(values)) == F.size(pairs)
    return F.when(alone, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(twice, lambda p: p["d"])))


def agreeing(found: Column) -> Column:
    """The windows of a reading, as structs of ``item_pos`` and distinct ``slots``, that count."""
    name = lambda p: p["i"].bitwiseAND(F.lit(1)) == 1
    names = F.array_distinct(F.flatten(F.transform(found, lambda w: F.filter(w["slots"], name))))
    unchanged = lambda w: F.forall(w["slots"], lambda p: p["i"].bitwiseAND(F.lit(~1)) == p["d"])
    return let(let(names, merged), lambda confused: F.filter(
        found,
        lambda w: unchanged(w) | ((F.size(merged(w["slots"])) == 0) & ~F.exists(w["slots"], lambda p: name(p) & F.array_contains(confused, p["d"]))),
    ))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document row and item found in it: ``key``, ``text_md5``, ``item_id``, ``matched`` and ``windows`` of the item."""
    spark = docs.sparkSession
    at = scratch(spark, "items")
    every = windows_of(benchmark, item, item_text, list(range(LEAST_WORDS, WINDOW + 1)), None)
    every.withColumnRenamed("row", "item_row").write.parquet(at)
    items = spark.read.parquet(at)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    counts = items.groupBy("item_row").agg(F.count_distinct("pos").alias("windows"))
    known = items.join(counts, "item_row").select(
        "item_row", F.col("key").alias("item"), "windows", F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots")
    )
    hits_at = scratch(spark, "hits")
    windows_of(docs, key, text, sizes, bitmap_of(items)).write.parquet(hits_at)
    matched = spark.read.parquet(hits_at).join(small(known), "hash")
    pairs = F.array_distinct(F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda p: p["i"] != 0))
    readings = (
        matched.groupBy("row", "key", "text_md5", "item_row", "item", "windows", (F.col("pos") - F.col("item_pos")).alias("distance"))
        .agg(F.collect_list(F.struct("item_pos", pairs.alias("slots"))).alias("found"))
    )
    counted = readings.withColumn("item_pos", F.explode(F.transform(agreeing(F.col("found")), lambda w: w["item_pos"])))
    needed = F.least(F.lit(ENOUGH), F.greatest(F.lit(1), F.ceil(F.col("windows") * SHARE)))
    return (
        counted.groupBy("row", "key", "text_md5", "item_row", "item", "windows").agg(F.count_distinct("item_pos").alias("matched"))
        .filter(F.col("matched") >= needed)
        .select(F.col("key").alias(key), "text_md5", F.col("item").alias(item), "matched", "windows")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    spark = docs.sparkSession
    at = scratch(spark, "contaminated")
    contaminated(docs, benchmark, key, text).select(F.col(key).alias("key"), "text_md5").distinct().write.parquet(at)
    found = small(spark.read.parquet(at), MAX_DROPPED)
    packed = docs.select(F.struct("*").alias("__doc")).withColumns(
        {"__key": F.col("__doc")[key], "__md5": F.md5(text_or_empty(F.col("__doc")[text]).cast("binary"))}
    )
    same = F.col("__key").eqNullSafe(F.col("key")) & (F.col("__md5") == F.col("text_md5"))
    return packed.join(found, same, "left_anti").select("__doc.*")
