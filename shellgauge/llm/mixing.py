"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has a weight. Targets share the words of all rows by weight, but no
target is above ``MOST_REPEATS`` times its source; what is over goes to the
others by weight. A source's target is dealt out as equal blocks of words:

- *Schedule.* All blocks together are cells 0, 1, 2, ..., each source a run of
  them as long as its target, so the cells are the cumulative weights. Slots are
  visited in van der Corput order: slot ``k`` points at the cell whose binary
  digits are those of ``k`` read backwards, and belongs to the source that owns it.
  Any stretch of the mix holds each source in near its share.
- *Ranks.* The rank of a slot among the slots of its source has a closed form (a
  sum over the binary digits of its cell), so no source is ever ranked in one task.
- *Blocks.* The rows of a source, shuffled by the hash of their key, lie behind one
  another on a tape of words, which is repeated until the target is reached; block
  ``r`` of the tape holds words ``r * block_words`` up to the next block. A slot of
  rank ``r`` takes block ``r``. The last block of a source is cut at its target.

Taken words of a source equal its target, rounded. All of it is DataFrame
expressions. Rows are ranked inside buckets of the shuffled order, whose sums are
added up apart; the join of slots and blocks is on source and rank, where no key
holds more than a block of words. Only the table of sources, one row each, is
sorted as a whole.

A null text has no words, and is never taken; so is an empty one. A null source is a
source of its own, last in order, and apart from the empty name. Rows without a
key are shuffled by the hash of their text. Rows that repeat a key stand next to
each other in the shuffled order, each a row of its own. An empty table gives no
rows, and a table without words gives targets of 0. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellgauge.llm.common import text_or_empty, words
from shellgauge.session import scratch

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times, at most.
MOST_REPEATS = 3
#: Words of a block.
BLOCK_WORDS = 1024
#: Rows of a bucket of the shuffled order, about, and cells that one task makes slots of at once.
BUCKET_ROWS, CELLS = 1_000, 50_000


def measured(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    """``key``, ``source``, ``g`` (the source, never NULL), ``size`` in words and ``turn``, the hash that shuffles."""
    by = F.coalesce(F.col(key).cast("string"), text_or_empty(text))
    return docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("g"),
        F.size(words(text_or_empty(text))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), by).cast("binary")).alias("turn"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row a source: ``g``, ``source_size``, ``target``, its words to take (``quota``) and its run of cells.

    Sources are filled in the order of cap per weight. One is capped when its cap
    is below its share of what the capped ones before it leave.
    """
    sized = rows.groupBy("g", "source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(named) - 1) % len(weights)
    weighed = sized.withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), nth))
    cap = F.col("source_size") * most_repeats
    filling = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = weighed.select(
        "*", cap.alias("cap"), F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("filled"), F.sum("weight").over(onward).alias("rest"),
    )
    marked = level.withColumn("capped", F.col("cap") * F.col("rest") <= (F.col("total") - F.col("filled")) * F.col("weight"))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    shared = marked.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left * F.col("weight") / open_weight))
    quota = F.round("target").cast("long")
    owned = shared.withColumn("quota", quota).withColumn("cells", F.ceil(F.col("quota") / block_words).cast("long"))
    upto = F.sum("cells").over(named.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return owned.select(
        "g", "source", "source_size", "target", "quota", "cells",
        (upto - F.col("cells")).alias("first"), F.sum("cells").over(everything).alias("all_cells"),
    )


def points_below(cell: Column, bound: Column, bits: Column) -> Column:
    """How many slots before the one that points at ``cell`` point below ``bound``.

    A slot before it agrees with it down to some digit that is 1 there and 0 here;
    in the cells these are the lower digits, so such slots are one residue class.
    """
    return F.aggregate(
        F.sequence(F.lit(0), bits - 1), F.lit(0).cast("long"),
        lambda n, b: n + F.when(
            F.getbit(cell, b) == 1,
            F.greatest(F.lit(0).cast("long"), F.floor((bound - F.pmod(cell, power(b)) + power(b + 1) - 1) / power(b + 1))),
        ).otherwise(0),
    )


def power(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))


def schedule(sources: DataFrame) -> DataFrame:
    """Every slot: ``position`` in the mix, ``g`` and ``block``, its rank among the slots of its source."""
    chunks = sources.filter("cells > 0").select(
        "g", "first", "cells", "all_cells",
        F.explode(F.sequence("first", F.col("first") + F.col("cells") - 1, F.lit(CELLS).cast("long"))).alias("chunk"),
    ).repartition("g", "chunk")
    last = F.least(F.col("chunk") + CELLS, F.col("first") + F.col("cells")) - 1
    cells = chunks.select("g", "first", "cells", "all_cells", F.explode(F.sequence("chunk", last)).alias("cell"))
    bits = F.greatest(F.length(F.bin(F.col("all_cells") - 1)), F.lit(1))
    below = lambda bound: points_below(F.col("cell"), bound, bits)
    return cells.select(
        below(F.col("all_cells")).alias("position"), "g",
        (below(F.col("first") + F.col("cells")) - below(F.col("first"))).alias("block"),
    )


def tape(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its number and its first word on the tape of its source."""
    buckets = max(1, rows.count() // BUCKET_ROWS)
    # the first 32 bits of the hash, in as many equal ranges; buckets keep its order
    bucket = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * buckets / (1 << 32))
    placed = rows.select("key", "g", "size", "turn", bucket.alias("bucket"))
    sums = placed.groupBy("g", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    before = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "g", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    ).join(sources.select("g", "source", "source_size", "target", "quota"), "g")
    inside = Window.partitionBy("g", "bucket").orderBy("turn", "key", "size")
    ranked = placed.select(
        "g", "bucket", "key", "size", F.row_number().over(inside).alias("n"),
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).alias("at"),
    )
    return ranked.join(offsets, ["g", "bucket"]).select(
        "g", "source", "key", "size", "source_size", "target", "quota",
        (F.col("rows_before") + F.col("n")).alias("number"), (F.col("words_before") + F.col("at")).alias("start"),
    )


def blocks(rows: DataFrame, block_words: int = BLOCK_WORDS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """The pieces of every row that lie in blocks of its source's repeated tape; a row that has none comes once, without a block."""

    def pieces(repeat: Column) -> Column:
        low = repeat * F.col("source_size") + F.col("start")
        high = F.least(low + F.col("size"), F.col("quota"))
        cut = F.transform(F.sequence(F.floor(low / block_words), F.floor((high - 1) / block_words)), lambda b: F.struct(
            b.alias("block"), repeat.alias("repeat"),
            (F.greatest(low, b * block_words) - low).alias("first"), (F.least(high, (b + 1) * block_words) - low).alias("stop"),
        ))
        none = F.array().cast("array<struct<block:long,repeat:long,first:long,stop:long>>")
        return F.when(high > low, cut).otherwise(none)

    turns = F.array(*[F.lit(r).cast("long") for r in range(most_repeats)])
    return rows.select("*", F.explode_outer(F.flatten(F.transform(turns, pieces))).alias("piece")).select("*", "piece.*").drop("piece")


def _pieces(
    docs: DataFrame, weights: tuple[int, ...], key: str, text: str, source: str, seed: str, block_words: int, most_repeats: int,
) -> tuple[DataFrame, DataFrame]:
    """Rows' pieces and the schedule; the words are counted once and the table of sources is made once."""
    spark = docs.sparkSession
    index_at, sources_at = scratch(spark, "mix-rows"), scratch(spark, "mix-sources")
    measured(docs, key, text, source, seed).write.parquet(index_at)
    rows = spark.read.parquet(index_at)
    targets(rows, weights, block_words, most_repeats).write.parquet(sources_at)
    sources = spark.read.parquet(sources_at)
    return blocks(tape(rows, sources), block_words, most_repeats), schedule(sources)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", text: str = "text", source: str = "source",
    seed: str = "mix", block_words: int = BLOCK_WORDS, most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """The mix: ``position`` of the slot, ``source``, ``key``, ``repeat`` (from 0), and the words ``first`` up to ``stop`` of the row's text."""
    pieces, slots = _pieces(docs, weights, key, text, source, seed, block_words, most_repeats)
    return pieces.join(slots, ["g", "block"]).select("position", "source", F.col("key").alias(key), "repeat", "first", "stop")


def taken(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", text: str = "text", source: str = "source",
    seed: str = "mix", block_words: int = BLOCK_WORDS, most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target`` and ``taken`` of every row: the words that the slots of the mix take of it."""
    pieces, slots = _pieces(docs, weights, key, text, source, seed, block_words, most_repeats)
    joined = pieces.join(slots, ["g", "block"], "left")
    own = F.when(F.col("position").isNotNull(), F.col("stop") - F.col("first")).otherwise(0)
    found = joined.groupBy("g", "number", "key", "size", "source_size", "target").agg(F.sum(own).alias("taken"))
    return found.select(F.col("key").alias(key), "size", "source_size", "target", "taken")
