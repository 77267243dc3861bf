"""Matching a bank of rules that comes as a table, through an inverted index of q-grams.

Every match of a rule contains the grams (a few characters, folded, blanks as one
space) of the plain runs of its pattern. The rule is posted under that of its grams which
the fewest texts hold; grams that begin with a space and reach into the next word come first,
as texts have few of them. Texts meet postings in an equi-join on their distinct grams, so a text is
only compared with rules whose rarest gram it holds, and a pair of them arises once; the
rule's longest run must then lie in the text, and the pattern decides. Rules without a gram
are expressions tested on every text, after the literals their matches need; so are
rules with other grams, while they are few.

A small index is broadcast and texts stay where they are. A larger one is joined
by shuffle: only keys, grams and rule numbers move, and texts meet their pairs after.

Null texts match nothing. Empty patterns match every text. Rules repeat if they
are repeated in the bank with another ``ord``. A pattern that is not valid ends the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.functions.text import let
from shellgauge.operators.patterns import FLAGS, needed_literals, required_runs, spaced
from shellgauge.session import MAX_BROADCAST_ROWS

#: Lengths of grams: a rule is posted under long ones where it has a run for them, as few texts hold them.
LONG, GRAM = 6, 3
#: Lengths of grams that begin with a space; there is one of each per word.
PHRASES = (8, 5)
#: Searching a text for one literal costs so much less than taking its grams that so many rules need none.
MAX_PLAIN = 300
#: Rules without a gram that are made one expression, and how many there may be: each is tested on every text.
LOOSE_AT_ONCE, MAX_LOOSE = 100, 5_000


def grams_of(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of a text as ``spaced`` gives it, of these lengths."""
    gram = lambda n: rf" [\x00-\x7F]{{{n - 1}}}" if n in PHRASES else rf"[\x00-\x7F]{{{n}}}"
    return let(text, lambda t: F.concat(
        F.array().cast("array<string>"),
        *[F.array_distinct(F.regexp_extract_all(t, F.lit(rf"(?s)(?=({gram(n)}))"), F.lit(1))) for n in sizes]))


def sizes_of(grams: DataFrame) -> list[int]:
    """The lengths that occur: no more than there are kinds of grams."""
    return sorted(r["n"] for r in grams.filter("gram is not null").select(F.length("gram").alias("n")).distinct().collect())


def _grams(runs: list[str], phrases: tuple[int, ...] = ()) -> set[str]:
    """The grams of runs, of the first kind that they have."""
    for n in phrases:
        if found := {r[i : i + n] for r in runs for i in range(len(r) - n + 1) if r[i] == " "}:
            return found
    cut = lambda n: {r[i : i + n] for r in runs for i in range(len(r) - n + 1)}
    return cut(LONG) or cut(GRAM)


def required_grams(rules: DataFrame, pattern: str = "pattern_regex", joined: bool = False) -> DataFrame:
    """``ord``, ``gram`` and ``run``: one row for each gram that all matches of a rule hold; a rule without one has a NULL.

    ``run`` is the longest literal of all matches. With ``joined``, runs reach over blanks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                alone = [x[0] for x in needed_literals(text) if len(x) == 1]
                plain = [re.sub("[\t\n\x0b\x0c\r ]+", " ", r) for r in required_runs(text)]
                grams = _grams(alone, PHRASES) if joined and alone else _grams(plain)
                out += [(number, g, max(alone, key=len, default="")) for g in sorted(grams) or [None]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
                (pa.int64(), pa.string(), pa.string()))], ["ord", "gram", "run"])

    return rules.select(F.col("ord").cast("long"), F.coalesce(pattern, F.lit(""))).mapInArrow(run, "ord long, gram string, run string")


def postings(required: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """``ord`` and ``gram``: each rule under its gram that the fewest texts hold; ties by gram."""
    known = required.filter("gram is not null").select("gram").distinct()
    small = known.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    held = texts.select(F.explode(grams_of(spaced(F.col(text)), sizes_of(known))).alias("gram"))
    counted = held.join(F.broadcast(known) if small else known, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rated = required.filter("gram is not null").join(counted, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("low")
    return rated.groupBy("ord").agg(rarest).select("ord", F.col("low.gram").alias("gram"))


def matches(text: Column, pattern: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(FLAGS), pattern))


def fired(rules: list[tuple[int, str]], text: Column, key: Column) -> Column:
    """The numbers of the rules that match a text; ``key`` is the text as ``spaced`` gives it."""

    def fires(t: Column, k: Column, pattern: str) -> Column:
        matched = t.rlike(FLAGS + pattern)
        for among in sorted(needed_literals(pattern), key=lambda x: (-min(map(len, x)), len(x)))[:2]:
            matched = reduce(or_, [k.contains(x) for x in among]) & matched
        return matched

    return let(text, lambda t: let(key, lambda k: F.array_compact(F.array(*[F.when(fires(t, k, p), F.lit(n).cast("long")) for n, p in rules]))))


def match_bank(texts: DataFrame, rules: DataFrame, key: str, text: str = "text", pattern: str = "pattern_regex") -> DataFrame:
    """``key`` and ``ord`` of every text and rule that match; keys are unique, rules have ``ord`` and a pattern."""
    bank = rules.select(F.col("ord").cast("long").alias("ord"), F.coalesce(pattern, F.lit("")).alias("__pattern"))
    # extracted once: several joins read it
    grams = required_grams(rules, pattern, joined=True).persist()
    whole = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text"), spaced(F.col(text)).alias("__spaced"))
    none, phrase = F.col("gram").isNull(), F.length("gram").isin(*PHRASES)
    others = grams.filter(~none & ~phrase).select("ord").distinct()
    few = others.limit(MAX_PLAIN + 1).count() <= MAX_PLAIN
    tested = none | ~phrase if few else none
    required = grams.filter(~tested)
    posted = postings(required, texts.select(F.col(text).alias("__text")), "__text").join(
        required.select("ord", "run").distinct(), "ord").join(bank, "ord")
    held = F.explode(grams_of(F.col("__spaced"), sizes_of(required))).alias("gram")
    if bank.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        met = whole.select("__key", "__text", "__spaced", held).join(F.broadcast(posted), "gram")
    else:
        pairs = whole.select("__key", held).join(posted.select("gram", "ord", "run"), "gram").drop("gram")
        met = pairs.join(whole, "__key").join(bank, "ord")
    found = met.filter(F.when(F.contains("__spaced", "run"), matches(F.col("__text"), F.col("__pattern")))).select(F.col("__key").alias(key), "ord")
    loose = grams.filter(tested).select("ord").distinct().join(bank, "ord").limit(MAX_LOOSE + 1).collect()
    grams.unpersist()
    if len(loose) > MAX_LOOSE:
        raise ValueError(f"more than {MAX_LOOSE} rules have no run of {GRAM} plain characters")
    # all parts in one reading of the texts
    numbers = [fired([(r["ord"], r["__pattern"]) for r in loose[at : at + LOOSE_AT_ONCE]], F.col("__text"), F.col("__spaced"))
               for at in range(0, len(loose), LOOSE_AT_ONCE)]
    return found.unionByName(whole.select(F.col("__key").alias(key), F.explode(F.concat(*numbers)).alias("ord"))) if numbers else found
