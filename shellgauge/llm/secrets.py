"""Secret scanning: fixed patterns, and a battery of randomness tests.

Fixed patterns give the base spans of a text. Beside them, every run of 20 or
more key characters is a candidate. Its encoding is inferred from the character
classes it uses, and three tests ask whether it can be ordinary text written in
that alphabet: chi-squared distance from uniform use of the alphabet, runs of
character classes, and serial correlation of the codes, which must not be
regular. The first two are scaled by the length, so short strings need to stand
out more. What ordinary strings look like depends on the encoding, so each has its
own letter agreement and rate of class changes. The p-values are controlled for
false discoveries (Benjamini and Hochberg) within classes of length of each
encoding, from a histogram over the whole corpus.

All of it is Spark expressions in the row of the text. The only shuffle is the
histogram, which is bounded by encodings times length classes times steps of p.

Null texts read as empty and hold no spans. Spans may overlap between kinds;
method spans that overlap base spans are left out. Repeated rows each give a
row; tied p-values are accepted or refused together. Offsets are code points,
ends exclusive. An empty table has no thresholds and no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.functions.text import any_of, let
from shellgauge.llm.common import sha256_hex, text_or_empty, whole_row

#: The patterns of the three base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MARKS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Kinds in the order of ties.
KINDS = ["assign", "access", "hex", "random"]
SPAN = "struct<start:int,stop:int,kind:int>"

LEAST_CANDIDATE = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_CANDIDATE},}}={{0,2}}"
#: Share of false discoveries that is accepted.
RATE = 0.01
#: Least -10 log10 p of an accepted candidate of letters of both cases, as identifiers and paths are: a corpus of
#: few candidates must not accept them. Long runs of capitals and digits, or small letters and digits, are rare in
#: ordinary text, and the false-discovery rate alone decides on them.
WEAKEST = 40
#: Symbols of the encodings that are judged apart, by number; all others (52 to 64 symbols) come last.
ENCODINGS = [16, 32, 36]
MIXED = len(ENCODINGS)
#: Ordinary strings of each encoding, against which a candidate must stand out: the chance that two symbols agree, and
#: that the class changes. Of the 16 symbols, half are taken to be letters as they occur in words (a-f agree with
#: 0.26) and half digits; words and numbers in one case run on for some eight symbols, names of both cases for five.
AGREE, CHANGE = [0.09, 0.065, 0.065, 0.065], [0.2, 0.12, 0.12, 0.2]
#: Serial correlation beyond this many standard errors is regular, not random.
REGULAR = 3.5
#: First length of each length class.
LENGTH_CLASSES = [20, 32, 64, 128]
#: p is kept as whole steps of -10 log10 p, at most this many.
STEPS = 400
REPLACEMENT = "[SECRET]"


def running_sums(values: Column) -> Column:
    """For each value, the sum of all up to it.

    An array that grows by one is copied every time, so it is made in pieces of about the square root of its length.
    """

    def piece(own: Column, before: Column) -> Column:
        empty = F.struct(before.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out"))
        return F.aggregate(own, empty, step, lambda a: a["out"])

    def pieces(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        total = lambda i: F.aggregate(F.slice(v, F.lit(1), i), F.lit(0), lambda a, x: a + x)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(v) - 1, size), lambda i: piece(F.slice(v, i + 1, size), total(i))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(pieces(v)))


MATCH = "array<struct<start:int,stop:int,part:int,own:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, leftmost and apart: start, stop, the length of one group, and the match itself."""
    regex = F.lit(pattern)

    def place(pieces: Column, found: Column, groups: Column) -> Column:
        sizes = F.transform(found, lambda m, k: F.length(F.get(pieces, k)) + F.length(m))
        return let(running_sums(sizes), lambda stops: F.transform(found, lambda m, k: F.struct(
            (F.get(stops, k) - F.length(m)).alias("start"), F.get(stops, k).alias("stop"), F.length(F.get(groups, k)).alias("part"), m.alias("own"),
        )).cast(MATCH))

    return let(
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(MATCH)).otherwise(let(
            F.split(text, pattern, -1),
            lambda pieces: let(F.regexp_extract_all(text, regex, F.lit(group)), lambda groups: place(pieces, found, groups)) if group else place(pieces, found, found),
        )),
    )


def overlaps(m: Column, spans: Column) -> Column:
    """Whether a match shares a character with one of ``spans``, which are apart and in order.

    Only the last span that starts before the match's end can; it is found by halving.
    """
    n = F.size(spans)
    jumps = F.transform(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    started = F.aggregate(jumps, F.lit(0), lambda at, j: at + F.when((at + j <= n) & (F.get(spans, at + j - 1)["start"] < m["stop"]), j).otherwise(0))
    return (n > 0) & (F.coalesce(F.get(spans, started - 1)["stop"], F.lit(0)) > m["start"])


def spans_of_kind(text: Column, likely: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans of one kind whose group is long enough; ``likely`` must hold for every text that has one."""
    found = F.filter(located(text, pattern, group), lambda m: m["part"] >= least)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))
    return F.when(likely, spans.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Struct of the spans of the three base kinds.

    A maximal run that is long enough is also the leftmost match of the pattern
    with that least length, so hexadecimal and access keys are searched so; an
    assignment that fails still uses up its text, so its pattern stays as it is.
    """
    return F.struct(
        spans_of_kind(text, let(F.lower(text), lambda t: any_of(t, ASSIGN_MARKS)), ASSIGN, 0, LEAST_ASSIGN, 1).alias("assign"),
        spans_of_kind(text, text.contains("AKIA"), rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", 1, LEAST_ACCESS).alias("access"),
        spans_of_kind(text, text.rlike(rf"[0-9a-f]{{{LEAST_HEX}}}"), rf"[0-9a-f]{{{LEAST_HEX},}}", 2, LEAST_HEX).alias("hex"),
    )


def alphabet_size(s: Column) -> Column:
    """Symbols of the inferred encoding; NULL where uniform use is no evidence (digits or letters of one case only)."""
    return (
        F.when(s.rlike(r"\A[0-9_/+=-]+\z"), None)
        .when(s.rlike(r"\A(?:[a-z_/+=-]+|[A-Z_/+=-]+)\z"), None)
        .when(s.rlike(r"\A[0-9a-f]+\z") | s.rlike(r"\A[0-9A-F]+\z"), 16)
        .when(s.rlike(r"\A[A-Z2-7]+=*\z"), 32)
        .when(s.rlike(r"\A[0-9a-z]+\z") | s.rlike(r"\A[0-9A-Z]+\z"), 36)
        .when(s.rlike(r"\A[A-Za-z]+\z"), 52)
        .when(s.rlike(r"\A[0-9A-Za-z]+\z"), 62)
        .otherwise(64)
    )


def upper_tail(z: Column) -> Column:
    """Chance of a standard normal beyond ``z``; the constants are the usual rational approximation's."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * (1 / sqrt(2 * 3.141592653589793)) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding_of(k: Column) -> Column:
    """The number of the encoding with ``k`` symbols."""
    found = F.lit(MIXED)
    for i, symbols in enumerate(ENCODINGS):
        found = F.when(k == symbols, i).otherwise(found)
    return found


def of_encoding(values: list[float], k: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), encoding_of(k))


def chi_squared_z(s: Column, n: Column, k: Column) -> Column:
    """How far below ordinary text, in its standard deviations, the distance from uniform lies."""
    symbols = F.array_distinct(F.split(s, ""))
    squares = F.aggregate(
        F.array_remove(symbols, ""), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0))
    )
    chi = k * squares / n - n
    excess = n * (k * of_encoding(AGREE, k) - 1)
    return (k - 1 + excess - chi) / F.sqrt(2 * (k - 1) + 4 * excess)


def runs_z(s: Column, n: Column, change: Column) -> Column:
    """How far the changes of character class exceed those of ordinary text."""
    runs = F.length(F.regexp_replace(s, r"[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+", "."))
    steps = n - 1
    return (runs - 1 - steps * change) / F.sqrt(steps * (change * (1 - change)))


def serial_z(s: Column, n: Column) -> Column:
    """Lag-one correlation of the codes, in standard errors."""

    def correlation(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return let(F.transform(v, lambda x: x - mean), lambda d: F.aggregate(
            F.sequence(F.lit(0), F.size(d) - 2), F.lit(0.0), lambda a, i: a + F.get(d, i) * F.get(d, i + 1)
        ) / F.greatest(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x), F.lit(1e-9)))

    codes = F.transform(F.array_remove(F.split(s, ""), ""), lambda c: F.ascii(c).cast("double"))
    return let(codes, correlation) * F.sqrt(n)


def judge(s: Column) -> Column:
    """Struct of a candidate's encoding and -10 log10 of the battery's p-value, in whole steps; 0 where there is no evidence."""

    def battery(body: Column, k: Column) -> Column:
        n = F.length(body).cast("double")
        combined = (chi_squared_z(body, n, k) + runs_z(body, n, of_encoding(CHANGE, k))) / sqrt(2)
        p = F.greatest(upper_tail(combined), F.lit(1e-300))
        steps = F.least(F.floor(-10 * F.log10(p)), F.lit(STEPS))
        known = F.when(n < LEAST_CANDIDATE, 0).when(k.isNull() | (F.abs(serial_z(body, n)) > REGULAR), 0).otherwise(F.greatest(steps, F.lit(0)))
        return F.struct(encoding_of(k).alias("encoding"), known.cast("int").alias("steps"))

    return let(F.rtrim(s, F.lit("=")), lambda body: let(alphabet_size(body).cast("double"), lambda k: battery(body, k)))


def candidates(text: Column, base: Column) -> Column:
    """Runs of key characters apart from the base spans: start, stop, length class and steps of p."""

    def judged(found: Column) -> Column:
        free = F.filter(found, lambda m: ~(overlaps(m, base["assign"]) | overlaps(m, base["access"]) | overlaps(m, base["hex"])))
        return F.transform(free, lambda m: F.struct(
            m["start"].alias("start"), m["stop"].alias("stop"),
            sum(((m["stop"] - m["start"] >= c).cast("int") for c in LENGTH_CLASSES[1:]), F.lit(0)).alias("size"),
            judge(m["own"]).alias("judged"),
        ))

    none = F.array().cast("array<struct<start:int,stop:int,size:int,judged:struct<encoding:int,steps:int>>>")
    likely = text.rlike(rf"[A-Za-z0-9+/_-]{{{LEAST_CANDIDATE}}}")
    return F.when(likely, judged(located(text, CANDIDATE))).otherwise(none)


def scan(text: Column) -> Column:
    """Struct of the base spans and of the judged candidates of one text."""
    return let(text, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), candidates(t, b).alias("found"))))


def all_thresholds(texts: DataFrame) -> list[list[int]]:
    """Least steps of p accepted in each encoding and length class, from a column ``t`` of whole texts.

    Benjamini and Hochberg: the largest p such that p times the candidates is at
    most the rate times the candidates accepted; in mixed encodings never weaker
    than ``WEAKEST``.
    """
    found = texts.select(F.explode(scan(F.col("t"))["found"]).alias("c"))
    kinds = [F.col("c.judged.encoding").alias("encoding"), F.col("c.size").alias("size"), F.col("c.judged.steps").alias("steps")]
    counts = found.groupBy(*kinds).count().collect()
    out = []
    for encoding in range(MIXED + 1):
        out.append([])
        for size in range(len(LENGTH_CLASSES)):
            own = sorted(((r["steps"], r["count"]) for r in counts if (r["encoding"], r["size"]) == (encoding, size)), reverse=True)
            total, taken, least = sum(n for _, n in own), 0, STEPS + 1
            for steps, n in own:
                taken += n
                if steps >= (WEAKEST if encoding == MIXED else 1) and 10 ** (-steps / 10) * total <= RATE * taken:
                    least = steps
            out[-1].append(least)
    return out


def thresholds(texts: DataFrame, encoding: int = MIXED) -> list[int]:
    """Least steps of p accepted in each length class of one encoding."""
    return all_thresholds(texts)[encoding]


def all_spans(scanned: Column, least: list[list[int]]) -> Column:
    """Base spans and accepted candidates by start, then kind."""
    limits = F.array(*[F.array(*[F.lit(x) for x in of_one]) for of_one in least])
    accepted = F.filter(scanned["found"], lambda c: c["judged"]["steps"] >= F.get(F.get(limits, c["judged"]["encoding"]), c["size"]))
    random = F.transform(accepted, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.lit(3).alias("kind")))
    return by_place(F.concat(base_of(scanned), random.cast(f"array<{SPAN}>")))


def base_of(scanned: Column) -> Column:
    return F.concat(scanned["base"]["assign"], scanned["base"]["access"], scanned["base"]["hex"])


def by_place(spans: Column) -> Column:
    turned = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.sort_array(turned)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``base`` and ``spans`` (arrays of start, kind, stop) of every row."""
    whole = docs.select(F.col(key), text_or_empty(text).alias("t"))
    least = all_thresholds(whole.select("t"))
    scanned = whole.select(key, scan(F.col("t")).alias("s"))
    return scanned.select(key, by_place(base_of(F.col("s"))).alias("base"), all_spans(F.col("s"), least).alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with every span replaced; the character count follows the text. Other columns stay."""
    least = all_thresholds(docs.select(text_or_empty(text).alias("t")))

    def replaced(t: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        # a span that starts inside the last one only moves its end
        done = F.aggregate(spans, start, lambda a, s: F.struct(
            F.greatest(a["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(REPLACEMENT)))
            .otherwise(a["out"]).alias("out"),
        ))
        return let(done, lambda d: F.concat(d["out"], F.substring(t, d["at"] + 1, F.length(t))))

    cleaned = let(F.coalesce(F.col(text), F.lit("")), lambda t: let(scan(t), lambda found: let(
        all_spans(found, least), lambda spans: F.when(F.size(spans) == 0, t).otherwise(replaced(t, spans))
    )))
    out = docs.withColumn(text, F.when(F.col(text).isNotNull(), cleaned))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans."""
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        key, of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        sha256_hex(listed(F.col("base"))).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
