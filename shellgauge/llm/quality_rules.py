"""Decision lists over document statistics, learned by sequential covering.

Statistics of a text are Spark expressions, evaluated in the row; the 5-word
windows of a text are hashed and compared inside its row, so nothing is
shuffled. A list is learned from labelled documents: a rule is grown one
threshold condition at a time by information gain on two thirds of them, pruned
to the best prefix on the other third, and kept while it is precise there, covers a
share of the bad documents, and a test says that this is not chance, so a list can
form as soon as the pruning third holds a few bad documents (three or four where one
in five is bad); the documents it covers are set aside and the next rule is learned. The list is an
ordered conditional expression over the statistics.

Learning uses at most ``MAX_LABELLED`` labelled documents, taken by the hash of
their id (a documented bound of the fit, not of the verdicts); the driver sees
counts per statistic, threshold and label. Everything else covers all rows.

Null texts have no words. Empty texts have zeros and fail the base rule. Tied
gains take the first statistic, then the threshold that covers least. Repeated rows each
get their verdict; repeated or conflicting labels count as one bad label if one
of them is bad. Without labels the list is empty and only the base rule rejects.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import exp, lgamma, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.functions.text import let
from shellgauge.llm.common import BLANKS, text_or_empty, whole_row, words
from shellgauge.session import keep

#: Labelled documents that a list is learned from, at most.
MAX_LABELLED = 20_000
#: Thresholds tried for a statistic, at most.
THRESHOLDS = 32
#: Tasks over the sample.
LEARNING_TASKS = 8
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule must be this precise on the pruning third, cover this share of the bad documents over all, and not hit so many
#: bad ones of the pruning third by chance: with this probability at most, were it blind to the label.
LEAST_PRECISION, LEAST_COVER, BY_CHANCE = 0.9, 0.02, 0.01
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of five words that the text holds twice or more."""

    def covered(by_hash: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(by_hash) - 1)
        same = lambda k, j: F.get(by_hash, k)["h"] == F.get(by_hash, j)["h"]
        twice = F.filter(at, lambda k: same(k, k - 1) | same(k, k + 1))
        starts = F.sort_array(F.transform(twice, lambda k: F.get(by_hash, k)["i"]))
        none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words"))
        return F.aggregate(
            starts, none,
            lambda a, p: F.struct(p.alias("last"), (a["words"] + F.least(F.lit(WINDOW), p - a["last"])).alias("words")),
            lambda a: a["words"],
        )

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, covered))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])
    )
    return F.when(F.size(w) < WINDOW, 0).otherwise(let(hashes, count)).cast("long")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def statistics(text: Column) -> Column:
    """One struct of counts and shares for a text."""

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    def of_words(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{BLANKS}]"))
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(lines, of_lines).alias("lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(t, "[^0-9]+", "")).cast("long").alias("n_digits"),
        )
        return let(
            counts,
            lambda c: F.struct(
                c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
                c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
                share(c["word_chars"], c["n_words"]).alias("mean_word"),
                share(c["n_symbols"], c["word_chars"]).alias("symbol_share"),
                share(c["n_symbols"], c["n_words"]).alias("symbols_per_word"),
                share(c["n_repeat_words"], c["n_words"]).alias("repeat_share"),
                share(c["n_distinct"], c["n_words"]).alias("distinct_share"),
                share(c["n_upper"], c["word_chars"]).alias("upper_share"),
                share(c["n_digits"], c["word_chars"]).alias("digit_share"),
                share(c["lines"]["dup"], c["lines"]["n"]).alias("dup_line_share"),
                share(c["n_words"], c["lines"]["n"]).alias("words_per_line"),
            ),
        )

    return let(text, lambda t: let(words(t), lambda w: of_words(t, w)))


#: What rules may test.
FEATURES = [
    "n_words", "mean_word", "symbol_share", "symbols_per_word", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "dup_line_share", "words_per_line",
]


def base_failed(s: Column) -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    """``feature <= threshold`` or ``feature > threshold``."""

    feature: int
    bin: int
    above: bool
    threshold: float

    def holds(self, s: Column) -> Column:
        value = s[FEATURES[self.feature]].cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def holds_binned(self) -> Column:
        value = F.col("bins")[self.feature]
        return value > self.bin if self.above else value <= self.bin

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:g}"


Rule = list[Condition]


def all_hold(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def verdict(rules: list[Rule], s: Column) -> Column:
    """True to keep: the ordered conditional expression of a list."""
    out: Column | None = None
    for rule in rules:
        covered = all_hold([c.holds(s) for c in rule])
        out = F.when(covered, False) if out is None else out.when(covered, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys and whether they are bad: one row a key, at most about ``MAX_LABELLED`` rows, chosen by hash."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key"))
    one = one.agg((F.min(label) == 0).alias("bad"))
    total = one.count()
    if total > MAX_LABELLED:
        one = one.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(total)) < MAX_LABELLED)
    return one


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """The decision list that labelled documents teach."""
    wanted = labelled_sample(labels, key, label)
    known = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("t")).join(F.broadcast(wanted), "key")
    measured = known.select("key", "bad", statistics(F.col("t")).alias("s"))
    # documents the base rule rejects teach nothing that the list must know; the sample is bounded, so it is cached
    rows = keep(measured, ~base_failed(F.col("s"))).select(
        "bad", (F.pmod(F.xxhash64("key"), F.lit(3)) != 0).alias("grow"),
        F.array(*[F.col("s")[f].cast("double") for f in FEATURES]).alias("x"),
    ).persist()
    steps = [(i + 0.5) / THRESHOLDS for i in range(THRESHOLDS)]
    bad_only = F.col("bad")
    cuts = rows.agg(*[
        F.array_sort(F.array_distinct(F.array_union(
            F.coalesce(F.percentile_approx(F.col("x")[i], steps, 10_000), F.array().cast("array<double>")),
            F.coalesce(F.percentile_approx(F.when(bad_only, F.col("x")[i]), steps, 10_000), F.array().cast("array<double>")),
        ))).alias(f)
        for i, f in enumerate(FEATURES)
    ]).first()
    grid = [list(cuts[f]) for f in FEATURES]
    below = [below_value(g, F.col("x")[i]) for i, g in enumerate(grid)]
    binned = rows.select("bad", "grow", "x", F.array(*below).alias("bins")).coalesce(LEARNING_TASKS).persist()
    left = binned
    rules: list[Rule] = []
    all_bad = binned.filter("bad").count()
    while len(rules) < MAX_RULES:
        rule = prune(left, grow(left, grid), all_bad)
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~all_hold([c.holds_binned() for c in rule]))
    rules = between_values(binned, rules)
    binned.unpersist()
    rows.unpersist()
    return rules


def between_values(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The same list with each threshold halfway between the labelled values on its two sides."""
    sides = []
    for c in (c for rule in rules for c in rule):
        value, above = F.col("x")[c.feature], F.col("bins")[c.feature] > c.bin
        sides += [F.max(F.when(~above, value)), F.min(F.when(above, value))]
    if not sides:
        return rules
    seen = iter(rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sides)]).first())
    halfway = lambda c, low, high: replace(c, threshold=(low + high) / 2) if low is not None and high is not None else c
    return [[halfway(c, next(seen), next(seen)) for c in rule] for rule in rules]


def below_value(cuts: list[float], value: Column) -> Column:
    """How many of the ascending cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value)) if cuts else F.lit(0)


def grow(left: DataFrame, grid: list[list[float]]) -> Rule:
    """Add the condition of most information gain until only bad documents are covered."""
    rule: Rule = []
    while len(rule) < MAX_CONDITIONS:
        covered = left.filter(F.col("grow") & all_hold([c.holds_binned() for c in rule]))
        counts = covered.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "bad").count().collect()
        best, best_gain = None, 1e-9
        for f, cuts in enumerate(grid):
            bad, good = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
            for r in counts:
                if r["f"] == f:
                    (bad if r["bad"] else good)[r["b"]] += r["count"]
            total_bad, total_good = sum(bad), sum(good)
            if not total_bad or not total_good:
                continue
            start = log2(total_bad / (total_bad + total_good))
            p = n = 0
            for b in range(len(cuts)):
                p, n = p + bad[b], n + good[b]
                for above, pp, nn in ((False, p, n), (True, total_bad - p, total_good - n)):
                    gain = pp * (log2(pp / (pp + nn)) - start) if pp else 0.0
                    tighter = best is not None and above and (best.feature, best.above) == (f, True) and gain == best_gain
                    if gain > best_gain or tighter:
                        best, best_gain = Condition(f, b, above, cuts[b]), gain
        if best is None:
            break
        rule.append(best)
    return rule


def chance(hits: int, covered: int, share: float) -> float:
    """The probability of that many hits or more among the covered, each of which is one with probability ``share``."""
    if not 0 < share < 1:
        return 1.0
    log_term = lambda k: lgamma(covered + 1) - lgamma(k + 1) - lgamma(covered - k + 1) + k * log(share) + (covered - k) * log(1 - share)
    return min(1.0, sum(exp(log_term(k)) for k in range(hits, covered + 1)))


def prune(left: DataFrame, rule: Rule, all_bad: int) -> Rule:
    """The prefix that separates best on the pruning third; none unless it is precise, and not by chance."""
    if not rule:
        return []
    hits = [F.count_if(~F.col("grow") & F.col("bad")).alias("bad"), F.count_if(~F.col("grow")).alias("rows")]
    for k in range(1, len(rule) + 1):
        covers = all_hold([c.holds_binned() for c in rule[:k]])
        for name, rows in ((f"p{k}", ~F.col("grow") & F.col("bad")), (f"n{k}", ~F.col("grow") & ~F.col("bad")), (f"all{k}", F.col("bad"))):
            hits.append(F.count_if(covers & rows).alias(name))
    seen = left.agg(*hits).first()
    best, worth = [], None
    for k in range(1, len(rule) + 1):
        p, n, total = seen[f"p{k}"], seen[f"n{k}"], seen[f"all{k}"]
        if total < LEAST_COVER * all_bad or (p + 1) / (p + n + 1) < LEAST_PRECISION:
            continue
        if chance(p, p + n, seen["bad"] / max(seen["rows"], 1)) > BY_CHANCE:
            continue
        value = (p - n) / (p + n + 1)
        if worth is None or value > worth:
            best, worth = rule[:k], value
    return best


def judge(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the base counts, ``base_failed`` and ``kept`` of every row."""
    s = F.col("s")
    measured = docs.select(F.col(key), statistics(text_or_empty(text)).alias("s"))
    return measured.select(
        key, *[s[c].alias(c) for c in BASE], base_failed(s).alias("base_failed"), (~base_failed(s) & verdict(rules, s)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows, with all their columns, that pass the base rule and the list."""
    # bound once: a filter on a column would be pushed down and repeat its expression
    good = let(statistics(text_or_empty(F.col("__doc")[text])), lambda s: ~base_failed(s) & verdict(rules, s))
    return whole_row(docs, "__doc").filter(good).select("__doc.*")
