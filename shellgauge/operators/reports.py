"""Reports over the decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def outcomes_by_config(log: DataFrame) -> DataFrame:
    return log.filter(F.col("command").isNotNull()).groupBy(
        "config_fingerprint", F.array_join("overrides", ",").alias("overrides"), "final").agg(F.count("*").alias("n"))


def tiers_by_rubric(log: DataFrame) -> DataFrame:
    return log.filter(F.col("judge_backend") == "rubric").groupBy(
        "rubric_hash", "config_fingerprint", "tier", "judge_verdict").agg(F.count("*").alias("n"))


def warn_rate(log: DataFrame) -> DataFrame:
    return log.filter(F.col("command").isNotNull()).groupBy(
        "config_fingerprint", F.array_join("overrides", ",").alias("overrides")).agg(
        F.avg((F.col("balanced") == "WARN").cast("double")).alias("warn_rate"), F.count("*").alias("n"))


def recent_decisions(log: DataFrame, limit: int) -> DataFrame:
    """Newest decisions; a top-k that never sorts the whole log."""
    return log.filter(F.col("command").isNotNull()).select(
        "ts", "tool_use_id", "final", "aggregate", "command").orderBy(F.desc("ts"), F.desc("tool_use_id")).limit(limit)


def would_be_denied(log: DataFrame) -> DataFrame:
    return log.filter(F.col("would_emit") == "deny").select(
        "tool_use_id", "command", "skip_predicate", F.array_join("rule_ids", ",").alias("fired"))


def tag_frequency(log: DataFrame) -> DataFrame:
    tags = F.concat("fixes_applied", "ext_applied")
    return log.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def judge_latency(log: DataFrame, exact: bool = False) -> DataFrame:
    """Latency quantiles by tier, verdict and level; a mergeable sketch unless exact."""
    q = (lambda p: F.percentile("latency_ms", p)) if exact else (lambda p: F.percentile_approx("latency_ms", p, 10000))
    return log.filter(F.col("judge_backend") == "rubric").groupBy("tier", "judge_verdict", "level").agg(
        F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"),
        F.max("latency_ms").alias("max_ms"))


def unscored_by_tool(log: DataFrame) -> DataFrame:
    return log.filter("unscored").groupBy("tool_name", "unscored_reason", "tier", "final").agg(F.count("*").alias("n"))


def warn_commands(log: DataFrame) -> DataFrame:
    return log.filter("would_adjudicate").select(
        "tool_use_id", "command", "aggregate", "tier", "judge_verdict", "judge_error")


def level_reason_counts(log: DataFrame) -> DataFrame:
    return log.filter(F.col("judge_backend") == "rubric").groupBy("level", "level_reason").agg(F.count("*").alias("n"))


def tier_purity(items: DataFrame) -> DataFrame:
    """Per tier: size, share of dangerous items, recall up to that tier (``tier, label``)."""
    per = items.groupBy("tier").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("dangerous"))
    # At most six rows reach the window.
    upto = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.select(
        "tier", "n", (F.col("dangerous") / F.col("n")).alias("deny_share"),
        (F.sum("dangerous").over(upto) / F.sum("dangerous").over(whole)).alias("cumulative_recall"))


def detection_metrics(items: DataFrame, by: str = "family") -> DataFrame:
    """Detection rate, false positive rate and F1, by group and in total (``label, flagged``)."""
    pos, hit = F.col("label") == 1, F.col("flagged") == 1
    counts = items.rollup(by).agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(pos & ~hit).alias("fn"),
        F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return counts.select(
        F.coalesce(by, F.lit("all")).alias(by), "tp", "fn", "fp", "tn", ratio(tp, tp + fn).alias("dr"),
        ratio(fp, fp + tn).alias("fpr"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def wilson(k: Column, n: Column) -> Column:
    """95 % Wilson interval of a proportion as ``struct<low, high>``."""
    p, z2 = k / n, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct((centre - half).alias("low"), (centre + half).alias("high"))


def wilson_mcnemar(items: DataFrame) -> DataFrame:
    """Interval of the detection rate of two methods and their discordant pairs (``label, flagged_a, flagged_b``)."""
    pos = F.col("label") == 1
    a, b = F.col("flagged_a") == 1, F.col("flagged_b") == 1
    right_a, right_b = a == pos, b == pos
    c = items.agg(
        F.count_if(pos).alias("n"), F.count_if(pos & a).alias("ka"), F.count_if(pos & b).alias("kb"),
        F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"))
    wa, wb = wilson(F.col("ka"), F.col("n")), wilson(F.col("kb"), F.col("n"))
    return c.select("n", "ka", "kb", "only_a", "only_b", wa["low"].alias("a_low"), wa["high"].alias("a_high"),
                    wb["low"].alias("b_low"), wb["high"].alias("b_high"))


def auc_tar(items: DataFrame, score: str = "score", max_fpr: float = 0.01, digits: int = 4) -> DataFrame:
    """Area under the ROC curve and best recall at a false positive rate (``label, score``).

    Every distinct score is a step of its own. Scores are summed once by their
    first digits, which gives what lies above each of these cells; inside a cell
    a window ranks its scores, so no window holds them all.
    """
    per = items.groupBy(F.col(score).cast("double").alias("s"), F.round(score, digits).alias("cell")).agg(
        F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = per.groupBy("cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "cell", F.coalesce(F.sum("p").over(above), F.lit(0.0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0.0)).alias("n0"),
        F.sum("p").over(whole).alias("tp"), F.sum("n").over(whole).alias("tn"))
    inside = Window.partitionBy("cell").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    cum = per.join(cells, "cell").select(
        "pos", "neg", "tp", "tn", (F.col("p0") + F.sum("pos").over(inside)).alias("cp"), (F.col("n0") + F.sum("neg").over(inside)).alias("cn"))
    # Each group beats the negatives below it and ties with its own.
    area = F.sum(F.col("pos") * (F.col("tn") - F.col("cn") + F.col("neg") / 2)) / (F.max("tp") * F.max("tn"))
    ok = F.col("cn") <= max_fpr * F.col("tn")
    return cum.agg(area.alias("auc"), F.coalesce(F.max(F.when(ok, F.col("cp") / F.col("tp"))), F.lit(0.0)).alias("tar"))