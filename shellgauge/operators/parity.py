"""Audit of two result sets of the same commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compared fields.
FIELDS = "decision provisional scores aggregate fired_rules skip_reason final".split()


def differing(a: Column, b: Column, fields: list[str]) -> Column:
    """Names of the fields in which two structs of a row differ."""
    return F.array_compact(F.array(*[F.when(~a[n].eqNullSafe(b[n]), F.lit(n)) for n in fields]))


def parity_rows(both: DataFrame, ours: str, golden: str, fields: list[str] | None = None) -> DataFrame:
    """The same audit where both results stand on one row, as two structs: no join."""
    out = both.withColumn("diff", differing(F.col(ours), F.col(golden), fields or FIELDS))
    return out.withColumn("identical", F.size("diff") == 0)


def parity_diff(ours: DataFrame, golden: DataFrame, key: str = "cmd", fields: list[str] | None = None) -> DataFrame:
    """Names of the fields that differ, per command; commands on one side only count too."""
    names = fields or FIELDS
    left = ours.select(key, F.struct(*names).alias("a"), *([c for c in ("tags",) if c in ours.columns]))
    right = golden.select(key, F.struct(*names).alias("b"))
    both = left.join(right, key, "full_outer")
    return both.withColumn("diff", differing(F.col("a"), F.col("b"), names)).withColumn("identical", F.size("diff") == 0).drop("a", "b")


def parity_allowlist(diffs: DataFrame, allowlist: DataFrame, registry: DataFrame, key: str = "cmd") -> DataFrame:
    """Problems of an audit: unexplained differences, tags that did not fire, stale entries.

    ``diffs``: ``cmd, identical, tags``. ``allowlist``: ``tag_id, cmd``.
    ``registry``: ``id, detection``. Listed tags are collected per command; the
    registry bounds each list.
    """
    from shellgauge.session import small

    runtime = small(registry.filter(F.col("detection") == "runtime").select(F.col("id").alias("tag_id"), F.lit(True).alias("rt")))
    listed = allowlist.join(runtime, "tag_id", "left").groupBy(key).agg(
        F.array_sort(F.collect_set("tag_id")).alias("listed"),
        F.array_sort(F.collect_set(F.when(F.col("rt"), F.col("tag_id")))).alias("listed_runtime"))
    j = diffs.join(listed, key, "full_outer")
    silent = F.array_except("listed_runtime", F.coalesce("tags", F.array().cast("array<string>")))
    problem = (
        F.when(F.col("identical").isNull(), F.lit("orphan entry"))
        .when(~F.col("identical") & F.col("listed").isNull(), F.lit("unexplained difference"))
        .when(F.col("identical") & F.col("listed").isNotNull(), F.lit("stale entry"))
        .when(~F.col("identical") & (F.size(silent) > 0), F.concat(F.lit("did not fire: "), F.array_join(silent, ",")))
    )
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(key, "problem")


def parity_counts(diffs: DataFrame) -> DataFrame:
    """``what, n``: identical, divergent, and differences per field."""
    total = diffs.groupBy(F.when(F.col("identical"), F.lit("identical")).otherwise(F.lit("divergent")).alias("what"))
    fields = diffs.select(F.explode("diff").alias("f")).groupBy(F.concat(F.lit("field:"), F.col("f")).alias("what"))
    return total.agg(F.count("*").alias("n")).unionByName(fields.agg(F.count("*").alias("n")))
