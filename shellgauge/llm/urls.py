"""URL filter lists by host suffix and path prefix.

A URL is expanded into the suffixes of its host (cut at dots) and the prefixes
of its path (cut after slashes); a rule has one host and one such path prefix.
Both sides meet in an equi-join on the first bytes of a digest of that pair.
A match is then confirmed by the full digest, by the rest of the rule's path
(a rule's path may end inside a segment) and by precedence: the longest rule
wins, a longer host before a longer path, a block before an allow.

Only label counts and path depths that some rule has are expanded, which is
exact and bounds the rows a URL makes by the rules. Rules are broadcast after a
check of their size; a larger list is joined by shuffle, its rows copied to
salts so that a common host is spread.

A null URL, or one without ``://``, has an empty host and path. Rules with null
fields match nothing. Repeated rows each give a row. Other columns of the pages
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.session import MAX_BROADCAST_ROWS

#: Hex digits of the digest that the join compares first.
SHORT = 8
#: Copies of each rule when the list is too large to broadcast.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lowered."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The last ``n`` labels of the host, for each ``n`` that rules have and the host reaches."""
    labels = F.split(host, r"\.")
    kept = F.filter(F.array(*[F.lit(n) for n in counts]), lambda n: n <= F.size(labels))
    return F.transform(kept, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def path_prefixes(path: Column, depths: list[int]) -> Column:
    """The path through its ``n``-th slash, for each ``n`` that rules have and the path reaches."""
    parts = F.split(path, "/")
    kept = F.filter(F.array(*[F.lit(n) for n in depths]), lambda n: n < F.size(parts))
    return F.transform(
        kept, lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    )


def expression_digest(host: Column, prefix: Column) -> Column:
    """Digest of one host suffix and one path prefix; a host holds no slash, so the pair is unambiguous."""
    return F.sha2(F.concat(host, F.lit("\n"), prefix).cast("binary"), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (``host``, ``path``, ``action``) with the digest they are joined by; repeated rules count once."""
    whole = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
    prefix = F.regexp_extract("path", r"(?s)\A(?:.*/)?", 0)
    host = F.translate("host", UPPER, LOWER)
    return whole.distinct().select(
        F.concat(host, "path").alias("rule"),
        F.col("path").alias("rule_path"),
        F.col("action").alias("rule_action"),
        F.length(host).alias("host_length"),
        F.length("path").alias("path_length"),
        F.size(F.split(host, r"\.")).alias("labels"),
        (F.size(F.split(prefix, "/")) - 1).alias("depth"),
        expression_digest(host, prefix).alias("rule_digest"),
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` and ``verdict`` of every row; ``default`` where no rule fits."""
    ready = prepare_rules(rules).withColumn("short", F.substring("rule_digest", 1, SHORT))
    # sizes of the rule list: three bounded numbers
    shape = ready.agg(F.collect_set("labels").alias("n"), F.collect_set("depth").alias("d"), F.count("*").alias("rows")).first()
    counts, depths = sorted(shape["n"]), sorted(shape["d"])
    parsed = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
    )
    if not counts:
        return parsed.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    pairs = F.flatten(
        F.transform(
            host_suffixes(F.col("host"), counts),
            lambda h: F.transform(path_prefixes(F.col("path"), depths), lambda p: expression_digest(h, p)),
        )
    )
    expanded = parsed.withColumn("digest", F.explode_outer(pairs)).withColumn("short", F.substring("digest", 1, SHORT))
    if shape["rows"] <= MAX_BROADCAST_ROWS:
        joined = expanded.join(F.broadcast(ready), "short", "left")
    else:
        salted = ready.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = expanded.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    confirmed = (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    best = F.max(
        F.when(
            confirmed,
            F.struct(
                (F.col("host_length") + F.col("path_length")).alias("length"), "host_length",
                (F.col("rule_action") == "block").alias("blocks"), "rule", "rule_action",
            ),
        )
    )
    return (
        joined.groupBy("row").agg(F.first("key").alias("key"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
        .select(
            F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.rule_action", F.lit(default)).alias("verdict"),
        )
    )
