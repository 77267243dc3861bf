"""Stored results with a tree of checksums, and their comparison from the top down.

A store is a folder of three Parquet tables. ``rows`` holds the rows in one
directory for each of ``TOPS`` tops, sorted by ``leaf``: both come from the hash
of the key. ``leaves`` holds, in the same directories, how many rows a leaf has
and two order-free sums of their hashes; ``tops`` the same sums for each top.

Two stores are compared by their tops; of those that differ, the leaves; of those
that differ, the rows. So equal stores move ``TOPS`` checksums and read no row, and
a few changed rows read the few leaves that hold them, whatever the size of the
rest. The number of leaves is a parameter of both stores and should grow with
their rows (some ten thousand a leaf). Fields may be of any type but maps.

Equal rows of a key are counted before they move and a difference in how often
they stand there is reported; different rows of one key are paired in the order
of their hashes. Null keys are equal to each other, null fields too. An empty
result makes a store without tops, which can be compared. Columns of a result
beside its key and fields are not stored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellgauge.operators.parity import differing

TOPS, LEAVES = 64, 4096
SUMS = ["n", "sum_a", "sum_b"]
_SUM_TYPES = "n long, sum_a decimal(38,0), sum_b decimal(38,0)"


def _sums(rows: DataFrame, by: list[str], n: Column, a: Column, b: Column) -> DataFrame:
    wide = "decimal(38,0)"
    return rows.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(a).cast(wide).alias("sum_a"), F.sum(b).cast(wide).alias("sum_b"))


@dataclass(frozen=True)
class ResultStore:
    """The results ``fields`` of ``key`` in a folder that all executors share."""

    spark: SparkSession
    folder: str
    leaves: int = LEAVES

    def write(self, results: DataFrame, key: str, fields: list[str]) -> None:
        leaf = F.pmod(F.xxhash64(F.col(key)), F.lit(self.leaves)).cast("int")
        rows = results.select(F.col(key).alias("key"), F.struct(*fields).alias("fields"), leaf.alias("leaf"))
        rows = rows.withColumn("top", F.pmod("leaf", F.lit(TOPS)).cast("int"))
        # few files a top, and a top of many rows is split over tasks
        rows.hint("rebalance", "top").sortWithinPartitions("top", "leaf").write.partitionBy("top").parquet(f"{self.folder}/rows")
        stored = self.rows(rows.schema)
        # the hash of a struct passes over nulls, that of its text does not
        text = F.to_json(F.struct("key", "fields"), {"ignoreNullFields": "false"})
        a, b = F.xxhash64(text).cast("decimal(20,0)"), F.xxhash64(F.lit("b"), text).cast("decimal(20,0)")
        sums = _sums(stored, ["top", "leaf"], F.lit(1), a, b)
        sums.write.partitionBy("top").parquet(f"{self.folder}/leaves")
        _sums(self.leaf_sums(), ["top"], F.col("n"), F.col("sum_a"), F.col("sum_b")).coalesce(1).write.parquet(f"{self.folder}/tops")

    def rows(self, schema: object = None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.folder}/rows")

    def leaf_sums(self) -> DataFrame:
        return self.spark.read.schema(f"leaf int, {_SUM_TYPES}, top int").parquet(f"{self.folder}/leaves")

    def top_sums(self) -> DataFrame:
        return self.spark.read.schema(f"top int, {_SUM_TYPES}").parquet(f"{self.folder}/tops")


def _unequal(ours: DataFrame, golden: DataFrame, by: str) -> DataFrame:
    """``by`` of the sums that differ or stand on one side only."""
    other = golden.select(F.col(by), F.struct(*SUMS).alias("golden"))
    both = ours.select(F.col(by), F.struct(*SUMS).alias("ours")).join(other, by, "full_outer")
    return both.filter(~F.col("ours").eqNullSafe(F.col("golden"))).select(by)


def _versions(store: ResultStore, schema: object, tops: list[int], leaves: DataFrame) -> DataFrame:
    """Distinct rows of the leaves with how often they occur, numbered within their key."""
    # a leaf is an int, and there are as many as the store was told
    rows = store.rows(schema).filter(F.col("top").isin(tops)).join(F.broadcast(leaves), "leaf", "left_semi")
    found = rows.groupBy("key", "fields").agg(F.count("*").alias("times"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("fields"), F.to_json("fields"))
    return found.withColumn("version", F.row_number().over(order))


def compare(ours: ResultStore, golden: ResultStore, schema: object, fields: list[str]) -> DataFrame:
    """``key`` and ``diff`` of every row that differs: its fields, ``missing`` here, ``extra`` here, or ``times``.

    ``schema`` is that of both stores' rows.
    """
    if ours.leaves != golden.leaves:
        raise ValueError("stores of different numbers of leaves cannot be compared")
    # TOPS rows at most
    tops = [r["top"] for r in _unequal(ours.top_sums(), golden.top_sums(), "top").collect()]
    some = F.col("top").isin(tops) if tops else F.lit(False)
    leaves = _unequal(ours.leaf_sums().filter(some), golden.leaf_sums().filter(some), "leaf")
    a = _versions(ours, schema, tops, leaves).select(F.col("key").alias("a_key"), F.col("version").alias("a_version"), F.col("fields").alias("a"), F.col("times").alias("a_times"))
    b = _versions(golden, schema, tops, leaves).select(F.col("key").alias("b_key"), F.col("version").alias("b_version"), F.col("fields").alias("b"), F.col("times").alias("b_times"))
    both = a.join(b, F.col("a_key").eqNullSafe(F.col("b_key")) & (F.col("a_version") == F.col("b_version")), "full_outer")
    names = differing(F.col("a"), F.col("b"), fields)
    diff = (
        F.when(F.col("a_version").isNull(), F.lit("missing"))
        .when(F.col("b_version").isNull(), F.lit("extra"))
        .when(F.size(names) > 0, F.array_join(names, ","))
        .when(F.col("a_times") != F.col("b_times"), F.lit("times"))
    )
    key = F.when(F.col("a_version").isNull(), F.col("b_key")).otherwise(F.col("a_key"))
    return both.select(key.alias("key"), diff.alias("diff")).filter(F.col("diff").isNotNull())


def rows_schema(results: DataFrame, key: str, fields: list[str]) -> object:
    """The schema of a store's rows for results of this form."""
    shape = results.select(F.col(key).alias("key"), F.struct(*fields).alias("fields"), F.lit(0).alias("leaf"), F.lit(0).alias("top"))
    return shape.schema


def compared_rows(store: ResultStore) -> int:
    """How many rows a store holds, read from its tops."""
    return store.top_sums().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
