"""Tasks are bounded by rows, whatever the bytes of a table."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shellgauge.operators import answers as ans
from shellgauge.sources import adapters


def test_tasks_grow_with_rows(spark, tmp_path, monkeypatch):
    spark.range(4000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 100)
    df = adapters.table(spark, str(tmp_path), "events")
    assert df.rdd.getNumPartitions() == 40
    assert max(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 200


def test_items_of_a_pair_meet_before_their_readings_become_rows(spark):
    rows = [(1, "deny", [("a", 0.9), ("b", 0.2)]), (1, "approve", [("a", 0.1), ("b", 0.4)]), (2, "deny", [("a", None)]),
            (2, "approve", [("a", 0.3)]), (3, "deny", [("a", 0.5)]), (3, "approve", [("a", 0.5)]), (4, "deny", [])]
    items = spark.createDataFrame(rows, "pair long, side string, readings array<struct<axis:string,value:double>>")
    got = {tuple(r) for r in ans.pair_separation_of_items(items, 5).collect()}
    assert got == {("a", 2, 1, False), ("b", 1, 0, False)}
    plan = entry.queries()["pair_separation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(axis" in plan and "hashpartitioning(pair" in plan and ", pair#" not in "".join(
        line for line in plan.splitlines() if "hashpartitioning(axis" in line)
