"""Costly columns are computed once."""

import pytest
from pyspark.sql import functions as F

from shellgauge.operators import answers as ans
from shellgauge.operators import calibration as cal
from shellgauge.operators import replay
from shellgauge.plans.judge_queries import PARAMS
from shellgauge.plans.judge_sql import AXES
from shellgauge.sources import adapters

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_become_rows_without_a_filter_that_makes_them_again(spark):
    items = adapters.answer_items(spark, SF, AXES, spread=True)
    assert "size(" not in optimized(adapters.long_answers(items).select("item_id", "axis"))
    kinds = {r["type"] for r in adapters.long_answers(items).filter("probs is not null").select("type").distinct().collect()}
    assert kinds == {"choice", "score"}


def test_parameters_are_looked_up_once_an_answer(spark):
    done = ans.apply_calibration(adapters.answer_items(spark, SF, AXES), PARAMS).select("answers")
    assert optimized(done).count("keys: [") <= 3


def test_pairs_keep_columns_and_count_by_weight(spark):
    rows = [("x", "noul", [0.2], [0.4]), ("x", "noul", [0.2], [0.4]), ("x", "noul", [0.9], [0.5])]
    pairs = spark.createDataFrame(rows, "axis string, type string, p array<double>, q array<double>")
    once = pairs.groupBy("axis", "type", "p", "q").agg(F.count("*").cast("double").alias("w"))
    assert cal.brier(once).head().brier == pytest.approx(cal.brier(pairs).head().brier)
    assert cal.ece(once).head().ece == pytest.approx(cal.ece(pairs).head().ece)
    items = adapters.answer_items(spark, SF, AXES).withColumn("split", F.lit("test"))
    assert cal.align_pairs(items, items, ("split",)).head().split == "test"


def test_changed_calls_are_stored_before_they_are_sorted(spark):
    rows = spark.range(20).select(F.col("id").alias("tool_use_id"), F.lit("t").alias("ts"), F.lit("f").alias("file"),
                                  F.col("id").alias("line"), (F.col("id") % 2 == 0).alias("changed"))
    out = replay.changed_calls(rows)
    assert "Range" not in optimized(out) and [r.line for r in out.collect()] == list(range(0, 20, 2))


def test_items_are_chosen_before_their_answers_are_made(spark):
    wanted = spark.createDataFrame([(3,), (7,), (3,)], "item_id long")
    items = adapters.answer_items(spark, SF, AXES, among=wanted)
    lines = optimized(items).splitlines()
    assert next(i for i, x in enumerate(lines) if "f5_exceeds_approval" in x) < next(i for i, x in enumerate(lines) if "LeftSemi" in x)
    whole = adapters.answer_items(spark, SF, AXES).filter("item_id in (3, 7)")
    assert sorted(map(str, items.collect())) == sorted(map(str, whole.collect()))
