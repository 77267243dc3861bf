"""Answers are made, matched and judged on the row of their item; joins move numbers and verdicts."""

from pyspark.sql import functions as F

from shellgauge.operators import calibration as cal
from shellgauge.plans import flow_queries as fq
from shellgauge.plans import judge_queries as jq
from shellgauge.plans import judging
from shellgauge.plans.judge_sql import AXES
from shellgauge.sources import adapters

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_logged_answers_stand_on_their_record(spark):
    assert "Join" not in optimized(fq._results(spark, SF).select("old", "new"))


def test_answers_that_cannot_be_reused_are_not_read(spark):
    rows = fq._results(spark, SF).select("reuse_error", "tier", "new_tier")
    got = rows.groupBy(F.col("reuse_error").isNull().alias("reusable")).agg(F.count("tier").alias("n")).collect()
    tiers = {r.reusable: r.n for r in got}
    assert tiers[False] == 0 and tiers[True] > 0


def test_verdicts_are_joined_instead_of_answers(spark):
    items = adapters.answer_items(spark, SF, AXES).withColumnRenamed("item_id", "cmd_id")
    warn = spark.createDataFrame([(3, True), (7, True), (10**12, True)], "cmd_id long, would_adjudicate boolean")
    out = judging.rubric_judge(warn, items, AXES)
    assert "LeftSemi" not in optimized(out)
    decisions = {r.cmd_id: r.judge_decision for r in out.collect()}
    alone = {r.cmd_id: r.judge_decision for r in judging.rubric_judge(warn, items.filter("cmd_id in (3, 7)"), AXES).collect()}
    assert decisions == alone and decisions[10**12] == "ask"


def test_chosen_items_are_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 50)
    asked = spark.range(1000).select(F.col("id").alias("item_id"))
    # without a broadcast of this small side, as for a large one
    items = adapters.answer_items(spark, SF, AXES, among=asked.hint("shuffle_hash")).select("item_id", F.size("answers").alias("n"))
    tasks = adapters.tasks_for(spark.read.parquet(f"{SF}/events.parquet"))
    items.collect()
    assert tasks > 8 and "hashpartitioning(event_id#" in (plan := items._jdf.queryExecution().executedPlan().toString())
    assert f", {tasks}), REPARTITION_BY_NUM" in plan


def test_both_models_stand_on_one_row(spark):
    items = adapters.answer_items(spark, SF, AXES, spread=True)
    one = cal.align_rows(adapters.answered_twice(items))
    assert "Join" not in optimized(jq._aligned(spark, SF))
    two = cal.align_pairs(items, adapters.target_answers(items))
    assert one.count() == two.count() and one.exceptAll(two).isEmpty()


def test_equal_answers_have_one_reference(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cal, "fit_temperature", lambda pairs: seen.append(pairs) or [])
    monkeypatch.setattr(spark, "createDataFrame", lambda *_: None)
    jq.fit_temperature(spark, SF)
    pairs = seen[0]
    n = adapters.long_answers(jq._spread(spark, SF)).filter("type <> 'noul'").count()
    assert pairs.agg(F.sum("w")).head()[0] == n
    assert pairs.count() == pairs.select("axis", "type", "p").distinct().count() < n


def test_split_is_taken_before_answers_are_made(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cal, "fit_report", lambda pairs: (seen.append(pairs), None))
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 50)
    jq.axis_fit_report(spark, SF)
    lines = optimized(seen[0]).splitlines()
    joins = [i for i, x in enumerate(lines) if "Join" in x]
    assert joins and next(i for i, x in enumerate(lines) if "Repartition " in x) < min(joins)
    tasks = adapters.tasks_for(spark.read.parquet(f"{SF}/events.parquet"))
    assert seen[0].rdd.getNumPartitions() == tasks > 8
    items = adapters.answer_items(spark, SF, AXES, spread=True)
    before = cal.align_pairs(items.join(cal.holdout_split(items.select("item_id")), "item_id"), adapters.target_answers(items), ("split",))
    assert seen[0].count() == before.count() and seen[0].exceptAll(before).isEmpty()
