"""Judging through the store: hits, misses, failures, versions, and where shuffles are."""

from collections import Counter

import pandas as pd

from shellgauge.plans import memo
from shellgauge.plans.judging import text_judge
from shellgauge.session import scratch

STATES = ["ls", "rm x", "rm x", "ls", "ls", None, "", "boom now", "curl y"]


def table(spark, states=STATES):
    rows = [(i, s, "text" if i != 4 else None, "x", -1) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "cmd_id long, judge_prompt string, backend string, state string, state_hash long")


def counting(spark):
    """A judge that leaves a file for every state it is asked about."""
    calls = spark.sparkContext.accumulator(0)

    def judge(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("boom").any():
            raise TimeoutError("timeout")
        calls.add(len(prompts))
        return prompts.map(lambda p: "SAFE" if len(p) % 2 == 0 else "DANGEROUS: no")

    return judge, calls


def run(spark, store, judge, rubric="r1", states=STATES):
    out = memo.judge_through(table(spark, states), judge, store, "m", rubric).collect()
    return {r["cmd_id"]: (r["judge_decision"], r["judge_source"], r["judge_error"]) for r in out}


def test_second_run_judges_only_what_failed(spark):
    store = memo.AnswerStore(spark, scratch(spark, "store"), buckets=4)
    judge, calls = counting(spark)
    first = run(spark, store, judge)
    assert len(first) == len(STATES)
    assert all(first[i][0] == ("allow" if len(s or "") % 2 == 0 else "deny") for i, s in enumerate(STATES) if s != "boom now")
    assert {s for _, s, _ in first.values()} == {"judged", "failed"} and first[7] == ("deny", "failed", "judge failed: timeout")
    asked = calls.value
    second = run(spark, store, judge)
    assert calls.value == asked and Counter(s for _, s, _ in second.values()) == Counter(cache=8, failed=1)
    assert {i: d for i, (d, _, _) in first.items()} == {i: d for i, (d, _, _) in second.items()}
    third = run(spark, store, judge, "r2")
    assert {s for _, s, _ in third.values()} == {"judged", "failed"}
    more = run(spark, store, judge, "r1", ["ls", "new one"])
    assert [more[i][1] for i in (0, 1)] == ["cache", "judged"]
    assert sorted((r["model"], r["rubric_hash"]) for r in store.table().select("model", "rubric_hash").distinct().collect()) == [("m", "r1"), ("m", "r2")]


def test_another_session_finds_the_store(spark):
    folder = scratch(spark, "store")
    judge, _ = counting(spark)
    run(spark, memo.AnswerStore(spark, folder, buckets=4), judge)
    other = memo.AnswerStore(spark.newSession(), folder, buckets=4)
    spark.sql(f"DROP TABLE {other.name}")
    assert other.replies("m", "r1").count() == 4


def test_stored_replies_are_not_shuffled(spark):
    store = memo.AnswerStore(spark, scratch(spark, "store"), buckets=4)
    judge, _ = counting(spark)
    run(spark, store, judge)
    states = spark.createDataFrame([("a", "x"), ("b", "y")], "state_hash string, state string")
    plan = store.lookup(states, "m", "r1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "PartitionFilters: [isnotnull(model" in plan


def test_backend_of_each_row(spark):
    store = memo.AnswerStore(spark, scratch(spark, "store"), buckets=4)
    judge, _ = counting(spark)
    out = memo.judge_by_backend(table(spark), {"text": lambda rows: memo.judge_through(rows, judge, store, "m", "r1")}).collect()
    assert len(out) == len(STATES)
    assert {r["cmd_id"]: r["judge_decision"] for r in out}[4] == "unadjudicated" and Counter(r["judge_source"] for r in out)["none"] == 1


def test_empty(spark):
    store = memo.AnswerStore(spark, scratch(spark, "store"), buckets=4)
    judge, calls = counting(spark)
    assert run(spark, store, judge, states=STATES[:0]) == {} and calls.value == 0


def test_halving_keeps_the_error_with_its_row(spark):
    asked = []

    def judge(prompts: pd.Series) -> pd.Series:
        if (prompts == "bad").any():
            raise ValueError("no")
        return prompts.map(lambda p: "SAFE")

    rows = [(i, "bad" if i in (3, 90) else f"ok {i % 7}") for i in range(100)]
    out = text_judge(spark.createDataFrame(rows, "cmd_id long, judge_prompt string").coalesce(1), judge).collect()
    assert {r["cmd_id"] for r in out if r["judge_error"]} == {3, 90} and len(out) == 100 and not asked
    assert all(r["judge_decision"] == "allow" for r in out if not r["judge_error"])
