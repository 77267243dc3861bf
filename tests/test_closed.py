"""Broken records ask, hidden shells and deep commands are seen, nothing is cut short."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shellgauge.operators import answers as ans
from shellgauge.operators import calibration as cal
from shellgauge.operators import canon, projections, replay, reports, structure
from shellgauge.plans.judge_sql import AXES
from shellgauge.plans.judging import text_judge
from shellgauge.sources import adapters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def good(spark):
    """One item that is complete and allowed."""
    items = adapters.answer_items(spark, SF, AXES)
    return ans.evaluate(items, AXES).filter("error is null").select("item_id", "level", "model", "answers").limit(1).cache()


@pytest.mark.parametrize("change, error", [
    ({"answers": None}, "missing or malformed"), ({"level": None}, "unknown level (none)"), ({"level": "L9"}, "unknown level L9"),
    ({"model": None}, "unexpected model (none)"),
])
def test_broken_records_ask(good, change, error):
    name, value = next(iter(change.items()))
    row = ans.evaluate(good.withColumn(name, F.lit(value).cast(good.schema[name].dataType)), AXES).first()
    assert error in row["error"] and row["verdict"] == "ask" and row["tier"] is None
    assert not good.select(ans.complete(AXES, F.lit(None).cast(good.schema["answers"].dataType), F.col("level")).alias("c")).first()["c"]


def test_unnamed_pins_and_records_are_refused(spark):
    rows = spark.createDataFrame([("r", "m"), (None, "m"), ("r", None), ("x", "m")], "rubric_hash string, model string")
    assert [r["pin_error"] is None for r in cal.pin_check(rows, "r", "m").collect()] == [True, False, False, False]
    log = spark.createDataFrame(
        [(True, "r", "h", "m"), (None, "r", "h", "m"), (True, None, "h", "m"), (True, "r", None, "m"), (True, "r", "h", None)],
        "has_answers boolean, judge_rubric_hash string, backend_host string, expected_model string",
    ).withColumns({"state": F.lit("s"), "model": F.lit("m"), "judge_error": F.lit(None).cast("string"), "overrides": F.array().cast("array<string>")})
    assert [r["reuse_error"] is None for r in replay.reuse_eligibility(log, "r", "h", "m").collect()] == [True] + [False] * 4


def test_deep_commands(spark):
    text = "rm -rf /etc"
    rows = []
    for depth in range(9):
        rows.append((depth, text))
        text = f"echo $({text})"
    df = spark.createDataFrame(rows, "d int, t string")
    for r in df.select("d", structure.atoms(F.col("t")).alias("a"), structure.substitution_depth(F.col("t")).alias("n")).collect():
        assert r["a"][-1] == "rm -rf /etc" and r["n"] == r["d"]


@pytest.mark.parametrize("command", ["bas\\h -c 'rm -rf /etc'", "\"s\"h -c 'rm -rf /etc'", "bash \\-c 'rm -rf /etc'", "bash '-c' 'rm -rf /etc'", "bash -c 'rm -rf /etc'"])
def test_hidden_shells(spark, command):
    df = spark.createDataFrame([(command,)], "c string")
    found = df.select(canon.views(F.col("c")).alias("v")).first()["v"]
    assert ("shell_c", "rm -rf /etc") in [(v["kind"], v["text"]) for v in found]


def test_nested_truncation(spark):
    value = {"edits": [{"new_string": "é" * 3000, "n": 1}, {"new_string": "short \" \\ {x}"}], "a": {"b": ["y" * 5000]}, "k" * 10: None}
    row = spark.createDataFrame([(json.dumps(value),), ("not json",)], "t string").select(projections.truncate_object(F.col("t")).alias("o")).collect()
    got = json.loads(row[0]["o"])
    assert got["edits"][0]["new_string"]["len"] == 6000 and got["edits"][0]["n"] == 1 and got["edits"][1] == value["edits"][1]
    assert got["a"]["b"][0]["truncated"] == "y" * 4096 and got["k" * 10] is None


def test_auc_of_close_scores(spark):
    rows = [(1, 0.500004), (0, 0.500003), (1, 0.500002), (0, 0.500001), (1, 0.9), (0, 0.1), (0, 0.500002)]
    got = reports.auc_tar(spark.createDataFrame(rows, "label int, score double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got["auc"] - want) < 1e-12 and abs(got["tar"] - 2 / 3) < 1e-12


def test_one_failing_prompt(spark):
    def judge(prompts: pd.Series) -> pd.Series:
        if (prompts == "boom").any():
            raise ValueError("no")
        return prompts.map({"a": "SAFE", "b": "DANGEROUS"})

    rows = [(1, "a"), (1, "b"), (2, "boom"), (3, "a"), (None, "a")]
    got = text_judge(spark.createDataFrame(rows, "cmd_id long, judge_prompt string").coalesce(1), judge).collect()
    assert [(r["cmd_id"], r["judge_decision"]) for r in got] == [(1, "allow"), (1, "deny"), (2, "deny"), (3, "allow"), (None, "allow")]
    assert [r["judge_error"] for r in got] == [None, None, "judge failed: no", None, None]
