"""Context of logged calls as of their time, against a plain scan of each transcript."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shellgauge.operators import context as ctx
from shellgauge.plans import session_context as sc
from shellgauge.sources import logs

LOGGED = "call_id string, session string, tool_use_id string, at bigint, name string, input string"


def user(text):
    return json.dumps({"type": "user", "message": {"role": "user", "content": text}})


def call(id_, command):
    return json.dumps({"type": "assistant", "message": {"content": [
        {"type": "tool_use", "id": id_, "name": "Bash", "input": {"command": command}}]}})


def records(spark, lines):
    """``lines``: session, seq, at, value."""
    return logs.transcript_records(spark.createDataFrame(lines, "session string, seq bigint, at bigint, value string"))


def states(spark, lines, logged, **limits):
    rows = [(c, s, t, at, "Bash", json.dumps({"command": c})) for c, s, t, at in logged]
    out = sc.logged_states(spark.createDataFrame(rows, LOGGED), records(spark, lines), limits, time_bucket=50)
    return {r.call_id: r for r in out.collect()}


def test_before_found_and_without_transcript(spark):
    lines = [("s", 0, 100, user("build it")), ("s", 1, 200, call("c1", "make")), ("s", 2, 300, user("again")),
             ("s", 3, 400, call("c2", "make all")), ("t", 0, 100, '{"type": "assist')]
    got = states(spark, lines, [
        ("early", "s", "x", 100, ), ("first", "s", "x", 101), ("same", "s", "x", 200), ("late", "s", None, 350),
        ("untimed", "s", "x", None), ("own", "s", "c2", 1), ("lost", "u", "x", 500), ("none", None, "c1", 500),
        ("torn", "t", "x", 500)])
    view = {k: (r.level, r.actions_total, r.prompts_total, r.found_current, list(r.prior_actions)) for k, r in got.items()}
    assert view == {
        "early": ("L0", 0, 0, False, []), "first": ("L1", 0, 1, False, []), "same": ("L1", 0, 1, False, []),
        "late": ("L2", 1, 2, False, ["bash(make)"]), "untimed": ("L2", 2, 2, False, ["bash(make)", "bash(make all)"]),
        "own": ("L2", 1, 2, True, ["bash(make)"]), "lost": ("L0", 0, 0, False, []), "none": ("L0", 0, 0, False, []),
        "torn": ("L0", 0, 0, False, [])}
    assert got["late"].user_request == "build it\n\nagain"
    assert got["none"].level_reason == "no transcript_path"
    assert got["lost"].level_reason.startswith("transcript unreadable")
    assert got["own"].level_reason == "transcript"
    assert "not yet written" in got["late"].level_reason == got["torn"].level_reason
    capped = states(spark, lines, [("late", "s", "x", 350)], max_level="L1")["late"]
    assert (capped.level, "PRIOR AGENT ACTIONS" in capped.state) == ("L1", False)
    assert capped.level_reason.endswith("; capped at l1_request by judge.context.max_level")


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    lines = [("s", 0, 10, call("c", "a")), ("s", 1, 20, call("c", "b")), ("s", 2, None, call("d", "e"))]
    rows = [("k", "s", "x", 15, "Bash", '{"command": "z"}')] * 3 + [("o", "s", "c", 99, "Bash", '{"command": "b"}')]
    logged = spark.createDataFrame(rows, LOGGED).withColumns({"prompt": F.lit("theirs"), "seq": F.lit(7), "part": F.lit(1)})
    out = sc.logged_states(logged, records(spark, lines)).collect()
    assert sorted((r.call_id, r.actions_total, r.prompt) for r in out) == [("k", 1, "theirs")] * 3 + [("o", 0, "theirs")]
    assert sc.logged_states(logged.limit(0), records(spark, lines)).count() == 0
    empty = sc.logged_states(logged, records(spark, lines).limit(0)).collect()
    assert {r.level for r in empty} == {"L0"} and len(empty) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_scan_on_one_hot_session(spark, seed):
    rng = random.Random(seed)
    lines, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 3, 40])
        text = "w" * rng.randint(1, 30)
        lines.append(("s", i, at, user(f"{i} {text}") if rng.random() < 0.4 else call(f"c{i}", f"{i} {text}")))
    logged = [(f"k{j}", "s", f"c{rng.randrange(400)}" if j % 4 == 0 else f"late{j}", rng.randrange(at + 50)) for j in range(150)]
    got = states(spark, lines, logged, history_chars=200, field_chars=90)
    ids = {json.loads(v)["message"]["content"][0]["id"]: i for _, i, _, v in lines if '"tool_use"' in v}
    for call_id, _, use, when in logged:
        stop = ids.get(use)
        if stop is None:
            stop = max((i for _, i, t, _ in lines if t < when), default=-1) + 1
        calls = [f"bash({json.loads(v)['message']['content'][0]['input']['command']})" for _, i, _, v in lines if i < stop and '"tool_use"' in v]
        prompts = [json.loads(v)["message"]["content"] for _, i, _, v in lines if i < stop and '"tool_use"' not in v]
        kept, used = [], 0
        for t in reversed(calls):
            if kept and used + len(t) + 8 > 200:
                break
            used += len(t) + 8
            kept.insert(0, t)
        asked, used = [], 0
        for t in reversed(prompts):
            cost = len(t) + (2 if asked else 0)
            if asked and used + cost > 90:
                break
            used += cost
            asked.insert(0, t)
        r = got[call_id]
        assert (r.actions_total, r.prompts_total) == (len(calls), len(prompts))
        assert list(r.prior_actions) == kept
        assert r.user_request == "\n\n".join(asked)


def test_as_of_carries_over_empty_buckets_and_groups_of_null(spark):
    rows = [("a", 1, 5), ("a", 990, None), ("a", 995, 3), ("b", 7, None), (None, 3, 9), (None, 800, None)]
    line = spark.createDataFrame(rows, "g string, at bigint, v bigint")
    out = ctx.as_of(line, ["g"], ["at"], F.floor(F.col("at") / 10), ["v"])
    assert {(r.g, r.at): r.v for r in out.collect()} == {
        ("a", 1): 5, ("a", 990): 5, ("a", 995): 5, ("b", 7): None, (None, 3): 9, (None, 800): 9}
