"""Transcripts, budgets and state text, also against brute force on a hot session."""

import json

from pyspark.sql import functions as F

from shellgauge.operators import context as ctx
from shellgauge.sources import logs


def user(content, **flags):
    return json.dumps({"type": "user", **flags, "message": {"role": "user", "content": content}})


def call(id_, name, inp):
    return json.dumps({"type": "assistant", "message": {"content": [
        {"type": "text", "text": "PROSE"}, {"type": "tool_use", "id": id_, "name": name, "input": inp}]}})


LINES = [
    user("Run the tests"), call("c1", "Bash", {"command": "pytest -q", "description": "DESC"}),
    user([{"type": "tool_result", "tool_use_id": "c1", "content": "RESULT"}]),
    call("c2", "Read", {"limit": 5, "file_path": "/w/a.py"}), user("  now clean the build dir \n"),
    user("<task-notification>done</task-notification>"), user("please <system-reminder>x</system-reminder>"),
    user("Caveat", isMeta=True), user("sub", isSidechain=True), user([{"type": "text", "text": "look"}, {"type": "image"}]),
    call("c3", "Bash", {"command": "rm -rf build"}), '{"type": "assist',
]


def records(spark):
    rows = [("s", i, v) for i, v in enumerate(LINES)]
    return logs.transcript_records(spark.createDataFrame(rows, "session string, seq int, value string"))


def test_prompts_and_calls(spark):
    r = records(spark)
    assert r.filter("bad").count() == 1
    prompts = [x.prompt for x in logs.transcript_prompts(r).orderBy("seq", "part").collect()]
    assert prompts == ["Run the tests", "now clean the build dir", "look"]
    calls = logs.transcript_calls(r).select("seq", ctx.call_text(F.col("name"), F.col("input")).alias("t"))
    assert [x.t for x in calls.orderBy("seq").collect()] == [
        "bash(pytest -q)", 'Read({"file_path": "/w/a.py", "limit": 5})', "bash(rm -rf build)"]


def as_calls(spark, texts):
    return spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(texts)], "session string, pos bigint, t string")


def brute_history(texts, budget):
    out = []
    for i in range(len(texts)):
        kept, used = [], 0
        for t in reversed(texts[:i]):
            if kept and used + len(t) + 8 > budget:
                break
            used += len(t) + 8
            kept.append(t)
        out.append(kept[::-1])
    return out


def brute_request(prompts, budget):
    out = []
    for i in range(len(prompts)):
        kept, used = [prompts[i]], len(prompts[i])
        for p in reversed(prompts[:i]):
            if used + len(p) + 2 > budget:
                break
            used += len(p) + 2
            kept.append(p)
        out.append("\n\n".join(reversed(kept)))
    return out


def test_history_of_a_hot_session_equals_brute_force(spark):
    texts = [f"b({'x' * (i * 7 % 23)})" for i in range(400)]
    got = ctx.fitted_history(as_calls(spark, texts), "session", "pos", "t", budget=90, chunk=16)
    assert [r.prior_actions for r in got.orderBy("pos").collect()] == brute_history(texts, 90)


def test_request_of_a_hot_session_equals_brute_force(spark):
    prompts = ["y" * (i * 5 % 37 + 1) for i in range(300)]
    got = ctx.join_user_request(as_calls(spark, prompts), "session", "pos", "t", budget=60, chunk=8)
    assert [r.user_request for r in got.orderBy("pos").collect()] == brute_request(prompts, 60)


def test_newest_prompt_always_stays(spark):
    prompts = ["o" * 5000, "m" * 1500, "delete nothing", "z" * 6000]
    got = ctx.join_user_request(as_calls(spark, prompts), "session", "pos", "t").orderBy("pos").collect()
    assert got[2].user_request == prompts[1] + "\n\n" + prompts[2] and got[2].prompts_kept == 2
    assert (len(got[3].user_request), got[3].prompts_kept) == (6000, 1)


def test_positions_are_global_ranks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    got = ctx.positions(df, ["k"], ["o"], F.floor(F.col("o") / 100)).orderBy("k", "o").collect()
    for k in range(3):
        assert [r.pos for r in got if r.k == k] == list(range(1, sum(i % 3 == k for i in range(1000)) + 1))
    running = ctx.running_count(df, ["k"], ["o"], F.floor(F.col("o") / 100), F.col("o") % 2 == 0, "evens").orderBy("o").collect()
    assert running[-1].evens == sum(o % 2 == 0 for o in range(1000) if o % 3 == running[-1].k)


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 5)], "k string, o int")
    got = ctx.positions(df, ["k"], ["o"], F.floor(F.col("o") / 2)).orderBy("k", "o").collect()
    assert [r.pos for r in got] == [1, 2, 1, 2]


def test_call_states(spark):
    from shellgauge.plans.session_context import call_states

    got = {r.tool_use_id: r for r in call_states(records(spark)).collect()}
    assert len(got) == 3 and [got[c].level for c in ("c1", "c2", "c3")] == ["L1", "L2", "L2"]
    assert got["c3"].state == (
        "### PROPOSED ACTION\ntool: bash\nargs: rm -rf build\n\n### USER REQUEST\n"
        "Run the tests\n\nnow clean the build dir\n\nlook\n\n### PRIOR AGENT ACTIONS (most recent last)\n"
        '[1] bash(pytest -q)\n[2] Read({"file_path": "/w/a.py", "limit": 5})')
    assert got["c1"].user_request == "Run the tests" and not got["c1"].prior_actions


def test_decoders(spark):
    texts = ["echo 'aGVsbG8gd29ybGQK' | sh", r"printf '\x72\x6d\x20\x2d\x72\x66'",
             "x 0x726d202d7266202f746d702f7a7a7a7a7a z", "cat${IFS}/etc/passwd", "git commit -m refactoringStuff"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    d = [r.d for r in df.select("i", ctx.decode_payloads(F.col("t")).alias("d")).orderBy("i").collect()]
    assert d[0].base64 == ["hello world\n"] and d[1].hex == ["rm -rf"]
    assert d[2].hex_blobs == ["rm -rf /tmp/zzzzz"] and d[3].ifs_expanded == "cat /etc/passwd"
    assert not (d[4].base64 or d[4].hex or d[4].hex_blobs or d[4].ifs_expanded)


def test_state_text(spark):
    def render(level, request, prior, command="ls"):
        row = spark.range(1).select(ctx.render_state(
            F.lit(level), F.lit("bash"), F.lit(command), F.lit(request), F.array(*[F.lit(p) for p in prior]).cast("array<string>"),
            ctx.decode_payloads(F.lit(command))).alias("s"))
        return row.head().s

    assert render("L0", "req", ["bash(pwd)"]) == "### PROPOSED ACTION\ntool: bash\nargs: ls"
    assert render("L1", "req", ["bash(pwd)"]) == "### PROPOSED ACTION\ntool: bash\nargs: ls\n\n### USER REQUEST\nreq"
    assert render("L2", "req", ["bash(pwd)"]).endswith("\n\n### PRIOR AGENT ACTIONS (most recent last)\n[1] bash(pwd)")
    assert render("L0", "", [], "cat$IFS/x").endswith(
        "\n\n### DECODED FORMS (decoded from the action above)\nifs_expanded: cat /x")


def test_levels(spark):
    def level(has, n, req, top="L2"):
        c = spark.range(1).select(ctx.context_level(F.lit(has), F.lit(n), F.lit(req), top).alias("l"))
        return c.head().l

    assert [level(False, 0, ""), level(True, 0, ""), level(True, 0, "x"), level(True, 2, "")] == ["L0", "L0", "L1", "L2"]
    assert [level(True, 2, "x", "L1"), level(True, 2, "x", "L0")] == ["L1", "L0"]
