"""Replay, profiles, projections and the parity audit."""

import json

from pyspark.sql import functions as F

from shellgauge.catalogs.profiles import DEFAULT, PAPER
from shellgauge.catalogs.tags import REGISTRY
from shellgauge.operators import parity, replay
from shellgauge.operators import projections as pj


def test_transition_matrix(spark):
    pairs = [("allow", "allow")] * 2 + [("allow", "none"), ("ask", "allow"), ("ask", "needs_judge"), ("deny", "needs_judge"),
                                        ("none", "none"), ("none", "needs_judge"), ("allow", "ask")]
    got = {r.old: list(r)[1:] for r in replay.transition_matrix(spark.createDataFrame(pairs, "old string, new string")).collect()}
    assert got == {"allow": [2, 1, 0, 1, 0], "ask": [1, 0, 0, 0, 1], "deny": [0, 0, 0, 0, 1], "none": [0, 0, 0, 1, 1]}


def profile_rows(spark, profile):
    return spark.createDataFrame(profile.rows(), "profile_id string, key string, value string")


def test_profiles(spark):
    assert len(PAPER.entries()) == 61 and len(DEFAULT.entries()) == 62
    got = replay.profile_overrides(profile_rows(spark, PAPER), profile_rows(spark, DEFAULT)).collect()
    assert sorted(r.key for r in got) == [
        "static.modes.balanced.tau_high", "static.modes.balanced.tau_low", "static.resolution.high_risk",
        "static.rules.SE-P-003.confidence"]
    both = profile_rows(spark, PAPER).unionByName(profile_rows(spark, DEFAULT))
    prints = {r.profile_id: r.fingerprint for r in replay.profile_fingerprint(both).collect()}
    again = {r.profile_id: r.fingerprint for r in replay.profile_fingerprint(both.repartition(9)).collect()}
    assert prints == again and prints["paper"] != prints["default"] and len(prints["paper"]) == 16


def test_validation(spark):
    cases = [("static.weights.sem", "1.5", "out of range"), ("static.weights.sem", '"x"', "not a number"),
             ("judge.verdicts.T1", '"never"', "not one of the allowed values"), ("judge.context.field_chars", "0", "out of range"),
             ("judge.context.field_chars", "1.5", "not a whole number"), ("judge.tiers.order", '["T9"]', "unknown tier"),
             ("judge.skip_tools", "3", "not a list"), ("nope", "1", "unknown key"), ("static.weights.sem", "0.4", None)]
    df = spark.createDataFrame([(str(i), k, v) for i, (k, v, _) in enumerate(cases)], "profile_id string, key string, value string")
    got = {int(r.profile_id): r for r in replay.profile_validate(df, DEFAULT).collect()}
    assert [got[i].problem for i in range(len(cases))] == [c[2] for c in cases]
    assert got[0].effective == json.dumps(0.3) and got[8].effective == "0.4" and got[7].effective is None


def test_scoreability(spark):
    cases = {'{"command": "ls"}': None, "{}": "missing command", '{"command": null}': "missing command",
             '{"command": " "}': "empty command", '{"command": 5}': "command is not a string"}
    df = spark.createDataFrame([("Bash", k) for k in cases] + [("Read", "{}")], "t string, i string")
    got = [r.r for r in df.select(pj.scoreability(F.col("t"), F.col("i")).alias("r")).collect()]
    assert got == [*cases.values(), "non-shell tool"]


def test_truncation_keeps_characters_whole(spark):
    text = "é" * 3000
    row = spark.createDataFrame([(text, json.dumps({"a": text, "b": [1]}))], "t string, j string").select(
        pj.field_truncate(F.col("t"), 4097).alias("c"), pj.truncate_object(F.col("j"), 100).alias("o"),
        pj.is_truncated(F.col("j")).alias("before")).withColumn("after", pj.is_truncated(F.col("o"))).head()
    assert (len(row.c.truncated), row.c.len) == (2048, 6000)
    assert (row.before, row.after) == (False, True) and json.loads(row.o)["b"] == [1]


def test_backend_host(spark):
    urls = ["https://u:p@h.example:8443/v1?x", "h.example/a", "http://h.example"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.h for r in df.select(pj.backend_host(F.col("u")).alias("h")).collect()] == ["h.example:8443", "h.example", "h.example"]


def test_parity_audit(spark):
    cols = "cmd string, decision string, final string, tags array<string>"
    ours = spark.createDataFrame([("a", "x", "allow", []), ("b", "x", "deny", ["FIX-005"]), ("c", "x", "deny", []),
                                  ("d", "x", "deny", [])], cols)
    golden = spark.createDataFrame([("a", "x", "allow"), ("b", "x", "allow"), ("c", "y", "allow"), ("d", "x", "allow")],
                                   "cmd string, decision string, final string")
    diffs = parity.parity_diff(ours, golden, "cmd", ["decision", "final"])
    counts = {r.what: r.n for r in parity.parity_counts(diffs).collect()}
    assert counts == {"identical": 1, "divergent": 3, "field:final": 3, "field:decision": 1}
    allow = spark.createDataFrame([("FIX-005", "b"), ("FIX-009", "c"), ("FIX-001", "a"), ("FIX-001", "z")], "tag_id string, cmd string")
    registry = spark.createDataFrame(REGISTRY, "id string, title string, detection string")
    got = {r.cmd: r.problem for r in parity.parity_allowlist(diffs, allow, registry).collect()}
    assert got == {"a": "stale entry", "c": "did not fire: FIX-009", "d": "unexplained difference", "z": "orphan entry"}


def test_tier_cells_equal_rescoring(spark):
    """Every set of tiers read from the cells against rules dropped from each row."""
    rows = [
        (0, [("mitre", 0.9), ("manual", 0.5)], 0.2, 0.0, 0.0), (1, [("gtfobins", 0.8)], 0.0, 0.3, 0.0), (1, [], 0.7, 0.0, 0.1),
        (0, [("manual", 0.6), ("manual", 0.3)], 0.1, 0.1, 0.1), (None, [("mitre", 0.4), ("gtfobins", 0.85)], 0.0, 0.0, 0.0),
        (1, [("mitre", 0.9), ("manual", 0.5)], 0.2, 0.0, 0.0)]
    scored = spark.createDataFrame(rows * 3, "label int, f array<struct<tier:string,strength:double>>, sem double, path double, struct double")
    scored = scored.withColumns({
        "fired": F.col("f"), "atoms": F.expr("array(named_struct('class', 'NONE', 'score', sem))"),
        "l3": F.expr("cast(array() as array<struct<hits:array<struct<tier:string,secret_bearing:boolean,access:string>>>>)"),
        "scores": F.struct("sem", "path", F.lit(0.0).alias("pat"), "struct")}).select("label", "fired", "atoms", "l3", "scores")
    weights = {"sem": 0.3, "path": 0.3, "pat": 0.3, "struct": 0.1}
    grid = replay.ablation_grid(weights, 0.15, 0.35)
    got = {(r.profile, r.left_out, r.label, r.decision): r.n for r in replay.tier_ablation(
        replay.tier_cells(scored, "label"), grid, replay.tier_subsets()).collect()}
    want = {}
    for g in grid:
        for s in replay.tier_subsets():
            out = [t for t, kept in zip(replay.TIERS, s["kept"], strict=True) if not kept]
            for label, fired, sem, path, struct in rows * 3:
                left = [(t, x) for t, x in fired if t not in out]
                pat = max((x for _, x in left), default=0.0)
                score = round(g["sem"] * sem + g["path"] * path + g["pat"] * pat + g["struct"] * struct, 9)
                rule = max((x for t, x in left if t != "manual"), default=0.0)
                verdict = "allow" if score < 0.15 else "deny" if score >= 0.35 or rule >= 0.8 else "warn"
                key = (g["profile"], s["left_out"], label, verdict)
                want[key] = want.get(key, 0) + 1
    assert got == want and len({k[1] for k in got}) == 8
    assert replay.tier_ablation(replay.tier_cells(scored.limit(0), "label"), grid, replay.tier_subsets()).count() == 0
