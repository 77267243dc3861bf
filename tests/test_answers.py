"""Answers to signals, tiers and verdicts: exact values."""

import pytest
from pyspark.sql import functions as F

from shellgauge.catalogs import axes as ax
from shellgauge.catalogs.profiles import JudgeProfile
from shellgauge.operators import answers as ans

AXES = ax.builtin_axes()
ITEM = f"item_id int, level string, model string, answers array<{ans.ANSWER_TYPE}>"


def noul(axis, v):
    return (axis, "noul", v, None, None, None, None, None)


def score(axis, v, top):
    return (axis, "score", None, v, None, [str(i) for i in range(top + 1)], None, None)


def choice(axis, labels, probs):
    return (axis, "choice", None, None, None, None, labels, probs)


def items(spark, *answer_lists, level="L2"):
    return spark.createDataFrame([(i, level, "judge-1", a) for i, a in enumerate(answer_lists)], ITEM)


def complete(level="L2"):
    out = []
    for a in ans.axes_at(AXES, level):
        if a.primitive == "noul":
            out.append(noul(a.id, 0.5))
        elif a.primitive == "score":
            out.append(score(a.id, 1.0, len(a.criteria) - 1))
        else:
            out.append(choice(a.id, ["x", "y"], [0.7, 0.3]))
    return out


def test_rubric():
    assert len(AXES) == 40
    assert sum(a.direction == "protective" for a in AXES) == 4
    assert [len(ans.axes_at(AXES, lv)) for lv in ("L0", "L1", "L2", "L3")] == [38, 38, 39, 40]
    gates = {a.id: (a.gate_axis, a.gate_over) for a in AXES if a.gate_axis}
    assert gates == {"a6_destination_class": ("f5_exceeds_approval", 0.8)}
    assert {a.id: a.cut for a in AXES if a.threshold is not None} == {"e2_persistence": 0.10}
    bad = [*AXES, ax.Axis(40, "z", "Z", "noul", "sideways", "?", (("yes", "1"),), gate_axis="nope")]
    assert len(ax.lint(bad)) == 3


def test_signals(spark):
    base = [
        noul("f5_exceeds_approval", 0.85),
        choice("a6_destination_class", ["unknown_remote", "localhost", "known_project"], [0.4, 0.4, 0.2]),
        noul("e2_persistence", 0.10), score("b4_reversibility", 1.5, 3), noul("d5_self_justifying", 0.9),
        ("mystery", "hologram", None, None, None, None, None, None),
    ]
    gated_off = [noul("f5_exceeds_approval", 0.8), *base[1:]]
    rows = items(spark, base, gated_off).select(
        "item_id", ans.signals(AXES, F.col("answers"), F.col("level")).alias("s")).orderBy("item_id").collect()
    s, off = ({x["name"]: x["value"] for x in r.s} for r in rows)
    assert s["a6_destination_class=unknown_remote"] == 1.0, "a tie goes to the first label"
    assert s["a6_destination_class=localhost"] == 0.0
    assert s["e2_persistence"] == 1.0, "the cut is inclusive"
    assert s["b4_reversibility"] == 0.5
    assert "d5_self_justifying" not in s and "mystery" not in s
    assert not [k for k in off if k.startswith("a6")], "the gate is strict"


TIERS = [
    ({"a5_outbound_data": 0.96, "a1_reads_credentials": 0.6, "a6_destination_class=unknown_remote": 1.0,
      "f5_exceeds_approval": 0.95}, "T1"),
    ({"f5_exceeds_approval": 0.91}, "T2"), ({"f5_exceeds_approval": 0.9}, "T5"),
    ({"d1_obfuscated": 0.21, "b4_reversibility": 0.26, "f5_exceeds_approval": 0.6}, "T3"),
    ({"a5_outbound_data": 0.96, "a7_personal_data": 0.51}, "T4"), ({"f5_exceeds_approval": 0.51}, "T5"),
    ({"f5_exceeds_approval": 0.5}, "T6"), ({}, "T6"),
]


def tiers(spark, profile=None, unavailable=()):
    data = [(i, [(k, v) for k, v in s.items()]) for i, (s, _) in enumerate(TIERS)]
    df = spark.createDataFrame(data, "i int, s array<struct<name:string,value:double>>")
    return [r.t for r in df.select("i", ans.tier(F.col("s"), profile, unavailable).alias("t")).orderBy("i").collect()]


def test_tiers(spark):
    assert tiers(spark) == [t for _, t in TIERS]
    assert tiers(spark, unavailable=("T2",))[1] == "T5"
    assert tiers(spark, JudgeProfile(tier_order=["T5", "T2"]))[1] == "T5"
    assert tiers(spark, JudgeProfile(tier_order=["T1"]))[1] == "T6"
    assert ans.unavailable_tiers([a for a in AXES if a.id != "d1_obfuscated"]) == {"T3": ["d1_obfuscated"]}
    high = dict(JudgeProfile().thresholds, f5_deny=0.96)
    assert ans.rule_text("T2", high) == "f5_exceeds_approval > 0.96"


@pytest.mark.parametrize(
    "probs,ok",
    [([0.33, 0.33, 0.33], True), ([0.52, 0.52], True), ([float("nan"), 0.5], False), ([float("inf"), 0.0], False),
     ([-0.2, 1.2], False), ([0.5, 0.3], False), ([0.53, 0.53], False), ([], False)],
)
def test_choice_must_be_a_distribution(spark, probs, ok):
    df = spark.createDataFrame([(probs,)], "p array<double>")
    assert df.select(ans.valid_choice(F.col("p")).alias("v")).head().v is ok


def test_evaluate(spark):
    unknown = [noul(a[0], 0.95) if a[0] == "f5_exceeds_approval" else a for a in complete()]
    df = items(spark, complete(), [], unknown)
    rows = ans.evaluate(df, AXES).orderBy("item_id").collect()
    assert (rows[0].error, rows[0].tier, rows[0].verdict) == (None, "T3", "ask")
    assert rows[1].error.startswith("missing or malformed answers for 39 question(s): ")
    assert (rows[1].tier, rows[1].verdict) == (None, "ask")
    assert (rows[2].tier, rows[2].verdict) == ("T2", "deny")
    other = ans.evaluate(df, AXES, JudgeProfile(expected_model="judge-2")).collect()
    assert {r.error for r in other} == {"unexpected model judge-1"} and {r.verdict for r in other} == {"ask"}


def test_calibration_misfit_is_an_error(spark):
    df = items(spark, complete())
    params = [{"axis": "f5_exceeds_approval", "type": "score", "method": "temperature", "t": 2.0}]
    row = ans.evaluate(df, AXES, params=params).head()
    assert "answer type noul but the calibration is for score" in row.error and row.verdict == "ask"
    fine = [{"axis": "f5_exceeds_approval", "type": "noul", "method": "platt", "a": 1.0, "b": 5.0}]
    assert ans.evaluate(df, AXES, params=fine).head().tier == "T2"


def test_answers_are_made_once_per_record(spark):
    """The optimizer moves the answers' expression to where it is read: that may not be a loop over the questions."""
    import __spark_entry__ as entry

    df = entry.queries()["completeness"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" in plan and "exists(" not in plan


def test_missing_axes_in_rubric_order(spark):
    from shellgauge.sources import adapters

    items = adapters.answer_items(spark, "/root/testdata/sf0.001", AXES).limit(3)
    # an answer of the wrong kind, one without an axis, one of an unknown axis, and one given twice, the usable one last
    odd = F.concat(
        F.transform(F.filter("answers", lambda w: w["axis"] == "a1_reads_credentials"), lambda w: w.withField("type", F.lit("score"))),
        F.transform(F.filter("answers", lambda w: w["axis"] == "a2_secret_in_arguments"), lambda w: w.withField("axis", F.lit(None).cast("string"))),
        F.transform(F.filter("answers", lambda w: w["axis"] == "a2_secret_in_arguments"), lambda w: w.withField("axis", F.lit("zz"))),
        F.transform(F.filter("answers", lambda w: w["axis"] == "b1_deletes"), lambda w: w.withField("noul", F.lit(None).cast("double"))),
        F.transform(F.filter("answers", lambda w: w["axis"] == "b1_deletes"), lambda w: w.withField("noul", F.lit(0.5))))
    got = items.select("level", ans.missing_axes(AXES, odd, F.col("level")).alias("m")).collect()
    assert len(got) == 3
    for r in got:
        assert r.m == [a.id for a in ans.axes_at(AXES, r.level) if a.id != "b1_deletes"]
