"""From rubric answers to signals, a first-match tier and a verdict.

Answers of an item are an array on its row (at most one per axis of the
rubric), so gates, completeness and tiers need no join and no pivot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.catalogs.axes import LEVELS, Axis, with_gate
from shellgauge.catalogs.profiles import TIER_ORDER, JudgeProfile
from shellgauge.functions.numeric import EPS, any_true, array_total, clamp, is_finite, temper
from shellgauge.functions.text import let, literal

ANSWER_TYPE = (
    "struct<axis:string,type:string,noul:double,score:double,choice:string,legend:array<string>,"
    "labels:array<string>,probs:array<double>>"
)
# How far choice probabilities may sum from 1, the default top level.
SUM_TOLERANCE = 0.05
DEFAULT_TOP = 4
# Labels of graded choices that become signals.
NAMED_LABELS = [
    ("a6_destination_class", "unknown_remote", "a6_unknown_remote"),
    ("a6_destination_class", "third_party_service", "a6_third_party"),
    ("b3_blast_radius", "system_wide", "b3_system_wide"),
    ("b3_blast_radius", "remote_infrastructure", "b3_remote_infrastructure"),
]
# Fixed value: the axis whose gate a profile sets.
GATED_AXIS = "a6_destination_class"
# Axes each tier reads.
TIER_AXES = {
    "T1": ["a5_outbound_data", "a1_reads_credentials", "a7_personal_data", "a6_destination_class"],
    "T2": ["f5_exceeds_approval"],
    "T3": ["d1_obfuscated", "b4_reversibility"],
    "T4": ["a5_outbound_data", "a1_reads_credentials", "a7_personal_data"],
    "T5": ["f5_exceeds_approval"],
}


def reading(answer: Column) -> Column:
    """A number between 0 and 1; null for choices."""
    top = F.array_max(F.transform(answer["legend"], lambda k: k.try_cast("bigint")))
    top = F.coalesce(F.when(top != 0, top), F.lit(DEFAULT_TOP))
    return F.when(answer["type"] == "noul", answer["noul"]).when(answer["type"] == "score", answer["score"] / top)


def valid_choice(probs: Column) -> Column:
    """At least one label, all finite and not negative, summing to about 1."""
    return F.coalesce(
        (F.size(probs) > 0) & F.forall(probs, lambda p: is_finite(p) & (p >= 0))
        & (F.abs(array_total(probs) - 1.0) <= SUM_TOLERANCE), F.lit(False))


def well_formed(answer: Column, primitive: Column) -> Column:
    """The answer is of the asked kind and can be read."""
    return F.coalesce((answer["type"] == primitive) & F.when(
        primitive == "choice", valid_choice(answer["probs"])).otherwise(is_finite(reading(answer))), F.lit(False))


def axes_at(axes: list[Axis], level: str) -> list[Axis]:
    """Axes asked at a context level."""
    return [a for a in axes if not a.requires or a.requires in LEVELS[level]]


def asked(axes: list[Axis], level: Column) -> Column:
    """The same as a column: ``array<struct<id, primitive>>`` by level."""
    table = {lv: [{"id": a.id, "primitive": a.primitive} for a in axes_at(axes, lv)] for lv in LEVELS}
    return F.try_element_at(literal(table, "map<string,array<struct<id:string,primitive:string>>>"), level)


def present(answers: Column) -> Column:
    """The answers of a record; a record without any has an empty list."""
    return F.coalesce(answers, F.array().cast(f"array<{ANSWER_TYPE}>"))


def level_error(level: Column) -> Column:
    """Why a level says nothing about what was asked; null for the known levels."""
    return F.when(~F.coalesce(level.isin(*LEVELS), F.lit(False)), F.concat(
        F.lit("unknown level "), F.coalesce(level, F.lit("(none)"))))


def missing_axes(axes: list[Axis], answers: Column, level: Column) -> Column:
    """Asked axes without a usable answer, in rubric order; null at an unknown level.

    Usable answers are named once per record: a lookup per question would go through the
    answers again for each, and make them again where the optimizer moves their expression in.
    """
    kinds = {k: [a.id for a in axes if a.primitive == k] for k in sorted({a.primitive for a in axes})}
    fits = lambda w: any_true([w["axis"].isin(ids) & well_formed(w, F.lit(k)) for k, ids in kinds.items()])
    usable = F.transform(F.filter(present(answers), lambda w: F.coalesce(fits(w), F.lit(False))), lambda w: w["axis"])
    return F.array_except(F.transform(asked(axes, level), lambda q: q["id"]), usable)


def complete(axes: list[Axis], answers: Column, level: Column) -> Column:
    """True only when the level is known and every question asked at it has a usable answer."""
    return F.coalesce(F.size(missing_axes(axes, answers, level)) == 0, F.lit(False))


def model_error(model: Column, expected: str) -> Column:
    """Null only for the expected model; an unnamed one is unexpected."""
    return F.when(~model.eqNullSafe(F.lit(expected)), F.concat(
        F.lit("unexpected model "), F.coalesce(model, F.lit("(none)"))))


def _spec(axes: list[Axis]) -> Column:
    table = {a.id: {
        "graded": a.use == "graded", "cut": a.cut, "gate": a.gate_axis, "over": a.gate_over,
        "levels": [lv for lv, caps in LEVELS.items() if not a.requires or a.requires in caps],
    } for a in axes}
    return literal(
        table, "map<string,struct<graded:boolean,cut:double,gate:string,over:double,levels:array<string>>>")


def _answer(answers: Column, axis: Column) -> Column:
    return F.try_element_at(F.filter(answers, lambda w: w["axis"] == axis), F.lit(1))


def gate_met(answers: Column, spec: Column, specs: Column, level: Column) -> Column:
    """No gate, or the gate axis is available and reads strictly above it."""
    gate = F.try_element_at(specs, spec["gate"])
    there = F.coalesce(F.array_contains(gate["levels"], level), F.lit(True))
    return spec["gate"].isNull() | (there & F.coalesce(
        reading(_answer(answers, spec["gate"])) > spec["over"], F.lit(False)))


def _signal(name: Column, value: Column) -> Column:
    return F.struct(name.alias("name"), value.cast("double").alias("value"))


def choice_onehot(answer: Column) -> Column:
    """One signal per label: 1 for the first label with the highest probability."""
    top = F.array_position(answer["probs"], F.array_max(answer["probs"])) - 1
    return let(top, lambda t: F.transform(answer["labels"], lambda x, i: _signal(
        F.concat(answer["axis"], F.lit("="), x), (F.get(answer["labels"], t.cast("int")) == x).cast("double"))))


def choice_named(answer: Column) -> Column:
    """The named labels of a graded choice; a label that is not there counts 0."""
    named = literal([{"axis": a, "label": b, "name": c} for a, b, c in NAMED_LABELS],
                    "array<struct<axis:string,label:string,name:string>>")

    def value(n: Column) -> Column:
        at = F.array_position(answer["labels"], n["label"])
        return F.when(at > 0, F.try_element_at(answer["probs"], at.cast("int"))).otherwise(F.lit(0.0))

    return F.transform(F.filter(named, lambda n: n["axis"] == answer["axis"]),
                       lambda n: _signal(n["name"], value(n)))


def signals(axes: list[Axis], answers: Column, level: Column) -> Column:
    """Sparse signals of an item; what is unavailable or gated off is left out."""
    specs = _spec(axes)
    none = F.array().cast("array<struct<name:string,value:double>>")

    def of_answer(w: Column) -> Column:
        def emit(spec: Column) -> Column:
            usable = spec.isNull() | (F.array_contains(spec["levels"], level) & gate_met(answers, spec, specs, level))
            graded = F.coalesce(spec["graded"], F.lit(True))
            choice = F.when(F.coalesce(F.size(w["probs"]), F.lit(0)) <= 0, none).when(
                graded, choice_named(w)).otherwise(choice_onehot(w))
            # bound once per answer: reading a score goes through its legend
            number = let(reading(w), lambda value: F.when(value.isNull(), none).otherwise(F.array(_signal(
                w["axis"], F.when(graded, value).otherwise((value >= spec["cut"]).cast("double"))))))
            return F.when(~usable, none).when(w["type"] == "choice", choice).otherwise(number)

        return let(F.try_element_at(specs, w["axis"]), emit)

    return F.flatten(F.transform(answers, of_answer))


def unavailable_tiers(axes: list[Axis]) -> dict[str, list[str]]:
    """Tiers that read an axis the rubric does not have, with those axes."""
    ids = {a.id for a in axes}
    gaps = {t: [a for a in needs if a not in ids] for t, needs in TIER_AXES.items()}
    return {t: missing for t, missing in gaps.items() if missing}


def rule_text(tier: str, th: dict[str, float]) -> str:
    """Predicate text of a tier with the thresholds in force."""
    both = f"(a5 > {th['transport']}, max(a1, a7) > {th['sensitive']}"
    return {
        "T1": f"transport ∧ sensitive ∧ unknown {both}, a6 argmax = unknown_remote)",
        "T2": f"f5_exceeds_approval > {th['f5_deny']}",
        "T3": f"obfuscated ∧ irreversible (d1 > {th['obfuscated']}, b4/3 > {th['irreversible']})",
        "T4": f"transport ∧ sensitive {both})",
        "T5": f"f5_exceeds_approval > {th['f5_ask']}",
        "T6": "no tier fired",
    }[tier]


def tier(sig: Column, profile: JudgeProfile | None = None, unavailable: tuple[str, ...] = ()) -> Column:
    """First tier that fires in the configured order; an absent signal reads 0."""
    p = profile or JudgeProfile()
    th = p.thresholds

    def first_match(sig: Column, names: Column) -> Column:
        # the first signal of a name; position 0 - 1 is outside of any array
        g = lambda k: F.coalesce(F.get(sig, F.array_position(names, F.lit(k)).cast("int") - 1)["value"], F.lit(0.0))
        f5 = g("f5_exceeds_approval")
        moved = (g("a5_outbound_data") > th["transport"]) & (
            F.greatest(g("a1_reads_credentials"), g("a7_personal_data")) > th["sensitive"])
        fires = {
            "T1": moved & (g("a6_destination_class=unknown_remote") > th["unknown"]),
            "T2": f5 > th["f5_deny"],
            "T3": (g("d1_obfuscated") > th["obfuscated"]) & (g("b4_reversibility") > th["irreversible"]),
            "T4": moved,
            "T5": f5 > th["f5_ask"],
        }
        out = F.lit("T6")
        for t in reversed([t for t in p.tier_order if t in fires and t not in unavailable]):
            out = F.when(fires[t], F.lit(t)).otherwise(out)
        return out

    return let(sig, lambda m: let(F.transform(m, lambda s: s["name"]), lambda names: first_match(m, names)))


def verdict_of(tier_col: Column, profile: JudgeProfile | None = None) -> Column:
    """Verdict of a tier; without a tier, ask."""
    p = profile or JudgeProfile()
    return F.coalesce(F.try_element_at(literal(p.verdicts, "map<string,string>"), tier_col), F.lit("ask"))


def rule_text_of(tier_col: Column, profile: JudgeProfile | None = None) -> Column:
    p = profile or JudgeProfile()
    texts = {t: rule_text(t, p.thresholds) for t in [*TIER_ORDER, "T6"]}
    return F.try_element_at(literal(texts, "map<string,string>"), tier_col)


def calibrate_answer(w: Column, params: Column) -> Column:
    """One answer with its axis parameters applied (``struct<method,a,b,t>``)."""
    def tempered(q: Column) -> Column:
        level = F.aggregate(
            F.arrays_zip(w["labels"].alias("l"), q.alias("p")), F.lit(0.0),
            lambda acc, x: acc + x["l"].try_cast("double") * x["p"])
        best = F.get(w["labels"], (F.array_position(q, F.array_max(q)) - 1).cast("int"))
        return F.struct(
            w["axis"], w["type"], w["noul"],
            F.when(w["type"] == "score", level).otherwise(w["score"]).alias("score"),
            F.when(w["type"] == "choice", best).otherwise(w["choice"]).alias("choice"),
            w["legend"], w["labels"], q.alias("probs")).cast(ANSWER_TYPE)

    # each step is bound: in a loop over answers nothing else keeps it from being computed at every use
    noul = let(clamp(w["noul"], EPS, 1.0 - EPS), lambda q: let(
        params["a"] * F.log(q / (1.0 - q)) + params["b"], lambda x: let(F.exp(-F.abs(x)), lambda e: F.when(
            x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e)))))
    scaled = F.struct(
        w["axis"], w["type"], noul.alias("noul"), w["score"],
        w["choice"], w["legend"], w["labels"], w["probs"]).cast(ANSWER_TYPE)
    return (
        F.when(params.isNull(), w)
        .when(params["method"] == "platt", scaled)
        .otherwise(let(temper(w["probs"], params["t"]), tempered))
    )


def calibration_error(w: Column, params: Column) -> Column:
    """Why the parameters do not fit an answer; null when they do."""
    return (
        F.when(params.isNull(), F.lit(None).cast("string"))
        .when(w["type"] != params["type"], F.concat(
            F.lit("axis "), w["axis"], F.lit(": answer type "), w["type"],
            F.lit(" but the calibration is for "), params["type"]))
        .when((params["method"] == "platt") & w["noul"].isNull(), F.concat(
            F.lit("axis "), w["axis"], F.lit(": noul answer without a value")))
        .when((params["method"] == "temperature") & (F.coalesce(F.size(w["probs"]), F.lit(0)) <= 0), F.concat(
            F.lit("axis "), w["axis"], F.lit(": answer without probabilities")))
    )


def params_column(params: list[dict]) -> Column:
    """Per-axis parameters as a constant map; at most one row per rubric axis."""
    table = {p["axis"]: {k: p.get(k) for k in ("type", "method", "a", "b", "t")} for p in params}
    return literal(table, "map<string,struct<type:string,method:string,a:double,b:double,t:double>>")


def apply_calibration(items: DataFrame, params: list[dict]) -> DataFrame:
    """Calibrate every covered answer; items with a misfit get an error instead."""
    table = params_column(params)
    # bound once per answer: every use of its parameters would look them up again
    under = lambda w, use: let(F.try_element_at(table, w["axis"]), lambda p: use(w, p))
    problem = F.try_element_at(F.array_compact(F.transform(
        "answers", lambda w: under(w, calibration_error))), F.lit(1))
    done = F.filter(F.transform("answers", lambda w: w["axis"]), lambda a: F.map_contains_key(table, a))
    return items.withColumn("calibration_error", problem).withColumns({
        "answers": F.when(F.col("calibration_error").isNull(), F.transform(
            "answers", lambda w: under(w, calibrate_answer))).otherwise(F.col("answers")),
        "calibrated_axes": F.when(F.col("calibration_error").isNull(), F.array_sort(done)),
    })


def evaluate(items: DataFrame, axes: list[Axis], profile: JudgeProfile | None = None,
             params: list[dict] | None = None, pinned_model: str | None = None,
             pinned_rubric: str | None = None) -> DataFrame:
    """Model check, completeness, calibration, signals, tier, verdict; failures ask.

    A record is judged only when all of it is there: an unnamed model, an
    unknown or absent level and absent answers are errors, and errors ask. With
    ``params``, records of another or no rubric fail when they carry a
    ``rubric_hash`` and ``pinned_rubric`` names the one fitted.
    """
    p = profile or JudgeProfile()
    axes = with_gate(axes, GATED_AXIS, p.thresholds["unknown_f5_gate"])
    out = items.withColumn("answers", present(F.col("answers")))
    out = out.withColumn("__missing", missing_axes(axes, F.col("answers"), F.col("level")))
    n = F.size("__missing")
    model_bad = model_error(F.col("model"), p.expected_model)
    incomplete = F.when(n > 0, F.concat(
        F.lit("missing or malformed answers for "), n.cast("string"), F.lit(" question(s): "),
        F.array_join("__missing", ", ")))
    pin = F.lit(None).cast("string")
    if pinned_rubric and params:
        pin = F.when(~F.col("rubric_hash").eqNullSafe(F.lit(pinned_rubric)), F.lit("calibration is pinned to another rubric"))
    if pinned_model:
        pin = F.coalesce(pin, F.when(~F.col("model").eqNullSafe(F.lit(pinned_model)), F.lit("calibration is pinned to another model")))
    if params:
        out = apply_calibration(out, params)
    else:
        out = out.withColumn("calibration_error", F.lit(None).cast("string"))
    out = out.withColumn("error", F.coalesce(
        model_bad, level_error(F.col("level")), incomplete, pin, F.col("calibration_error"), F.when(n.isNull(), F.lit("nothing was asked"))))
    out = out.withColumn("signals", F.when(
        F.col("error").isNull(), signals(axes, F.col("answers"), F.col("level"))))
    gone = tuple(unavailable_tiers(axes))
    out = out.withColumn("tier", F.when(F.col("error").isNull(), tier(F.col("signals"), p, gone)))
    return out.withColumns({
        "tier_rule": rule_text_of(F.col("tier"), p), "verdict": verdict_of(F.col("tier"), p),
    }).drop("__missing", "calibration_error")


def pair_separation(readings: DataFrame) -> DataFrame:
    """Per axis: how many contrastive pairs read strictly higher on the deny side.

    Input: ``pair, side (approve|deny), axis, value``. One grouping, no self-join.
    """
    sides = readings.groupBy("axis", "pair").agg(
        F.max(F.when(F.col("side") == "deny", F.col("value"))).alias("deny"),
        F.max(F.when(F.col("side") == "approve", F.col("value"))).alias("approve"))
    both = sides.filter(F.col("deny").isNotNull() & F.col("approve").isNotNull())
    return both.groupBy("axis").agg(
        F.count("*").alias("pairs"), F.sum((F.col("deny") > F.col("approve")).cast("bigint")).alias("separated"),
        F.min(F.col("deny") > F.col("approve")).alias("all_separated"))


def pair_separation_of_items(items: DataFrame, tasks: int) -> DataFrame:
    """The same from whole items: ``pair, side, readings array<struct<axis, value>>``.

    The items of a pair meet in one of ``tasks`` partitions before their readings
    become rows, so readings are neither shuffled nor grouped before they meet, and a
    task holds the pairs of its own partition only.
    """
    # the outer form: from the inner one a filter is taken that makes the readings again
    met = items.repartition(tasks, "pair").select("pair", "side", F.explode_outer("readings").alias("r"))
    return pair_separation(met.select("pair", "side", "r.axis", "r.value").filter(F.col("value").isNotNull()))


def fingerprint(axes: DataFrame) -> DataFrame:
    """16 hex digits over the fields that define the questions, sorted by id."""
    identity = F.struct("id", "primitive", "direction", "instructions", "criteria", "requires")
    return axes.agg(F.substring(F.sha2(F.to_json(F.array_sort(F.collect_list(identity))), 256), 1, 16).alias(
        "rubric_hash"))


def build_requests(items: DataFrame, axes: list[Axis], model: str) -> DataFrame:
    """One request per item: its state, the model and the questions of its level."""
    questions = {lv: [{
        "id": a.id, "type": a.primitive, "instructions": a.instructions,
        "criteria": [{"label": k, "text": v} for k, v in a.criteria]} for a in axes_at(axes, lv)] for lv in LEVELS}
    table = literal(questions, "map<string,array<struct<id:string,type:string,instructions:string,"
                               "criteria:array<struct<label:string,text:string>>>>>")
    asked_now = F.element_at(table, F.col("level"))
    return items.withColumns({
        "questions_sent": F.transform(asked_now, lambda q: q["id"]),
        "request": F.to_json(F.struct(F.lit(model).alias("model"), F.col("state"), asked_now.alias("questions"))),
    })
