"""Replay of logged calls under another profile, and what-if analyses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.catalogs.axes import Axis
from shellgauge.catalogs.profiles import Profile
from shellgauge.functions.text import literal
from shellgauge.operators import policy
from shellgauge.session import checkpoint, small

# Decisions in report order.
OLD = ["allow", "ask", "deny", "none"]
NEW = ["allow", "ask", "deny", "none", "needs_judge"]


def reuse_eligibility(log: DataFrame, rubric_hash: str, host: str, model: str,
                      new_context_overridden: bool = False) -> DataFrame:
    """``reuse_error``: first reason the logged answers cannot be reused; null when they can.

    What a record does not say counts against it: absent answers failed, and an
    absent rubric or backend differs.
    """
    unsaid = lambda c: F.coalesce(c, F.lit("(none)"))
    old_ctx = F.exists(F.coalesce("overrides", F.array().cast("array<string>")), lambda k: k.startswith("judge.context."))
    differs = old_ctx | F.lit(new_context_overridden)
    arrow = lambda a, b: F.concat(a, F.lit("→"), b)
    backend = lambda h, m: F.concat(h, F.lit("/"), m)
    return log.withColumn("context_same", ~differs).withColumn("reuse_error", (
        F.when(F.col("state").isNull(), F.lit("no logged state"))
        .when(~F.coalesce("has_answers", F.lit(False)) | F.col("model").isNull(), F.concat(
            F.lit("the logged judge call failed ("), F.coalesce("judge_error", F.lit("no answers")), F.lit(")")))
        .when(~F.col("judge_rubric_hash").eqNullSafe(F.lit(rubric_hash)), F.concat(
            F.lit("rubric "), arrow(unsaid(F.col("judge_rubric_hash")), F.lit(rubric_hash))))
        .when(~F.col("backend_host").eqNullSafe(F.lit(host)) | ~F.col("expected_model").eqNullSafe(F.lit(model)), F.concat(
            F.lit("backend "), arrow(backend(unsaid(F.col("backend_host")), unsaid(F.col("expected_model"))), F.lit(f"{host}/{model}"))))
        .when(differs, F.lit("context limits may differ"))
    ))


def judge_source(log: DataFrame, offline: bool = True) -> DataFrame:
    """How the judge answer of a replayed call is obtained."""
    logged, err = F.col("state").isNotNull(), F.col("reuse_error")
    named = lambda k, r: F.concat(F.lit(k + " ("), r, F.lit(")"))
    there = F.col("transcript_exists")
    return log.withColumn("judge_source", (
        F.when(logged & err.isNull(), F.lit("answers reused"))
        .when(~logged & F.col("input_truncated"), F.lit("input truncated"))
        .when(~logged & F.lit(offline), F.lit("needs judge (offline; no logged state)"))
        .when(logged & F.lit(offline), named("needs judge", F.concat(F.lit("offline; "), err)))
        .when(logged & (F.col("context_same") | F.col("input_truncated") | ~there), named("logged state resent", err))
        .when(there, named("state rebuilt from transcript", err))
        .otherwise(F.lit("needs judge (no state)"))
    ))


def transition_matrix(results: DataFrame) -> DataFrame:
    """Old to new counts with every row and column, zeros shown."""
    counts = results.groupBy("old").agg(*[F.count_if(F.col("new") == n).alias(n) for n in NEW])
    rows = results.sparkSession.createDataFrame([(i, d) for i, d in enumerate(OLD)], "ord int, old string")
    # Four fixed rows against at most four groups.
    return rows.join(counts, "old", "left").na.fill(0, NEW).select("old", *NEW)


def why_reasons(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Readable reasons why a decision moved.

    Keys: mode, verdict, score, skip, rules, judged, tier, source, note, is_shell.
    """
    arrow = lambda label, a, b: F.concat(F.lit(label + " "), a, F.lit("→"), b)
    text = lambda c, missing="none": F.coalesce(c.cast("string"), F.lit(missing))
    shell = old["is_shell"]
    added, removed = F.array_except(new["rules"], old["rules"]), F.array_except(old["rules"], new["rules"])
    signed = lambda xs, sign: F.array_join(F.transform(F.array_sort(xs), lambda r: F.concat(F.lit(f" {sign}"), r)), "")
    return F.array_compact(F.array(
        F.when(shell & (old["mode"] != new["mode"]), arrow("mode", old["mode"], new["mode"])),
        F.when(shell & ~old["verdict"].eqNullSafe(new["verdict"]), arrow(
            "static", text(old["verdict"], "?"), text(new["verdict"], "?"))),
        F.when(shell & ~old["score"].eqNullSafe(new["score"]), arrow("score", text(old["score"]), text(new["score"]))),
        F.when(shell & ~old["skip"].eqNullSafe(new["skip"]), arrow("skip", text(old["skip"]), text(new["skip"]))),
        F.when(shell & ((F.size(added) > 0) | (F.size(removed) > 0)), F.concat(
            F.lit("rules"), signed(added, "+"), signed(removed, "-"))),
        F.when(~old["judged"] & new["judged"], F.when(shell, F.lit("newly reaches the judge")).otherwise(
            F.lit("now judged (cannot be scored)"))),
        F.when(old["judged"] & ~new["judged"], F.when(shell, F.lit("no longer reaches the judge")).otherwise(
            F.lit("skip_tools: not judged"))),
        F.when(old["judged"] & new["judged"] & ~old["tier"].eqNullSafe(new["tier"])
               & ~F.coalesce(new["source"].startswith("needs judge") | (new["source"] == "input truncated"), F.lit(False)),
               arrow("tier", text(old["tier"], "error"), text(new["tier"], "error"))),
        F.when(new["judged"], new["source"]),
        F.when(old["note"].isNotNull(), F.concat(F.lit("old: "), old["note"])),
    ))


def replay(log: DataFrame, profile: Profile, axes: list[Axis], mode: str = "balanced", offline: bool = True) -> DataFrame:
    """Logged calls under a profile, old and new side by side.

    Shell calls are scored again; calls that cannot be scored go to the judge,
    unless the profile skips their tool. A judge's logged answers are evaluated
    again, so thresholds, tier order, verdicts and gates of the profile count; they
    decide if they can be reused.
    Old columns stay on the row, so the comparison needs no join. Input:
    ``tool_use_id, tool_name, ts, file, line, command, is_shell, old_decision,
    old_note, old_mode, old_verdict, old_score, old_skip, old_rules, old_judged,
    old_tier`` plus the columns of ``reuse_eligibility`` and ``answers, level,
    model`` as logged.
    """
    from shellgauge.operators.answers import evaluate
    from shellgauge.plans.analyze import decide, layer_evidence, layer_scores

    # all logged answers are judged; a tier is shown only where it counts
    judged_again = evaluate(log, axes, profile.judge)
    judged_again = judged_again.withColumn("tier", F.when(F.col("reuse_error").isNull(), F.col("tier")))
    scored = decide(layer_scores(layer_evidence(judged_again.withColumn("command", F.coalesce("command", F.lit(""))), profile)), profile, mode)
    sourced = judge_source(scored, offline)
    shell = F.col("is_shell")
    skipped = F.col("tool_name").isin(*profile.judge.skip_tools) if profile.judge.skip_tools else F.lit(False)
    reached = F.when(shell, F.col("would_adjudicate")).otherwise(~skipped)
    reused = F.col("judge_source") == "answers reused"
    answer = F.when(reused, F.col("verdict")).otherwise(F.lit("needs_judge"))
    static = policy.final_decision(F.col("provisional")[mode], F.col("skip_predicate"), answer)
    out = sourced.withColumns({
        "old": F.col("old_decision"), "new": F.when(shell, static).when(skipped, F.lit("none")).otherwise(answer),
        "new_tier": F.when(reached & reused, F.col("tier")),
        "judge_source": F.when(reached, F.col("judge_source")), "reached": reached,
        "aggregate": F.when(shell, F.col("aggregate")), "skip_predicate": F.when(shell, F.col("skip_predicate")),
        "rule_ids": F.when(shell, F.col("rule_ids")).otherwise(F.array().cast("array<string>")),
    })
    old = {"is_shell": shell, "mode": F.col("old_mode"), "verdict": F.col("old_verdict"),
           "score": F.col("old_score"), "skip": F.col("old_skip"), "rules": F.col("old_rules"),
           "judged": F.col("old_judged"), "tier": F.col("old_tier"), "note": F.col("old_note")}
    new = {"mode": F.col("mode"), "verdict": F.col("provisional")[mode], "score": F.col("aggregate"),
           "skip": F.col("skip_predicate"), "rules": F.col("rule_ids"), "judged": F.col("reached"),
           "tier": F.col("new_tier"), "source": F.col("judge_source")}
    return out.withColumn("changed", F.col("old") != F.col("new")).withColumn("why", why_reasons(old, new))


def changed_calls(results: DataFrame) -> DataFrame:
    """Changed rows in report order; they are stored first, as a sort reads its input twice."""
    return checkpoint(results.filter("changed")).orderBy("ts", "tool_use_id", "file", "line")


def replay_summary(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: lines, replayed, changed, skipped and needs-judge counts by reason."""
    by = lambda df, c: df.groupBy(c).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias("m"))
    counts = results.agg(F.count("*").alias("replayed"), F.count_if("changed").alias("changed"))
    needs = by(results.filter(F.col("judge_source").startswith("needs judge")), "judge_source")
    skips = by(skipped, "reason")
    one = counts.withColumn("k", F.lit(1))
    one = one.join(needs.select(F.lit(1).alias("k"), F.col("m").alias("needs_judge")), "k")
    one = one.join(skips.select(F.lit(1).alias("k"), F.col("m").alias("skipped")), "k")
    total = F.aggregate(F.map_values("skipped"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return one.withColumn("lines", F.col("replayed") + total).drop("k")


def rule_set_diff(old: Column, new: Column) -> Column:
    """Rules added and removed."""
    return F.struct(F.array_sort(F.array_except(new, old)).alias("added"),
                    F.array_sort(F.array_except(old, new)).alias("removed"))


def profile_fingerprint(rows: DataFrame) -> DataFrame:
    """16 hex digits per profile over its sorted key and value pairs (``profile_id, key, value``)."""
    pair = F.concat(F.to_json(F.array("key")), F.lit(":"), F.col("value"))
    return rows.groupBy("profile_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(
        F.collect_list(pair)), ","), 256), 1, 16).alias("fingerprint"))


def profile_overrides(rows: DataFrame, default: DataFrame) -> DataFrame:
    """Keys whose value differs from the default, on either side."""
    base = default.select("key", F.col("value").alias("default_value"))
    out = rows.join(base, "key", "full_outer")
    return out.filter(~F.col("value").eqNullSafe(F.col("default_value"))).select("key", "default_value", "value")


# Type and bounds of the tunable values, by key prefix.
KNOBS: list[tuple[str, str, float | None, float | None, str | None]] = [
    ("static.weights.", "number", 0.0, 1.0, None), ("static.modes.", "number", 0.0, 1.0, None),
    ("static.resolution.theta_", "number", 0.0, 1.0, None), ("static.resolution.high_risk", "classes", None, None, None),
    ("static.provenance.", "number", 0.0, 1.0, None), ("static.class_base.", "number", 0.0, 1.0, None),
    ("static.structure.", "number", 0.0, 1.0, None), ("static.path.", "number", 0.0, 1.0, None),
    ("static.rules.", "number", 0.0, 1.0, None), ("judge.thresholds.", "number", 0.0, 1.0, None),
    ("judge.verdicts.", "enum", None, None, "allow|ask|deny"),
    ("judge.context.field_chars", "count", 1.0, None, None), ("judge.context.history_chars", "count", 1.0, None, None),
    ("judge.context.max_level", "enum", None, None, "L0|L1|L2"), ("judge.tiers.order", "tiers", None, None, None),
    ("judge.skip_tools", "list", None, None, None), ("judge.expected_model", "text", None, None, None),
    ("judge.rubric", "text", None, None, None), ("judge.calibration", "text", None, None, None),
]


def profile_validate(candidate: DataFrame, profile: Profile) -> DataFrame:
    """Check candidate rows ``profile_id, key, value``; a bad value falls back to its default.

    Unknown keys are reported and have no effective value.
    """
    specs, defaults = [], profile.entries()
    for key, value in defaults.items():
        kind = next(k for k in KNOBS if key.startswith(k[0]))
        specs.append((key, *kind[1:], json.dumps(value)))
    spark = candidate.sparkSession
    dim = spark.createDataFrame(specs, "key string, kind string, lo double, hi double, allowed string, default_value string")
    j = candidate.join(small(dim), "key", "left")
    number = F.col("value").try_cast("double")
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    listed = F.from_json("value", "array<string>")
    quoted = F.col("value").startswith('"')
    pair = F.col("key").rlike(r"^static\.modes\.")
    bounds = j.filter(pair).select(
        "profile_id", F.regexp_extract("key", r"modes\.(\w+)\.", 1).alias("mode"),
        F.when(F.col("key").endswith("tau_low"), number).alias("low"),
        F.when(F.col("key").endswith("tau_high"), number).alias("high")).groupBy("profile_id", "mode").agg(
        F.max("low").alias("low"), F.max("high").alias("high"))
    inverted = bounds.filter(F.col("low") >= F.col("high")).select(
        "profile_id", "mode", F.lit(True).alias("inverted"))
    j = j.withColumn("mode", F.when(pair, F.regexp_extract("key", r"modes\.(\w+)\.", 1))).join(
        inverted, ["profile_id", "mode"], "left")
    outside = (number < F.col("lo")) | (F.coalesce(number > F.col("hi"), F.lit(False)))
    problem = (
        F.when(F.col("kind").isNull(), F.lit("unknown key"))
        .when(F.col("kind").isin("number", "count") & (number.isNull() | quoted), F.lit("not a number"))
        .when(F.col("kind").isin("number", "count") & outside, F.lit("out of range"))
        .when((F.col("kind") == "count") & (number != F.floor(number)), F.lit("not a whole number"))
        .when((F.col("kind") == "enum") & ~F.coalesce(
            F.array_contains(F.split("allowed", r"\|"), text), F.lit(False)), F.lit("not one of the allowed values"))
        .when(F.col("kind").isin("classes", "tiers", "list") & listed.isNull(), F.lit("not a list"))
        .when((F.col("kind") == "tiers") & F.exists(listed, lambda t: ~t.rlike("^T[1-5]$")), F.lit("unknown tier"))
        .when((F.col("kind") == "text") & ~quoted, F.lit("not a string"))
        .when(F.col("inverted"), F.lit("tau_low must be below tau_high"))
    )
    checked = j.withColumn("problem", problem)
    return checked.select(
        "profile_id", "key", "value", "problem",
        F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.col("default_value")).alias("effective"))


def score_cells(scored: DataFrame, label: str, high_risk: list[str] | None = None) -> DataFrame:
    """Counts per distinct combination of layer scores, skip strengths and label.

    Layer scores take few values, so this table stays small however many
    commands there are; every what-if reads it instead of the commands.
    """
    from shellgauge.catalogs.profiles import HIGH_RISK

    classes = high_risk or HIGH_RISK
    rule = F.array_max(F.transform(F.filter(
        "fired", lambda f: f["tier"].isin("mitre", "gtfobins")), lambda f: f["strength"]))
    risky = F.array_max(F.transform(F.filter(
        "atoms", lambda a: a["class"].isin(classes)), lambda a: a["score"]))
    from shellgauge.operators.paths import p_spath

    return scored.groupBy(
        F.col(label).alias("label"), F.col("scores.sem").alias("sem"), F.col("scores.path").alias("path"),
        F.col("scores.pat").alias("pat"), F.col("scores.struct").alias("struct"),
        F.coalesce(rule, F.lit(0.0)).alias("rule_strength"), F.coalesce(risky, F.lit(0.0)).alias("risky_score"),
        p_spath(F.flatten(F.transform("l3", lambda r: r["hits"]))).alias("spath"),
    ).agg(F.count("*").alias("n"))


# Provenance tiers in the order of a cell's maxima; the rule predicate reads the catalog tiers only.
TIERS = ["mitre", "gtfobins", "manual"]
CATALOG_TIERS = ["mitre", "gtfobins"]


def tier_cells(scored: DataFrame, label: str, high_risk: list[str] | None = None) -> DataFrame:
    """Score cells that keep the strongest rule of each provenance tier apart.

    From the vector of maxima the pattern score and the rule predicate follow for
    any set of tiers, so no what-if about tiers reads the commands again.
    """
    def strongest(tier: str) -> Column:
        return F.coalesce(F.array_max(F.transform(
            F.filter("fired", lambda f: f["tier"] == tier), lambda f: f["strength"])), F.lit(0.0))

    vector = F.array(*[strongest(t) for t in TIERS])
    marked = scored.withColumn("__cell", F.struct(F.col(label).alias("label"), vector.alias("tiers")))
    return score_cells(marked, "__cell", high_risk).select(
        "label.*", "sem", "path", "struct", "risky_score", "spath", "n").groupBy(
        "label", "tiers", "sem", "path", "struct", "risky_score", "spath").agg(F.sum("n").alias("n"))


def tier_subsets() -> list[dict]:
    """Every set of tiers, named by what it leaves out."""
    out = []
    for mask in range(2 ** len(TIERS)):
        left_out = [t for i, t in enumerate(TIERS) if mask >> i & 1]
        out.append({"left_out": "+".join(left_out) or "none", "kept": [t not in left_out for t in TIERS]})
    return out


def tier_ablation(cells: DataFrame, grid: list[dict], subsets: list[dict]) -> DataFrame:
    """Decisions per set of tiers, profile of a grid and label, from ``tier_cells``."""
    each = cells.withColumn("s", F.explode(literal(subsets, "array<struct<left_out:string,kept:array<boolean>>>")))
    stays = F.zip_with("tiers", F.col("s.kept"), lambda top, kept: F.when(kept, top).otherwise(F.lit(0.0)))
    catalog = [TIERS.index(t) for t in CATALOG_TIERS]
    read = each.withColumn("__stays", stays).select(
        F.struct("label", F.col("s.left_out").alias("left_out")).alias("label"), "sem", "path", "struct", "risky_score", "spath",
        F.array_max("__stays").alias("pat"), F.greatest(*[F.get("__stays", F.lit(i)) for i in catalog]).alias("rule_strength"), "n")
    swept = threshold_sweep(read, grid)
    return swept.select("profile", "label.left_out", F.col("label.label").alias("label"), "decision", "n")


GRID_TYPE = (
    "array<struct<profile:string,sem:double,path:double,pat:double,struct:double,low:double,high:double,"
    "theta_rule:double,theta_sem:double>>"
)


def threshold_sweep(cells: DataFrame, grid: list[dict]) -> DataFrame:
    """Decisions per profile of a grid and label, from the score cells."""
    each = cells.withColumn("g", F.explode(literal(grid, GRID_TYPE)))
    g = F.col("g")
    score = policy.aggregate_score(
        {k: g[k] for k in ("sem", "path", "pat", "struct")}, F.col("sem"), F.col("path"), F.col("pat"), F.col("struct"))
    verdict = policy.verdict(score, g["low"], g["high"])
    skip = (F.col("rule_strength") >= g["theta_rule"]) | F.col("spath") | (F.col("risky_score") >= g["theta_sem"])
    decision = F.when((verdict == "WARN") & skip, F.lit("deny")).when(verdict == "WARN", F.lit("warn")).otherwise(
        F.lower(verdict))
    return each.groupBy(g["profile"].alias("profile"), "label", decision.alias("decision")).agg(
        F.sum("n").alias("n"))


def ablation_grid(weights: dict[str, float], low: float, high: float, theta_rule: float = 0.8,
                  theta_sem: float = 0.7) -> list[dict]:
    """The full profile and one profile per layer whose weight is zero."""
    base = {**weights, "low": low, "high": high, "theta_rule": theta_rule, "theta_sem": theta_sem}
    return [{"profile": "full", **base}] + [{**base, "profile": f"without_{k}", k: 0.0} for k in weights]


def logistic_combiner(scored: DataFrame, features: list[str], label: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Standardised signals combined by a cross-validated logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = scored.select(*features, F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=20)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), lr])
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.1]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
                        numFolds=folds, seed=seed)
    model = cv.fit(data)
    best = model.bestModel.stages[-1]
    rows = [(n, float(c)) for n, c in zip(features, best.coefficients)] + [
        ("intercept", float(best.intercept)), ("auc", float(max(model.avgMetrics)))]
    return scored.sparkSession.createDataFrame(rows, "name string, value double")
