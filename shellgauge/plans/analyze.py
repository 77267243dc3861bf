"""The static pipeline: a table of commands in, scored and decided rows out.

One narrow stage. Views, atoms, hits and fired rules stay arrays on the row of
their command (at most 16 views), so nothing is shuffled, whatever the size or
the skew of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.catalogs.profiles import DEFAULT, Profile, StaticProfile
from shellgauge.functions.text import build_once, let
from shellgauge.operators import canon, paths, patterns, policy, semantic, structure


def dedupe_atoms(l1: Column) -> Column:
    """Atoms over all views with the view they come from; the first of equals stays."""
    listed = F.flatten(F.transform(l1, lambda s, i: F.transform(
        s["atoms"], lambda a: F.struct(a.alias("atom"), i.alias("view")))))
    return let(listed, lambda all_: let(F.transform(all_, lambda x: x["atom"]), lambda names: F.filter(
        all_, lambda x, i: F.array_position(names, x["atom"]) == i + 1)))


@build_once
def _views(command: str) -> Column:
    return canon.views(F.col(command))


@build_once
def _structure(ladder: dict) -> Column:
    return F.transform("views", lambda v: structure.structure(v["text"], ladder))


@build_once
def _atoms(class_base: dict) -> Column:
    return F.transform(dedupe_atoms(F.col("l1")), lambda a: let(
        semantic.classify(a["atom"], class_base), lambda c: F.struct(
            a["atom"].alias("atom"), a["view"].alias("view"), c["class"].alias("class"),
            c["score"].alias("score"), c["reason"].alias("reason"))))


@build_once
def _paths(home: str, scores: dict) -> Column:
    return F.transform("views", lambda v: paths.path_result(v["text"], F.lit(home), scores))


@build_once
def _ords(rules: list[patterns.Rule]) -> Column:
    return F.transform("views", lambda v: patterns.fired_ords(v["text"], rules))


@build_once
def _ords_of_text(text: str) -> Column:
    return patterns.fired_ords(F.col(text), patterns.rule_bank())


@build_once
def _fired(rules: list[patterns.Rule], weights: dict) -> Column:
    return patterns.fired_rules(F.col("__ords"), rules, weights)


def layer_evidence(commands: DataFrame, profile: Profile = DEFAULT, command: str = "command",
                   home: str = "/home/user") -> DataFrame:
    """Views and the evidence of all four layers."""
    s = profile.static
    rules = patterns.rule_bank(s.rules)
    views = commands.withColumn("views", _views(command))
    per_view = views.withColumns({
        "l1": _structure(s.structure), "l3": _paths(home, s.path), "__ords": _ords(rules),
    })
    return per_view.withColumns({
        "atoms": _atoms(s.class_base), "fired": _fired(rules, s.provenance),
    }).drop("__ords")


@build_once
def _score_columns() -> dict[str, Column]:
    l3 = F.col("l3")
    top = F.array_max(F.transform(l3, lambda r: r["score"]))
    first = F.try_element_at(F.filter(l3, lambda r: r["score"] == top), F.lit(1))
    return {
        "scores": F.struct(
            F.col("__sem.score").alias("sem"), F.coalesce(top, F.lit(0.0)).alias("path"),
            patterns.pattern_score(F.col("fired")).alias("pat"),
            F.coalesce(F.array_max(F.transform("l1", lambda x: x["risk"])), F.lit(0.0)).alias("struct"),
        ),
        "max_class": F.col("__sem.max_class"),
        "path_reason": F.when(top > 0, first["reason"]).otherwise(F.lit("paths_ok")),
    }


@build_once
def _semantic() -> Column:
    return semantic.semantic_score(F.col("atoms"))


def layer_scores(evidence: DataFrame) -> DataFrame:
    """Scores per layer from the evidence columns."""
    return evidence.withColumn("__sem", _semantic()).withColumns(_score_columns()).drop("__sem")


@build_once
def _decision_columns(s: StaticProfile, mode: str, command: str) -> list[dict[str, Column]]:
    """Columns of a decision in three steps, each reading the one before."""
    sc = F.col("scores")
    hits = F.flatten(F.transform("l3", lambda r: r["hits"]))
    warn = (F.col("provisional")[mode] == "WARN") & F.col("skip.predicate").isNull()
    return [
        {
            "raw_score": policy.aggregate_score(s.weights, sc["sem"], sc["path"], sc["pat"], sc["struct"]),
            "triggered_layers": policy.triggered_layers(sc),
            "rule_ids": F.transform("fired", lambda f: f["id"]), "spath": paths.p_spath(hits),
        },
        {
            "aggregate": F.bround("raw_score", 4), "provisional": policy.provisional(F.col("raw_score"), s.modes),
            "skip": policy.skip(F.col("fired"), F.col("spath"), F.col("atoms"), sc["path"], s),
        },
        {
            "mode": F.lit(mode), "skip_predicate": F.col("skip.predicate"),
            "skip_predicate_older": F.col("skip.older"), "would_adjudicate": warn,
            "judge_prompt": F.when(warn, policy.judge_prompt(
                F.col(command), F.col("raw_score"), F.col("triggered_layers"), F.col("rule_ids"))),
        },
    ]


def decide(scored: DataFrame, profile: Profile = DEFAULT, mode: str = "balanced",
           command: str = "command", judged: Column | None = None) -> DataFrame:
    """Score, verdicts, skip predicate and decision from evidence and layer scores."""
    out = scored
    for step in _decision_columns(profile.static, mode, command):
        out = out.withColumns(step)
    verdict = judged if judged is not None else F.lit("unadjudicated")
    return out.withColumn("final", policy.final_decision(
        F.col("provisional")[mode], F.col("skip_predicate"), verdict))


@build_once
def _tags(command: str) -> Column:
    l1, atoms, l3 = F.col("l1"), F.col("atoms"), F.col("l3")
    ext = F.flatten(F.transform(l3, lambda r: F.transform(r["hits"], lambda h: h["ext"])))
    mkfs = F.exists("views", lambda v: v["text"].contains("mkfs.")
                    & (F.size(paths.extract_paths(v["text"])) > 0)
                    & paths.access_context(v["text"])["mkfs_fs"])
    runtime = F.array_compact(F.array(
        F.when(F.exists(l1, lambda x: x["has_command_sub"]), F.lit("FIX-005")),
        F.when(F.exists(atoms, lambda a: a["atom"].contains("git") & semantic.is_git_tag_listing(a["atom"])),
               F.lit("FIX-009")),
        F.when(mkfs, F.lit("FIX-010")),
        F.when(F.exists(l1, lambda x: x["control_flow"]), F.lit("FIX-011")),
        F.when(F.exists(l1, lambda x: x["exec_by_path"]), F.lit("FIX-013")),
    ))
    return F.array_sort(F.array_distinct(F.concat(
        F.array_compact(ext), runtime, F.col("skip.tags"), canon.canon_tags(F.col(command), F.col("views")))))


def tags(decided: DataFrame, command: str = "command") -> DataFrame:
    """Sorted FIX and EXT tags each row activated."""
    return decided.withColumn("__tags", _tags(command)).withColumns({
        "fixes_applied": F.filter("__tags", lambda t: t.startswith("FIX")),
        "ext_applied": F.filter("__tags", lambda t: t.startswith("EXT")),
    }).drop("__tags")


def analyze(commands: DataFrame, profile: Profile = DEFAULT, mode: str = "balanced",
            command: str = "command", home: str = "/home/user", judged: Column | None = None) -> DataFrame:
    """Everything the static pipeline says about each command."""
    evidence = layer_scores(layer_evidence(commands, profile, command, home))
    return tags(decide(evidence, profile, mode, command, judged), command)


def under_profiles(commands: DataFrame, profiles: list[Profile], mode: str = "balanced",
                   command: str = "command", home: str = "/home/user") -> DataFrame:
    """Decisions under several profiles in one pass: one struct column per profile name.

    Views, atoms, paths and rule matches are found once. The profiles may differ
    in weights, bands, thresholds and rules, not in class, structure or path scores.
    """
    first = profiles[0].static
    for p in profiles:
        if (p.static.class_base, p.static.structure, p.static.path) != (first.class_base, first.structure, first.path):
            raise ValueError(f"profile {p.name} scores classes, structure or paths differently: analyze it apart")
    views = commands.withColumn("views", _views(command))
    per_view = views.withColumns({
        "l1": _structure(first.structure), "l3": _paths(home, first.path), "__ords": _ords(patterns.rule_bank()),
    })
    out = per_view.withColumn("atoms", _atoms(first.class_base))
    for p in profiles:
        rules = patterns.rule_bank(p.static.rules)
        fired = out.withColumn("fired", _fired(rules, p.static.provenance))
        decided = tags(decide(layer_scores(fired), p, mode, command), command)
        packed = F.struct(
            "provisional.strict", "provisional.balanced", "provisional.auto", "aggregate", "skip_predicate", "final",
            "rule_ids", F.concat("fixes_applied", "ext_applied").alias("tags"))
        out = decided.select(*out.columns, packed.alias(p.name))
    return out.select(*commands.columns, *[p.name for p in profiles])
