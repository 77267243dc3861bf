"""Weighted score, verdict bands, skip predicates and the final decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shellgauge.catalogs.profiles import MODES, StaticProfile
from shellgauge.functions.text import let

# The class set the older definition of p_sem used.
OLDER_HIGH_RISK = """
    WRITE_SENSITIVE EXECUTION_CHAIN PRIVILEGE_OR_PERMISSION PERSISTENCE DESTRUCTIVE RESOURCE_ABUSE
""".split()
# Layer names.
LAYERS = {"struct": "L1_AST", "sem": "L2_Semantic", "path": "L3_Path", "pat": "L4_Pattern"}


def aggregate_score(w: dict[str, float], sem: Column, path: Column, pat: Column, struct: Column) -> Column:
    """Weighted sum, added left to right."""
    return w["sem"] * sem + w["path"] * path + w["pat"] * pat + w["struct"] * struct


def verdict(score: Column, low: Column | float, high: Column | float) -> Column:
    """ALLOW below the lower bound, WARN below the upper one, else DENY."""
    return F.when(score < low, F.lit("ALLOW")).when(score < high, F.lit("WARN")).otherwise(F.lit("DENY"))


def provisional(score: Column, modes: dict[str, tuple[float, float]]) -> Column:
    """Verdicts of all modes at once."""
    return F.struct(*[verdict(score, *modes[m]).alias(m) for m in MODES])


def triggered_layers(scores: Column) -> Column:
    """Names of the layers that scored."""
    return F.array_compact(F.array(*[
        F.when(scores[k] > 0, F.lit(name)) for k, name in LAYERS.items()]))


def _first(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(1))


def p_rule(fired: Column, theta: float) -> Column:
    """First fired rule of a catalog tier that is strong enough."""
    hit = _first(fired, lambda f: f["tier"].isin("mitre", "gtfobins") & (f["strength"] >= theta))
    return F.when(hit.isNotNull(), F.concat(F.lit("p_rule:"), hit["id"]))


def p_rule_older(fired: Column, theta: float) -> Column:
    """Older definition: confidence alone, on any rule that names a technique."""
    hit = _first(fired, lambda f: ((f["tier"] == "mitre") | f["has_techniques"]) & (f["conf"] >= theta))
    return F.when(hit.isNotNull(), F.concat(F.lit("p_rule:"), hit["id"]))


def p_sem(atoms: Column, classes: list[str], theta: float) -> Column:
    """First atom of a high-risk class that scores enough."""
    if not classes:
        return F.lit(None).cast("string")
    hit = _first(atoms, lambda a: a["class"].isin(classes) & (a["score"] >= theta))
    return F.when(hit.isNotNull(), F.concat(F.lit("p_sem:"), hit["class"]))


def _spath(fires: Column) -> Column:
    return F.when(fires, F.lit("p_spath"))


def skip(fired: Column, spath: Column, atoms: Column, path: Column, profile: StaticProfile) -> Column:
    """Skip predicate in force, the older one, and the tags where they differ."""
    parts = F.struct(
        p_rule(fired, profile.theta_rule).alias("rule"),
        p_rule_older(fired, profile.theta_rule).alias("rule_older"),
        p_sem(atoms, profile.high_risk, profile.theta_sem).alias("sem"),
        p_sem(atoms, OLDER_HIGH_RISK, profile.theta_sem).alias("sem_older"),
    )
    return let(parts, lambda p: F.struct(
        F.coalesce(p["rule"], _spath(spath), p["sem"]).alias("predicate"),
        F.coalesce(p["rule_older"], _spath(path > 0), p["sem_older"]).alias("older"),
        F.array_compact(F.array(
            F.when(~p["rule"].eqNullSafe(p["rule_older"]), F.lit("FIX-001")),
            F.when(spath != (path > 0), F.lit("FIX-002")),
            F.when(~p["sem"].eqNullSafe(p["sem_older"]), F.lit("FIX-003")),
        )).alias("tags"),
    ))


def final_decision(verdict_now: Column, predicate: Column, judged: Column) -> Column:
    """Static verdicts decide; a WARN is denied by a predicate, else judged."""
    return (
        F.when(verdict_now == "ALLOW", F.lit("allow"))
        .when(verdict_now == "DENY", F.lit("deny"))
        .when(predicate.isNotNull(), F.lit("deny"))
        .otherwise(judged)
    )


# The text of the judge prompt, in the pieces between its fields.
PROMPT = (
    "Command:\n```\n",
    "\n```\n\nStatic analyzer flagged this as borderline (WARN).\n  composite risk score: ",
    "\n  triggered layers:    ",
    "\n  fired rule IDs:       ",
    "\n\nIf you cannot confidently classify this as a routine, reversible benign action, "
    "reply DANGEROUS.\n\nReply with exactly one word: SAFE or DANGEROUS.",
)


def _or_none(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ",")).otherwise(F.lit("none"))


def judge_prompt(command: Column, score: Column, layers: Column, rule_ids: Column) -> Column:
    """Prompt text; concatenated, so field names inside the command stay as they are."""
    return F.concat(
        F.lit(PROMPT[0]), command, F.lit(PROMPT[1]), F.bround(score, 4).cast("string"), F.lit(PROMPT[2]),
        _or_none(layers), F.lit(PROMPT[3]), _or_none(rule_ids), F.lit(PROMPT[4]),
    )


def parse_judge_text(answer: Column) -> Column:
    """First word decides; anything but SAFE or DANGEROUS is unparseable."""
    word = F.upper(F.regexp_extract(answer, r"(?U)\A[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)", 1))
    return (
        F.when(word == "SAFE", F.lit("safe")).when(word == "DANGEROUS", F.lit("dangerous"))
        .otherwise(F.lit("unparseable"))
    )


def judge_text_decision(answer: Column) -> Column:
    """Decision from a text judge: only SAFE allows."""
    return F.when(parse_judge_text(answer) == "safe", F.lit("allow")).otherwise(F.lit("deny"))


def judge_text_denies_older(answer: Column) -> Column:
    """Older reading: deny when a bad word occurs anywhere."""
    text = F.upper(F.trim(answer))
    return text.contains("DANGEROUS") | text.contains("UNSAFE")
