"""Provenance-weighted rule matching.

Every rule becomes a literal regex so that it is compiled once per task. A
literal that each match must contain is tested first: most rules never run
their regex on most texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.catalogs.rules import RULES, TIER_WEIGHT
from shellgauge.functions.text import let, literal
from shellgauge.session import keep

FLAGS = "(?iU)"
_BANK = frozenset(r[5] for r in RULES)


@dataclass(frozen=True)
class Rule:
    """One rule with the confidence in force."""

    ord: int
    rule_id: str
    family: str
    confidence: float
    tier: str
    techniques: tuple[str, ...]
    pattern: str

    def weight(self, weights: dict[str, float]) -> float:
        return weights[self.tier]


def rule_bank(overrides: dict[str, dict] | None = None) -> list[Rule]:
    """Rules in bank order, disabled ones left out and confidences replaced."""
    out = []
    for i, (rid, fam, conf, tier, mitre, pattern) in enumerate(RULES):
        change = (overrides or {}).get(rid, {})
        if change.get("enabled", True):
            out.append(Rule(i, rid, fam, change.get("confidence", conf), tier, tuple(mitre), pattern))
    return out


#: Pieces of a pattern: escapes of several characters, other escapes, classes, repeats, and any other character.
_PIECE = re.compile(
    r"(?s)(?P<long>\\(?:x[0-9A-Fa-f]{2}|x\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|[pP](?:\{[^}]*\}|.)|[kN][<{][^>}]*[>}]|c.|0[0-7]{1,3}|[0-9]+))"
    r"|\\(?P<escape>.)|(?P<class>\[\^?\]?(?:\\.|\[:[^]]*:\]|[^]\\])*\])|(?P<repeat>(?:[*+?]|\{(?P<least>\d+)(?:,\d*)?\})[?+]?)|(?P<other>.)"
)


def required_runs(pattern: str) -> list[str]:
    """ASCII runs, lower case, that every match of a pattern contains; what lies in groups is not looked at."""
    runs, run, depth, last = [], "", 0, False
    if re.search(r"\\Q|\(\?[a-z]*x", pattern):
        return []

    def end(start: str = "") -> None:
        nonlocal run, last
        runs.append(run)
        run, last = start, False

    for m in _PIECE.finditer(pattern):
        other, escape = m["other"], m["escape"]
        if other in ("(", ")"):
            end()
            depth += 1 if other == "(" else -1
        elif depth:
            continue
        elif other == "|":
            return []
        elif m["repeat"]:
            # a character that may be missing is taken back; one that comes again also begins the next run
            kept = run[-1:] if last else ""
            again = m["repeat"][0] == "+" or (m["least"] is not None and int(m["least"]) > 0)
            if last and not again:
                run, kept = run[:-1], ""
            end(kept)
        elif (escape is not None and not escape.isalnum()) or (other is not None and other not in ".^$"):
            char = other or escape
            if ord(char) < 128:
                run, last = run + char.lower(), True
            else:
                end()
        else:
            end()
    end()
    return [r for r in runs if r]


_BLANK = frozenset("\t\n\x0b\x0c\r ")
#: What Java reads in another way than Python, or what only the flag x gives a meaning.
_OTHERWISE = re.compile(r"\\0|\(\?[a-z]*x|\[[^\]]*(?:\[|&&)")


def _is_blank(token: tuple) -> bool:
    """Whether a token of a pattern is one blank, of whatever kind."""
    op, value = token
    if op is sre.LITERAL:
        return chr(value) in _BLANK
    return op is sre.IN and all(
        (o is sre.CATEGORY and v is sre.CATEGORY_SPACE) or (o is sre.LITERAL and chr(v) in _BLANK)
        or (o is sre.RANGE and all(chr(c) in _BLANK for c in range(v[0], min(v[1], 128) + 1)) and v[1] < 128)
        for o, v in value)


def _worth(among: list[str]) -> tuple[int, int]:
    return min(map(len, among)), -len(among)


def _needed(tokens: object) -> list[list[str]]:
    """Lists of literals; every match holds one literal, at least, of each list."""
    found, run = [], ""

    def end(start: str = "") -> None:
        nonlocal run
        if run:
            found.append([run])
        run = start

    def walk(part: object) -> None:
        nonlocal run
        for token in part:
            op, value = token
            if _is_blank(token):
                run += "" if run.endswith(" ") else " "
            elif op is sre.LITERAL and value < 128:
                run += chr(value).lower()
            elif op is sre.SUBPATTERN:
                walk(value[3])
            elif op is sre.ATOMIC_GROUP:
                walk(value)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
                one = value[2][0] if len(value[2]) == 1 else None
                if one and _is_blank(one):
                    run += "" if run.endswith(" ") else " "
                elif one and one[0] is sre.LITERAL and one[1] < 128:
                    run += chr(one[1]).lower()
                    end(run[-1])
                else:
                    end()
                    found.extend(_needed(value[2]))
            elif op is sre.BRANCH:
                end()
                sides = [_needed(side) for side in value[1]]
                if all(sides):
                    found.append(sorted({x for side in sides for x in max(side, key=_worth)}))
            elif op is not sre.AT:
                end()

    walk(tokens)
    end()
    return found


def needed_literals(pattern: str) -> list[list[str]]:
    """Lists of literals, as ``spaced`` writes them; every match holds one literal, at least, of each list.

    Blanks are one space here, so a literal can reach over words; alternatives
    in groups are looked at. What Python cannot read, or reads in another way
    than Java, gives no list.
    """
    if _OTHERWISE.search(pattern):
        return []
    try:
        return _needed(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return []


def spaced(text: Column) -> Column:
    """The folded text with every run of blanks as one space."""
    return F.regexp_replace(folded(text), r"(?U)\s+", " ")


def required_literal(pattern: str) -> str:
    """The longest of the runs that every match of a pattern contains."""
    return max(required_runs(pattern), key=len, default="")


def folded(text: Column) -> Column:
    """Case folding under which a literal test never misses a case-insensitive match.

    Long s and dotless i are named, as the optimizer makes ``lower(upper(x))`` a ``lower(x)``.
    """
    return F.translate(F.lower(text), "\u017f\u0131\u0307", "si")


def engine_pattern(pattern: str) -> str:
    """The pattern as run.

    In the bank's own patterns a closing repeat never gives back, so long texts
    cannot exhaust the stack; their groups match in one way only, so nothing is
    lost. Other patterns run as they are.
    """
    if pattern not in _BANK:
        return FLAGS + pattern
    return FLAGS + re.sub(r"(\)\{\d+,\})$", r"\1+", pattern)


def fires(text: Column, key: Column, rule: Rule) -> Column:
    """Whether one rule matches; ``key`` is the folded text."""
    matched = text.rlike(engine_pattern(rule.pattern))
    literal = required_literal(rule.pattern)
    return (key.contains(literal) & matched) if literal else matched


def fired_ords(text: Column, rules: list[Rule]) -> Column:
    """Bank positions of the rules that match a text."""
    return let(folded(text), lambda key: F.array_compact(F.array(
        *[F.when(fires(text, key, r), F.lit(r.ord)) for r in rules])))


def fired_rules(per_view: Column, rules: list[Rule], weights: dict[str, float] | None = None) -> Column:
    """Fired rules in bank order, each with the first view it matched."""
    w = weights or TIER_WEIGHT
    slots: list[dict | None] = [None] * len(RULES)
    for r in rules:
        slots[r.ord] = {"ord": r.ord, "id": r.rule_id, "tier": r.tier, "conf": r.confidence,
                        "pi": r.weight(w), "family": r.family, "has_techniques": bool(r.techniques)}
    table = literal(slots, "array<struct<ord:int,id:string,tier:string,conf:double,pi:double,"
                           "family:string,has_techniques:boolean>>")

    def describe(o: Column) -> Column:
        first = F.array_position(F.transform(per_view, lambda v: F.array_contains(v, o)), True) - 1
        return let(F.get(table, o), lambda r: F.struct(
            r["ord"].alias("ord"), r["id"].alias("id"), r["tier"].alias("tier"), r["conf"].alias("conf"),
            r["pi"].alias("pi"), r["family"].alias("family"),
            F.bround(r["pi"] * r["conf"], 3).alias("effective"),
            (r["pi"] * r["conf"]).alias("strength"), r["has_techniques"].alias("has_techniques"),
            first.cast("int").alias("view"),
        ))

    ords = F.array_sort(F.array_distinct(F.flatten(per_view)))
    if len(rules) < len(RULES):
        ords = F.filter(ords, lambda o: F.get(table, o).isNotNull())
    return F.transform(ords, describe)


def pattern_score(fired: Column) -> Column:
    """Highest pi times confidence."""
    return F.coalesce(F.array_max(F.transform(fired, lambda f: f["strength"])), F.lit(0.0))


def rule_match(texts: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """One row per text and matching rule."""
    matched = texts.withColumn("__ords", fired_ords(F.col(text), rules))
    return keep(matched, F.size("__ords") > 0).withColumn("ord", F.explode_outer("__ords")).drop("__ords")
