"""Lexical structure of a view: flags, nesting depth, risk ladder, simple commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shellgauge.functions.text import (
    BACKTICKED, DOUBLE_QUOTED, MAX_NESTING, SINGLE_QUOTED, SUBSTITUTION, WELL_QUOTED, any_of, let, unquote,
)

# Interpreters a pipeline may end in, and the risk ladder.
INTERPRETERS = """
    bash sh zsh dash ksh csh tcsh eval python python2 python3 perl ruby node lua php
""".split()
LADDER = {
    "pipe_to_exec": 1.0, "eval": 0.9, "nested_substitution": 0.6,
    "command_substitution": 0.30, "pipe": 0.05,
}
# Patterns of the fallback for text a shell would not parse.
FALLBACK_EVAL = r"(?U)\b(eval|source)\b"
FALLBACK_PIPE_EXEC = r"(?U)\|\s*(bash|sh|zsh|dash|eval|python[23]?|perl|ruby|node)\b"
FALLBACK_PIPE_EXEC_PATH = r"(?U)\|\s*[^\s|;&]*/(bash|sh|zsh|dash|eval|python[23]?|perl|ruby|node)\b"

_QUOTED = rf"\\.|{SINGLE_QUOTED}|{DOUBLE_QUOTED}"
_UNIT = rf"{_QUOTED}|{SUBSTITUTION}|{BACKTICKED}"
_SEGMENT = rf"(?s)(?:[^;|&\n'\"\\`$()<>]++|{_UNIT}|\d*[<>]&[-\d]*|&>>?|[$<>]|>\|)++"
_REDIRECT = r"(?:(?<!\S)\d+)?(?:&>>|&>|>>|>\||>&|<<<|<<-?|<&|<>|>|<)(?!\()"
_WORD_UNIT = rf"[^ \t\r\n'\"\\$`<>|&;()]++|{_UNIT}|\$"
_WITHOUT_REDIRECTS = rf"(?s){_REDIRECT}\s*+(?:{_WORD_UNIT})*+|({_UNIT}|[^\\'\"$`<>&\d\s]++|.)"
_ATOM_PIECE = rf"(?s)[^ \t\r\n'\"\\$`<>]++|{_UNIT}|[$<>]"
_ATOM_WORD = rf"(?s)(?:[^ \t\r\n'\"\\$`<>]++|{_UNIT}|[$<>])++"
_CONTROL = r"\A\s*(?:(?:if|then|elif|else|while|until|do|time|!|\{)(?:\s+|\z))++"
_CONTROL_ONLY = r"\A\s*(?:(?:fi|done|esac|\}|else|then|do|;)|(?:for|select|case)\s.*|function\s+\w+\s*\{?)?\s*\z"
_INTERP = "|".join(INTERPRETERS)
_PIPE = r"(?<!\|)\|&?(?!\|)"
_PIPE_END = r"(?![\w.-])(?=[^|;&\n)`]*+(?:\z|[;&\n)`]|\|\|))"


def well_quoted(text: Column) -> Column:
    """No quote is left open."""
    return text.rlike(WELL_QUOTED)


def masked(text: Column) -> Column:
    """Text with quoted parts that hold no substitution replaced by ``Q``."""
    inert = r'"(?:[^"\\$`]++|\\.|\$(?!\())*+"'
    return F.when(
        text.rlike(r"['\"\\]"), F.regexp_replace(text, rf"(?s)\\.|{SINGLE_QUOTED}|{inert}", "Q")
    ).otherwise(text)


def substitution_depth(text: Column) -> Column:
    """Deepest nesting of ``$( )`` and backticks; plain parentheses do not count."""
    marks = F.regexp_extract_all(text, F.lit(r"\$\(|[()`]"), F.lit(0))

    def step(acc: Column, mark: Column) -> Column:
        stack = acc["stack"]
        opened = F.when(stack.contains("T"), F.substring(
            stack, F.lit(1), F.length(stack) - F.locate("T", F.reverse(stack))
        )).otherwise(F.concat(stack, F.lit("T")))
        nxt = (
            F.when(mark == "$(", F.concat(stack, F.lit("S")))
            .when(mark == "(", F.concat(stack, F.lit("P")))
            .when(mark == ")", F.substring(stack, F.lit(1), F.greatest(F.length(stack) - 1, F.lit(0))))
            .otherwise(opened)
        )
        return let(nxt, lambda s: F.struct(
            s.alias("stack"),
            F.greatest(acc["deepest"], F.length(F.replace(s, F.lit("P"), F.lit("")))).alias("deepest"),
        ))

    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("deepest"))
    depth = F.aggregate(marks, start, step, lambda acc: acc["deepest"])
    return F.when(any_of(text, ["$(", "`"]), depth).otherwise(F.lit(0))


def _segments(text: Column) -> Column:
    """Top-level simple commands of a list or pipeline."""
    return F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0))


def _inner(text: Column) -> Column:
    """Bodies of the outermost substitutions; arithmetic is left out."""
    units = F.regexp_extract_all(
        text, F.lit(rf"(?s)\\.|{SINGLE_QUOTED}|{SUBSTITUTION}|{BACKTICKED}"), F.lit(0)
    )
    subs = F.filter(units, lambda u: u.rlike(r"(?s)\A(?:[$<>]\((?!\()|`)"))
    bodies = F.transform(subs, lambda u: F.when(
        u.startswith("`"), u.substr(F.lit(2), F.length(u) - 2)
    ).otherwise(u.substr(F.lit(3), F.length(u) - 3)))
    return F.when(any_of(text, ["$(", "`", "<(", ">("]), bodies).otherwise(
        F.array().cast("array<string>")
    )


def _clean(segment: Column) -> Column:
    """Words of a simple command without redirections and quotes, single spaced."""
    bare = F.regexp_replace(F.regexp_replace(segment, _CONTROL, ""), _WITHOUT_REDIRECTS, "$1")
    words = F.regexp_extract_all(bare, F.lit(_ATOM_WORD), F.lit(0))
    return F.array_join(F.transform(words, lambda w: _unquote_word(w)), " ")


def _unquote_word(word: Column) -> Column:
    return F.when(word.rlike(r"\A(?:[$<>]\(|`)"), word).otherwise(unquote(word, _ATOM_PIECE))


def _atoms(text: Column, level: int) -> Column:
    def of_segment(segment: Column) -> Column:
        own = F.filter(
            F.array(F.when(segment.rlike(_CONTROL_ONLY), F.lit("")).otherwise(_clean(segment))),
            lambda a: a != "",
        )
        if level == 0:
            return own
        nested = F.flatten(F.transform(_inner(segment), lambda body: _atoms(body, level - 1)))
        return F.concat(own, nested)

    return F.flatten(F.transform(_segments(text), of_segment))


def atoms(text: Column) -> Column:
    """Simple commands of a view, inner commands of substitutions included.

    Text with an open quote, or without any command, is one atom.
    """
    found = let(_atoms(text, MAX_NESTING), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(text)))
    return F.when(well_quoted(text), found).otherwise(F.array(text))


def flags(text: Column, atom_list: Column) -> Column:
    """Structure evidence of one view as a struct."""
    def lexical(m: Column) -> Column:
        """Flags of well-quoted text, read off the masked text."""
        piped = m.contains("|")
        exec_plain = piped & m.rlike(rf"{_PIPE}\s*(?:{_INTERP}){_PIPE_END}")
        exec_path = piped & m.rlike(rf"{_PIPE}\s*[^\s|;&()]*/(?:{_INTERP}){_PIPE_END}")
        body = m.rlike(r"(?:\A|[;\n&|]\s*)(?:if|for|while|until|case|select)\s[\s\S]*(?:fi|done|esac)\b")
        return let(F.struct(exec_plain.alias("plain"), exec_path.alias("path")), lambda e: F.struct(
            F.lit(True).alias("parsed"), (piped & m.rlike(_PIPE)).alias("has_pipe"),
            (any_of(m, ["<", ">"]) & m.rlike(r"[<>](?!\()")).alias("has_redirect"),
            m.rlike(r"\$\((?!\()|`|[<>]\(").alias("has_command_sub"),
            F.exists(atom_list, lambda a: a.rlike(r"\A(?:eval|source|\.)(?:\s|\z)")).alias("has_eval"),
            (e["plain"] | e["path"]).alias("has_pipe_to_exec"),
            (e["path"] & ~e["plain"]).alias("exec_by_path"),
            substitution_depth(m).alias("nested_sub_depth"),
            (any_of(m, ["fi", "done", "esac"]) & body).alias("control_flow"),
        ))

    plain = text.rlike(FALLBACK_PIPE_EXEC)
    fallback = F.struct(
        F.lit(False).alias("parsed"), text.contains("|").alias("has_pipe"),
        text.contains(">").alias("has_redirect"), any_of(text, ["$(", "`"]).alias("has_command_sub"),
        text.rlike(FALLBACK_EVAL).alias("has_eval"),
        (plain | text.rlike(FALLBACK_PIPE_EXEC_PATH)).alias("has_pipe_to_exec"),
        (~plain & text.rlike(FALLBACK_PIPE_EXEC_PATH)).alias("exec_by_path"),
        substitution_depth(text).alias("nested_sub_depth"), F.lit(False).alias("control_flow"),
    )
    return F.when(well_quoted(text), let(masked(text), lexical)).otherwise(fallback)


def risk(s: Column, ladder: dict[str, float] | None = None) -> Column:
    """First-match ladder over the flags."""
    p = {**LADDER, **(ladder or {})}
    return (
        F.when(s["has_pipe_to_exec"], F.lit(p["pipe_to_exec"]))
        .when(s["has_eval"], F.lit(p["eval"]))
        .when(s["nested_sub_depth"] >= 2, F.lit(p["nested_substitution"]))
        .when(s["has_command_sub"], F.lit(p["command_substitution"]))
        .when(s["has_pipe"], F.lit(p["pipe"]))
        .otherwise(F.lit(0.0))
    )


_PLAIN = r"[;|&\n'\"\\`$()<>{}!]|\A\s*(?:if|then|elif|else|while|until|do|time|for|select|case|function|fi|done|esac)\b"


def structure(text: Column, ladder: dict[str, float] | None = None) -> Column:
    """Flags, atoms and risk of one view.

    Text without any shell syntax is one command; it takes a short way.
    """
    names = [
        "parsed", "has_pipe", "has_redirect", "has_command_sub", "has_eval", "has_pipe_to_exec",
        "exec_by_path", "nested_sub_depth", "control_flow",
    ]

    def full(atom_list: Column) -> Column:
        return let(flags(text, atom_list), lambda s: F.struct(
            atom_list.alias("atoms"), *[s[n].alias(n) for n in names], risk(s, ladder).alias("risk")))

    def plain(atom: Column) -> Column:
        evaluates = atom.rlike(r"\A(?:eval|source|\.)(?:\s|\z)")
        off = {n: F.lit(False) for n in names}
        given = {**off, "parsed": F.lit(True), "has_eval": evaluates, "nested_sub_depth": F.lit(0)}
        score = F.when(evaluates, F.lit({**LADDER, **(ladder or {})}["eval"])).otherwise(F.lit(0.0))
        return F.struct(F.array(F.when(atom == "", text).otherwise(atom)).alias("atoms"),
                        *[given[n].alias(n) for n in names], score.alias("risk"))

    words = F.array_join(F.filter(F.split(text, r"[ \t\r]+"), lambda w: w != ""), " ")
    return F.when(text.rlike(_PLAIN), let(atoms(text), full)).otherwise(let(words, plain))
