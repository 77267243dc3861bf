"""Column helpers for text: binding, word splitting, quoting, clipping.

All of them are built-in expressions, so they work on plain columns and inside
higher-order functions alike and never leave the JVM.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

T = TypeVar("T")

# Unicode whitespace plus the four ASCII separators U+001C..U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"

# Nested substitutions are read this deep.
MAX_NESTING = 8


def balanced(levels: int) -> str:
    """Text with balanced parentheses, this many levels of them, without backtracking."""
    inside = r"[^()]*+"
    for _ in range(levels):
        inside = rf"(?:[^()]++|\({inside}\))*+"
    return inside


PARENS = balanced(MAX_NESTING + 1)

SINGLE_QUOTED = r"'[^']*+'"
DOUBLE_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
BACKTICKED = r"`[^`]*+`"
SUBSTITUTION = rf"[$<>]\({PARENS}\)"

# One piece of a POSIX shell word, and a whole word. Possessive throughout, so
# long texts neither backtrack nor recurse.
_PIECE = rf"[^ \t\r\n'\"\\]++|\\.|{SINGLE_QUOTED}|{DOUBLE_QUOTED}"
WORD_PIECE = rf"(?s){_PIECE}"
WORD = rf"(?s)(?:{_PIECE})++"
WELL_QUOTED = rf"(?s)\A(?:[ \t\r\n]++|{_PIECE})*+\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def build_once(build: Callable[..., T]) -> Callable[..., T]:
    """Keep the columns a function builds: a long expression is described once per context."""
    kept: dict[tuple, T] = {}

    @functools.wraps(build)
    def cached(*args: object) -> T:
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, repr(args))
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return cached


def literal(value: object, schema: str) -> Column:
    """A small fixed table as one constant column."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def any_of(text: Column, needles: list[str]) -> Column:
    """True when the text contains one of the literals."""
    if len(needles) == 1:
        return text.contains(needles[0])
    return F.exists(literal(needles, "array<string>"), lambda n: text.contains(n))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    """True when the text starts with one of the literals."""
    return F.exists(literal(prefixes, "array<string>"), lambda p: text.startswith(p))


def split_words(text: Column) -> Column:
    """Split on runs of whitespace, without empty words."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Trim whitespace on both sides."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """Only whitespace, or empty."""
    return text.rlike(rf"\A{SPACE}*\z")


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def strip_quotes(token: Column) -> Column:
    """Trim quote characters on both sides."""
    return F.btrim(token, F.lit("\"'"))


def unquote(word: Column, piece: str = WORD_PIECE) -> Column:
    """Remove shell quoting from one word."""
    def plain(p: Column) -> Column:
        inner = p.substr(F.lit(2), F.length(p) - 2)
        return (
            F.when(p.startswith("'"), inner)
            .when(p.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(p.startswith("\\"), p.substr(F.lit(2), F.lit(1)))
            .otherwise(p)
        )

    quoted = word.rlike(r"['\"\\]")
    pieces = F.regexp_extract_all(word, F.lit(piece), F.lit(0))
    return F.when(quoted, F.array_join(F.transform(pieces, plain), "")).otherwise(word)


def shell_words(text: Column) -> Column:
    """POSIX word split with quotes removed; an empty array when a quote is open."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(text.rlike(WELL_QUOTED), F.transform(words, lambda w: unquote(w))).otherwise(
        F.array().cast("array<string>")
    )


def clip(text: Column, limit: int) -> Column:
    """First ``limit`` code points plus a note of how many were cut."""
    note = F.concat(
        F.lit("\n[... truncated, "), (F.length(text) - limit).cast("string"), F.lit(" more characters]")
    )
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), note))


def clip_line(text: Column, limit: int) -> Column:
    """First line, at most ``limit`` characters, with an ellipsis when cut."""
    first = F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", "")
    cut = (F.length(first) > limit) | (F.length(first) < F.length(text))
    return F.concat(F.substring(first, 1, limit), F.when(cut, F.lit("…")).otherwise(F.lit("")))


def utf8_or_drop(data: Column) -> Column:
    """Decode bytes as UTF-8 and drop what is not valid."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))
