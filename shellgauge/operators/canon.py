"""Canonicalization: a command becomes up to 16 views (raw, rewritten, decoded).

Everything is a column expression on one row, so a table of commands grows its
views without a shuffle; ``explode_views`` turns them into a child table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.functions.text import any_of, basename, is_blank, let, shell_words, utf8_or_drop

# Bounds of the expansion.
MAX_DEPTH = 3
MAX_VIEWS = 16
MAX_SHELL_BODY = 4000
MAX_COLLAPSE_ROUNDS = 10
SHELLS = "sh bash dash zsh ash ksh".split()

VIEW_TYPE = "struct<kind:string,text:string,depth:int,parent:int,idx:int>"

# Patterns of the in-place rewrites; each is replaced by its groups.
_ARG = r"([A-Za-z0-9_./@:\-]+)"
COLLAPSES: list[tuple[str, str]] = [
    (rf"(?U)`\s*echo\s+{_ARG}\s*`", "$1"),
    (rf"(?U)`\s*printf\s+['\"]{_ARG}['\"]\s*`", "$1"),
    (rf"(?U)\$\(\s*echo\s+{_ARG}\s*\)", "$1"),
    (rf"(?U)\$\(\s*printf\s+[\"']{_ARG}[\"']\s*\)", "$1"),
    (rf"(?U)\$\(\s*printf\s+[\"']%s[\"']\s+{_ARG}\s*\)", "$1"),
    (r"(?U)\$\(\s*printf\s+[\"']%s[\"']\s+(\$\w+)\s*\)", "$1"),
    (rf"(?U)\$\(\s*{_ARG}(?:\"\"|''){_ARG}\s*\)", "$1$2"),
    (rf"{_ARG}(?:\"\"|''){_ARG}", "$1$2"),
    (r"(?U)\$\(\s*\)|``", ""),
]
ASSIGNMENT = (
    r"(?U)(?:^|;|\s|&&|\|\|)\s*([A-Za-z_][A-Za-z0-9_]*)="
    r"(\"[^\"]*\"|'[^']*'|[^\s;|&]+)"
)
PY_B64 = r"base64\.b64decode\(['\"]([A-Za-z0-9+/=]+)['\"]"
B64_FLAG = r"(?U)\bbase64\s+(-d|--decode)\b"
B64_FLAG_BSD = r"(?U)\bbase64\s+-D\b"
B64_RUN = r"[A-Za-z0-9+/]{10,}={0,2}"
B64_RUN_UNPADDED = r"(?U)\b[A-Za-z0-9+/]{12,}={0,2}\b"
B64_STRICT = r"\A(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
PRINTF_HEX = r"(?U)printf\s+['\"]((?:\\x[0-9a-fA-F]{2})++)['\"]"
PRINTF_OCT = r"(?U)printf\s+['\"]((?:\\0[0-7]{2,3}+)++)['\"]"
NOT_PRINTABLE = r"(?U)[\p{Cntrl}\s&&[^ ]]"
NOT_PRINTABLE_TEXT = r"(?U)[\p{Cntrl}\s&&[^ \n\t]]"

# Text without any of these, and without a hidden shell, has nothing to rewrite or decode.
MAY_CHANGE = r"[$`]|\"\"|''|  |base64|b64decode|printf"


def may_run_shell(text: Column) -> Column:
    """Holds for every text that unwraps: the words stand there as they are, or quoting may hide them."""
    return text.contains("-") & text.rlike(r"(?:sh|busybox)\s+-\S*c|['\"\\]")


def may_change(text: Column) -> Column:
    return text.rlike(MAY_CHANGE) | may_run_shell(text)


def expand_ifs(text: Column) -> Column:
    """Turn ``$IFS`` spellings into spaces and squeeze runs of spaces."""
    out = F.regexp_replace(text, r"\$\{IFS(?:[%#][^}]*)?\}", " ")
    out = F.regexp_replace(out, r"(?U)\$IFS\b", " ")
    out = F.regexp_replace(out, r"(?U)\$IFS([A-Za-z_]\w*)", " $1")
    out = F.regexp_replace(out, r"  +", " ")
    return F.when(any_of(text, ["$IFS", "${IFS", "  "]), out).otherwise(text)


def assignments(text: Column) -> Column:
    """``NAME=value`` pairs that may be substituted, newest first."""
    def pair(m: Column) -> Column:
        raw = F.regexp_extract(m, ASSIGNMENT, 2)
        bare = raw.substr(F.lit(2), F.length(raw) - 2)
        value = F.when(raw.rlike("^['\"]"), bare).otherwise(raw)
        return F.struct(F.regexp_extract(m, ASSIGNMENT, 1).alias("name"), value.alias("value"))

    found = F.transform(F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(0)), pair)
    usable = F.filter(
        found, lambda a: (F.length(a["value"]) <= 40) & ~a["value"].rlike(r"[()\[\]<>|&;\\]")
    )
    return F.reverse(usable)


def _substitute(text: Column, assigns: Column, token: str, name: str) -> Column:
    """Replace every variable token of the text at once."""
    def value(tok: Column) -> Column:
        hits = F.filter(assigns, lambda a: a["name"] == F.regexp_extract(tok, name, 1))
        return F.when(
            tok.rlike(name) & (F.size(hits) > 0), F.try_element_at(hits, F.lit(1))["value"]
        ).otherwise(tok)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), value), "")


def expand_variables(text: Column) -> Column:
    """Substitute assigned variables, braced then plain, in two passes."""
    ident = r"[A-Za-z_][A-Za-z0-9_]*"

    def substituted(assigns: Column) -> Column:
        out = text
        for _ in range(2):
            out = _substitute(out, assigns, rf"\$\{{{ident}\}}|[^$]+|\$", rf"\A\$\{{({ident})\}}\z")
            out = _substitute(out, assigns, rf"\${ident}|[^$]+|\$", rf"\A\$({ident})\z")
        return F.when(F.size(assigns) == 0, text).otherwise(out)

    return F.when(text.contains("$") & text.contains("="), let(assignments(text), substituted)).otherwise(text)


def collapse_substitution(text: Column) -> Column:
    """Collapse substitutions that only echo a word, to a fixpoint."""
    trigger = "|".join(f"(?:{p})" for p, _ in COLLAPSES)

    def one_round(out: Column) -> Column:
        nxt = out
        for pattern, repl in COLLAPSES:
            nxt = F.regexp_replace(nxt, pattern, repl)
        return F.when(out.rlike(trigger), nxt).otherwise(out)

    rounds = F.sequence(F.lit(1), F.lit(MAX_COLLAPSE_ROUNDS))
    fixpoint = F.aggregate(rounds, text, lambda acc, _: one_round(acc))
    return F.when(any_of(text, ["$(", "`", '""', "''"]), fixpoint).otherwise(text)


def rewrite(text: Column) -> Column:
    """The in-place rewrite: IFS, then variables, then substitutions."""
    return let(
        expand_ifs(text), lambda a: let(expand_variables(a), lambda b: collapse_substitution(b))
    )


def _typed(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))


_NO_TEXTS = "array<string>"


def decode_base64(text: Column) -> Column:
    """Payloads of ``b64decode('..')`` and of base64 runs near ``base64 -d``."""
    def decoded(tokens: Column) -> Column:
        strict = F.filter(tokens, lambda t: t.rlike(B64_STRICT))
        return F.transform(strict, lambda t: utf8_or_drop(F.unbase64(t)))

    none = F.array().cast(_NO_TEXTS)
    inline = F.filter(
        decoded(F.regexp_extract_all(text, F.lit(PY_B64), F.lit(1))),
        lambda d: ~d.rlike(NOT_PRINTABLE) | d.contains("\n") | d.contains("\t"),
    )
    runs = F.filter(
        F.regexp_extract_all(text, F.lit(B64_RUN), F.lit(0)),
        lambda t: (F.length(t) >= 12) & (F.length(t) % 4 == 0),
    )
    piped = F.filter(decoded(runs), lambda d: (d != "") & ~d.rlike(NOT_PRINTABLE_TEXT))
    return F.concat(
        _typed("py_b64", F.when(text.contains("b64decode"), inline).otherwise(none)),
        _typed(
            "b64_dec",
            F.when(
                text.contains("base64") & (text.rlike(B64_FLAG) | text.rlike(B64_FLAG_BSD)), piped
            ).otherwise(none),
        ),
    )


def decode_hex_octal(text: Column) -> Column:
    """Payloads of ``printf '\\xNN..'`` and ``printf '\\0NNN..'``."""
    none = F.array().cast(_NO_TEXTS)
    hexes = F.transform(
        F.regexp_extract_all(text, F.lit(PRINTF_HEX), F.lit(1)),
        lambda s: utf8_or_drop(F.unhex(F.replace(s, F.lit("\\x"), F.lit("")))),
    )

    def octal(seq: Column) -> Column:
        codes = F.transform(
            F.regexp_extract_all(seq, F.lit(r"\\0([0-7]{2,3})"), F.lit(1)),
            lambda o: F.conv(o, 8, 10).cast("int"),
        )
        fits = ~F.exists(codes, lambda n: n > 255)
        digits = F.array_join(F.transform(codes, lambda n: F.lpad(F.hex(n), 2, "0")), "")
        return F.when(fits, utf8_or_drop(F.unhex(digits)))

    octals = F.transform(F.regexp_extract_all(text, F.lit(PRINTF_OCT), F.lit(1)), octal)
    kept = lambda xs: F.filter(xs, lambda d: d.isNotNull() & (d != ""))
    has = text.contains("printf")
    return F.concat(
        _typed("hex_dec", F.when(has, kept(hexes)).otherwise(none)),
        _typed("oct_dec", F.when(has, kept(octals)).otherwise(none)),
    )


def unwrap_shell_c(text: Column) -> Column:
    """Bodies of ``sh -c '..'`` and ``busybox sh -c '..'``."""
    def flag_c(word: Column) -> Column:
        return word.startswith("-") & word.contains("c")

    def bodies(words: Column) -> Column:
        n = F.size(words)
        at = lambda i: F.coalesce(F.try_element_at(words, i + 1), F.lit(""))

        def step(acc: Column, i: Column) -> Column:
            shell = at(i).isin(SHELLS) & (i + 2 < n) & flag_c(at(i + 1))
            skip = F.when(at(i + 1).isin(SHELLS), F.lit(1)).otherwise(F.lit(0))
            busy = (at(i) == "busybox") & (i + skip + 2 < n) & flag_c(at(i + skip + 1))
            body_at = F.when(shell, i + 2).when(busy, i + skip + 2)
            body = at(body_at)
            keep = (F.length(body) > 0) & (F.length(body) < MAX_SHELL_BODY)
            taken = F.struct(
                (body_at + 1).alias("next"),
                F.when(keep, F.array_append(acc["out"], body)).otherwise(acc["out"]).alias("out"),
            )
            return F.when((i >= acc["next"]) & body_at.isNotNull(), taken).otherwise(acc)

        start = F.struct(F.lit(0).alias("next"), F.array().cast(_NO_TEXTS).alias("out"))
        positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(positions, start, step, lambda acc: acc["out"])

    return _typed(
        "shell_c",
        F.when(may_run_shell(text), let(shell_words(text), bodies)).otherwise(F.array().cast(_NO_TEXTS)),
    )


def decode_all(text: Column) -> Column:
    """All decoders on one text, in a fixed order."""
    return F.concat(decode_base64(text), decode_hex_octal(text), unwrap_shell_c(text))


def _children(view: Column) -> Column:
    """Views derived from one view: its rewrite if that differs, else its decodes."""
    def derive(rw: Column) -> Column:
        rewritten = F.array(
            F.struct(
                F.lit("rewritten").alias("kind"), rw.alias("text"),
                view["depth"].alias("depth"), view["idx"].alias("parent"),
            )
        )
        decoded = F.transform(
            F.filter(decode_all(rw), lambda d: ~is_blank(d["text"])),
            lambda d: F.struct(
                d["kind"].alias("kind"), d["text"].alias("text"),
                (view["depth"] + 1).alias("depth"), view["idx"].alias("parent"),
            ),
        )
        none = F.array().cast("array<struct<kind:string,text:string,depth:int,parent:int>>")
        return (
            F.when(rw != view["text"], rewritten)
            .when(view["depth"] < MAX_DEPTH, decoded)
            .otherwise(none)
        )

    base = F.when(view["kind"] == "rewritten", view["text"]).otherwise(rewrite(view["text"]))
    return let(base, derive)


def views(command: Column) -> Column:
    """The views of a command as an array, breadth first, distinct by text.

    Levels alternate between rewriting and decoding, so ``2 * (depth + 1)``
    rounds reach every view; a round with an empty frontier costs nothing.
    """
    raw = F.struct(
        F.lit("raw").alias("kind"), command.alias("text"), F.lit(0).alias("depth"),
        F.lit(None).cast("int").alias("parent"), F.lit(0).alias("idx"),
    ).cast(VIEW_TYPE)
    start = F.struct(F.array(raw).alias("views"), F.array(raw).alias("frontier"))

    def grow(acc: Column, _: Column) -> Column:
        seen = F.transform(acc["views"], lambda v: v["text"])
        room = F.lit(MAX_VIEWS) - F.size(acc["views"])

        def add(kids: Column) -> Column:
            texts = F.transform(kids, lambda k: k["text"])
            fresh = F.filter(
                kids,
                lambda k, i: ~F.array_contains(seen, k["text"])
                & (F.array_position(texts, k["text"]) == i + 1),
            )
            numbered = F.transform(
                F.slice(fresh, F.lit(1), room),
                lambda k, i: F.struct(
                    k["kind"].alias("kind"), k["text"].alias("text"), k["depth"].alias("depth"),
                    k["parent"].alias("parent"), (F.size(acc["views"]) + i).alias("idx"),
                ).cast(VIEW_TYPE),
            )
            return let(
                numbered,
                lambda new: F.struct(
                    F.concat(acc["views"], new).alias("views"), new.alias("frontier")
                ),
            )

        kids = F.flatten(F.transform(acc["frontier"], _children))
        return F.when((F.size(acc["frontier"]) == 0) | (room <= 0), acc).otherwise(let(kids, add))

    rounds = F.sequence(F.lit(1), F.lit(2 * (MAX_DEPTH + 1)))
    grown = F.aggregate(rounds, start, grow, lambda acc: acc["views"])
    return F.when(may_change(command), grown).otherwise(F.array(raw))


def with_views(commands: DataFrame, command: str = "command") -> DataFrame:
    """Add the ``views`` array to a table of commands."""
    return commands.withColumn("views", views(F.col(command)))


def explode_views(commands: DataFrame, key: str = "cmd_id") -> DataFrame:
    """Child table: one row per view."""
    # Every command has a view; the outer form does not repeat the array in a filter.
    return commands.select(key, F.explode_outer("views").alias("v")).select(
        key, F.col("v.idx").alias("view_idx"), "v.kind", "v.text", "v.depth", "v.parent"
    )


def canon_tags(command: Column, all_views: Column) -> Column:
    """Tags that canonicalization activates on a row."""
    def padded(view: Column) -> Column:
        runs = F.filter(
            F.regexp_extract_all(view["text"], F.lit(B64_RUN), F.lit(0)),
            lambda t: (F.length(t) >= 12) & t.rlike(B64_STRICT),
        )
        known = F.filter(
            F.regexp_extract_all(view["text"], F.lit(B64_RUN_UNPADDED), F.lit(0)),
            lambda t: t.rlike(B64_STRICT),
        )
        return view["text"].rlike(B64_FLAG) & (F.size(F.array_except(runs, known)) > 0)

    has_kind = F.exists(all_views, lambda v: v["kind"] == "b64_dec")
    return F.array_compact(
        F.array(
            F.when(F.size(all_views) > 1, F.lit("FIX-006")),
            F.when(has_kind & F.exists(all_views, padded), F.lit("FIX-007")),
            F.when(
                has_kind & F.exists(
                    all_views, lambda v: v["text"].rlike(B64_FLAG_BSD) & ~v["text"].rlike(B64_FLAG)
                ),
                F.lit("EXT-006"),
            ),
        )
    )


def head_word(text: Column) -> Column:
    """Basename of the first word."""
    return basename(F.coalesce(F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(1)), F.lit("")))
