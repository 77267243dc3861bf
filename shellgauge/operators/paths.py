"""Path evidence of a view: extracted paths, access context, catalog hits, score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shellgauge.catalogs import paths as cat
from shellgauge.functions.text import (
    any_of, basename, let, literal, split_words, starts_with_any, strip_quotes,
)

# Scores per tier and access.
SCORES = {
    "system_root": 1.0, "critical": 1.0, "secret": 0.85, "sensitive_write": 0.70,
    "sensitive_read": 0.10, "sensitive_ambiguous": 0.35, "traversal_read": 0.3, "traversal": 0.5,
}
# Patterns of the access context.
TOKEN = r"(?U)\"[^\"]+\"|'[^']+'|[^\s\x1c-\x1f]+"
REDIRECT_WRITE = r"(?U)(?:^|[^0-9&])>{1,2}\s*\S"
REDIRECT_TARGET = r"(?U)>{1,2}\s*([^\s;&|]+)"
SED_INPLACE = r"(?U)\bsed\s+[^|;]*-i\b"
SED_SEGMENT = r"(?U)\bsed\s+[^|;]+"
TEE_ANY = r"(?U)\btee\b\s+(-a\s+)?\S"
TEE_TARGET = r"(?U)\btee\b\s+(?:-a\s+)?([^\s|&;]+)"
DEVICE_OVERWRITE = r"(?U)>\s*/dev/(sd|hd|nvme|vd)"

HIT_TYPE = (
    "array<struct<path:string,tier:string,access:string,secret_bearing:boolean,ext:string,"
    "score:double,reason:string,frozen:boolean>>"
)
_NONE = "array<string>"


def _anchored(t: Column) -> Column:
    return starts_with_any(t, ["/", "~", "./"]) | t.contains("../")


def extract_paths(text: Column) -> Column:
    """Path-like tokens in order, then redirect targets."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: strip_quotes(t))

    def path(t: Column) -> Column:
        value = F.when(t.contains("="), t.substr(F.locate("=", t) + 1, F.length(t)))
        option = F.when(value.isNotNull() & _anchored(value), value)
        return F.when(t.startswith("-"), option).otherwise(F.when(_anchored(t), t))

    targets = F.when(text.contains(">"), F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(REDIRECT_TARGET), F.lit(1)), lambda t: strip_quotes(t)
        ), lambda t: _anchored(t))).otherwise(F.array().cast(_NONE))
    return F.concat(F.array_compact(F.transform(tokens, path)), targets)


def expand_home(path: Column, home: Column) -> Column:
    """``~`` and ``~/..`` against a home folder."""
    out = F.concat(F.rtrim(home, F.lit("/")), path.substr(F.lit(2), F.length(path)))
    return F.when(
        (path == "~") | path.startswith("~/"), F.when(out == "", F.lit("/")).otherwise(out)
    ).otherwise(path)


def alias_private(path: Column) -> Column:
    """Real location of ``/private/{etc,var,tmp}``; null when it is not one."""
    return F.when(
        path.rlike(r"\A/private/(?:etc|var|tmp)(?:/|\z)"), path.substr(F.lit(9), F.length(path))
    )


def write_targets(text: Column, home: Column) -> Column:
    """Files written by redirects, ``sed -i`` and ``tee``, as given and expanded."""
    none = F.array().cast(_NONE)
    both = lambda xs: F.concat(xs, F.transform(xs, lambda t: expand_home(t, home)))
    redirects = F.transform(
        F.regexp_extract_all(text, F.lit(REDIRECT_TARGET), F.lit(1)), lambda t: strip_quotes(t)
    )
    sed = F.filter(
        F.transform(split_words(F.regexp_extract(text, SED_SEGMENT, 0)), lambda t: strip_quotes(t)),
        lambda t: starts_with_any(t, ["/", "~"]),
    )
    tee = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(TEE_TARGET), F.lit(1)), lambda t: strip_quotes(t)),
        lambda t: starts_with_any(t, ["/", "~", "./"]),
    )
    return F.concat(
        F.when(text.contains(">"), both(redirects)).otherwise(none),
        F.when(text.contains("sed") & text.rlike(SED_INPLACE), both(sed)).otherwise(none),
        F.when(text.contains("tee"), both(tee)).otherwise(none),
    )


def _head_in(head: Column, heads: list[str]) -> Column:
    return head.isin(heads) | head.startswith("mkfs.")


def access_context(text: Column) -> Column:
    """Head, and whether the view reads, writes or destroys."""
    def context(w: Column) -> Column:
        word = lambda i: basename(F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("")))
        head, second = word(1), word(2)
        acts = lambda heads: _head_in(head, heads) | ((head == "sudo") & _head_in(second, heads))
        writing = (
            acts(cat.WRITE_HEADS)
            | (text.contains(">") & text.rlike(REDIRECT_WRITE))
            | ((head == "sed") & text.rlike(SED_INPLACE))
            | (text.contains("tee") & text.rlike(TEE_ANY))
        )
        destroys = acts(cat.DESTRUCTIVE_HEADS) | (
            (head != "sudo") & text.contains("/dev/") & text.rlike(DEVICE_OVERWRITE)
        )
        return F.struct(
            head.alias("head"), head.isin(cat.READ_HEADS).alias("is_read"), writing.alias("writing"),
            destroys.alias("destructive"),
            (head.startswith("mkfs.") | ((head == "sudo") & second.startswith("mkfs."))).alias("mkfs_fs"),
        )

    return let(split_words(text), context)


def _catalog(entries: list[tuple[str, str | None]]) -> Column:
    return literal(
        [{"prefix": p, "tail": p.lstrip("~"), "ext": e} for p, e in entries],
        "array<struct<prefix:string,tail:string,ext:string>>",
    )


def _hit(p: Column, tier: str, access: Column, secret: Column, ext: Column, score: Column,
         why: Column, frozen: bool = False) -> Column:
    return F.struct(
        p["path"].alias("path"), F.lit(tier).alias("tier"), access.alias("access"),
        secret.alias("secret_bearing"), ext.alias("ext"), score.cast("double").alias("score"),
        F.concat(why, F.lit(":"), p["path"]).alias("reason"), F.lit(frozen).alias("frozen"),
    )


def _hits_of_path(p: Column, ctx: Column, home: Column, scores: dict[str, float]) -> Column:
    """Catalog hits of one path, in catalog order."""
    path, full, access = p["seen"], p["expanded"], p["access"]
    none = F.array().cast(HIT_TYPE)
    no, yes, null = F.lit(False), F.lit(True), F.lit(None).cast("string")
    pick = lambda ext: F.coalesce(ext, p["alias_ext"])
    roots = cat.SYSTEM_ROOTS + cat.SYSTEM_ROOTS_EXT004
    root_ext = F.when(path.isin(cat.SYSTEM_ROOTS_EXT004) | full.isin(cat.SYSTEM_ROOTS_EXT004), F.lit("EXT-004"))
    is_root = ctx["destructive"] & (path.isin(roots) | full.isin(roots))
    root = F.array(_hit(p, "system_root", F.lit("write"), no, pick(root_ext),
                        F.lit(scores["system_root"]), F.lit("destructive_on_system_root"), True))

    which = F.lit(None).cast("int")
    for i, (pattern, _, _) in reversed(list(enumerate(cat.CRITICAL))):
        which = F.when(full.rlike("(?U)" + pattern) | path.rlike("(?U)" + pattern), F.lit(i)).otherwise(which)
    entry = literal(
        [{"secret": s, "ext": e} for _, s, e in cat.CRITICAL], "array<struct<secret:boolean,ext:string>>"
    )
    critical = let(which, lambda i: F.when(i.isNotNull(), F.array(_hit(
        p, "critical", access, F.get(entry, i)["secret"], pick(F.get(entry, i)["ext"]),
        F.lit(scores["critical"]), F.lit("critical_path"), True)).cast(HIT_TYPE)).otherwise(none))

    secret_hits = F.transform(
        F.filter(_catalog(cat.SECRET), lambda e: full.startswith(e["prefix"])
                 | path.startswith(e["prefix"]) | full.contains(e["tail"])),
        lambda e: _hit(p, "secret", access, yes, pick(e["ext"]), F.lit(scores["secret"]), F.lit("secret_path")),
    )
    why = F.concat(F.lit("sensitive_"), access)
    sensitive_score = (
        F.when(access == "write", F.lit(scores["sensitive_write"]))
        .when(access == "read", F.lit(scores["sensitive_read"]))
        .otherwise(F.lit(scores["sensitive_ambiguous"]))
    )
    sensitive_hits = F.transform(
        F.filter(_catalog(cat.SENSITIVE), lambda e: full.startswith(e["prefix"])
                 | path.startswith(e["prefix"])
                 | (e["prefix"].startswith("~") & full.startswith(expand_home(e["prefix"], home)))),
        lambda e: _hit(p, "sensitive_system", access, no, pick(e["ext"]), sensitive_score, why),
    )
    climb = F.when(ctx["is_read"], F.lit(scores["traversal_read"])).otherwise(F.lit(scores["traversal"]))
    traversal = F.when(path.contains("../"), F.array(
        _hit(p, "traversal", access, no, null, climb, F.lit("path_traversal")))).otherwise(none)
    benign = starts_with_any(full, cat.BENIGN_DEVICES) | starts_with_any(path, cat.BENIGN_DEVICES)
    rest = F.concat(
        secret_hits.cast(HIT_TYPE),
        F.when(benign, none).otherwise(F.concat(sensitive_hits.cast(HIT_TYPE), traversal.cast(HIT_TYPE))),
    )
    return F.when(is_root, root.cast(HIT_TYPE)).otherwise(
        let(critical, lambda c: F.when(F.size(c) > 0, c).otherwise(rest))
    )


def path_hits(text: Column, home: Column, scores: dict[str, float] | None = None) -> Column:
    """Catalog hits of every path of a view, in order."""
    values = {**SCORES, **(scores or {})}

    def located(path: Column, ctx: Column, targets: Column) -> Column:
        full = expand_home(path, home)

        def place(e: Column) -> Column:
            a, b = alias_private(path), alias_private(e)
            written = F.array_contains(targets, path) | F.array_contains(targets, e)
            return F.struct(
                path.alias("path"), F.coalesce(a, path).alias("seen"), F.coalesce(b, e).alias("expanded"),
                F.when(a.isNotNull() | b.isNotNull(), F.lit("EXT-002")).alias("alias_ext"),
                F.when(written | (ctx["writing"] & ~ctx["is_read"]), F.lit("write"))
                .when(ctx["is_read"] & ~ctx["writing"], F.lit("read"))
                .otherwise(F.lit("ambiguous")).alias("access"),
            )

        return let(full, place)

    def all_hits(paths: Column) -> Column:
        facts = F.struct(access_context(text).alias("ctx"), write_targets(text, home).alias("targets"))
        hits = let(facts, lambda f: F.flatten(F.transform(paths, lambda p: let(
            located(p, f["ctx"], f["targets"]),
            lambda at: _hits_of_path(at, f["ctx"], home, values)))))
        return F.when(F.size(paths) > 0, hits).otherwise(F.array().cast(HIT_TYPE))

    return F.when(any_of(text, ["/", "~"]), let(extract_paths(text), all_hits)).otherwise(
        F.array().cast(HIT_TYPE)
    )


def path_score(hits: Column) -> Column:
    """Score, reason and triggering paths: the first freezing hit decides, else the maximum."""
    frozen = F.filter(hits, lambda h: h["frozen"])
    frozen_at = F.array_position(F.transform(hits, lambda h: h["frozen"]), True)

    def of_max(top: Column) -> Column:
        best = F.try_element_at(F.filter(hits, lambda h: h["score"] == top), F.lit(1))
        return F.struct(
            F.coalesce(top, F.lit(0.0)).alias("score"),
            F.when(top > 0, best["reason"]).otherwise(F.lit("paths_ok")).alias("reason"),
        )

    first = F.try_element_at(frozen, F.lit(1))
    picked = F.when(F.size(frozen) > 0, F.struct(first["score"].alias("score"), first["reason"].alias("reason")))
    chosen = F.coalesce(picked, let(F.array_max(F.transform(hits, lambda h: h["score"])), of_max))
    counted = F.when(frozen_at > 0, F.slice(hits, F.lit(1), frozen_at.cast("int"))).otherwise(hits)
    return let(chosen, lambda c: F.struct(
        c["score"].alias("score"), c["reason"].alias("reason"),
        F.array_distinct(F.transform(counted, lambda h: h["path"])).alias("triggered"),
    ))


def path_result(text: Column, home: Column, scores: dict[str, float] | None = None) -> Column:
    """Hits and score of one view."""
    return let(path_hits(text, home, scores), lambda h: let(path_score(h), lambda s: F.struct(
        s["score"].alias("score"), s["reason"].alias("reason"), s["triggered"].alias("triggered"),
        h.alias("hits"))))


def p_spath(hits: Column) -> Column:
    """A write to a system, critical or sensitive path, or any touch of a secret one."""
    return F.exists(hits, lambda h: (
        h["tier"].isin("secret", "system_root")
        | ((h["tier"] == "critical") & (h["secret_bearing"] | (h["access"] == "write")))
        | ((h["tier"] == "sensitive_system") & (h["access"] == "write"))
    ))
