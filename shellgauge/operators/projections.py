"""Row-wise projections over calls and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.functions.text import clip_line, is_blank

# What older records mean when a field is absent, label keys, limits.
LEGACY_HOST = "judge.invalid"
LEGACY_MODEL = "judge-1"
TARGET_KEYS = "file_path path url query pattern command notebook_path description prompt skill".split()
MAX_FIELD_BYTES = 4096
LABEL_CHARS = 60


def scoreability(tool: Column, tool_input: Column) -> Column:
    """Null when a call can be scored, else the reason it cannot."""
    v = F.try_parse_json(tool_input)
    kind = F.schema_of_variant(F.variant_get(v, "$.command", "variant"))
    return (
        F.when(tool != "Bash", F.lit("non-shell tool"))
        .when(kind.isNull() | (kind == "VOID"), F.lit("missing command"))
        .when(kind != "STRING", F.lit("command is not a string"))
        .when(is_blank(F.try_variant_get(v, "$.command", "string")), F.lit("empty command"))
    )


def command_of(tool_input: Column) -> Column:
    return F.get_json_object(tool_input, "$.command")


def skips(tool: Column, reason: Column, skip_tools: list[str]) -> Column:
    """An unscorable call of a listed tool passes through unjudged."""
    return reason.isNotNull() & tool.isin(skip_tools) if skip_tools else F.lit(False)


def payload_rebuild(tool: Column, command: Column, tool_input: Column) -> Column:
    """The input a record was logged from."""
    return F.when((tool == "Bash") & command.isNotNull(), F.to_json(F.struct(command.alias("command")))).otherwise(
        tool_input)


def field_truncate(text: Column, limit: int = MAX_FIELD_BYTES) -> Column:
    """``struct<value, truncated, len, sha256>``: long strings keep a prefix on a character boundary."""
    data = F.encode(text, "UTF-8")
    # A cut inside a character leaves invalid bytes at the end; they are dropped.
    head = F.regexp_replace(F.make_valid_utf8(F.substring(data, 1, limit).cast("string")), "�+\\z", "")
    long = F.octet_length(text) > limit
    return F.struct(
        F.when(~long, text).alias("value"), F.when(long, head).alias("truncated"),
        F.when(long, F.octet_length(text).cast("bigint")).alias("len"),
        F.when(long, F.sha2(data, 256)).alias("sha256"))


def truncate_object(tool_input: Column, limit: int = MAX_FIELD_BYTES) -> Column:
    """Every long string of a JSON value, at any depth, replaced by a truncation marker, as JSON.

    The canonical text is cut into strings, keys with their colon, and the rest,
    so nesting needs no recursion. Keys stay whole.
    """
    text = F.to_json(F.try_parse_json(tool_input))
    parts = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*:)?|[^"]++'), F.lit(0))

    def short(part: Column) -> Column:
        cut = field_truncate(F.try_variant_get(F.parse_json(part), "$", "string"), limit)
        marker = F.to_json(F.struct(
            cut["truncated"].alias("truncated"), cut["len"].alias("len"), cut["sha256"].alias("sha256")))
        is_string = part.startswith('"') & part.endswith('"') & (F.octet_length(part) > limit + 2)
        return F.when(is_string & cut["len"].isNotNull(), marker).otherwise(part)

    return F.array_join(F.transform(parts, short), "")


def is_truncated(value: Column) -> Column:
    """Some nested object is a truncation marker."""
    marker = r'\{"(?:truncated":"(?:[^"\\]|\\.)*+","len":\d+,"sha256":"[0-9a-f]{64}"|' \
             r'len":\d+,"sha256":"[0-9a-f]{64}","truncated":"(?:[^"\\]|\\.)*+")\}'
    return F.coalesce(F.to_json(F.try_parse_json(value)).rlike(marker), F.lit(False))


def target_label(tool: Column, command: Column, tool_input: Column) -> Column:
    """Short label of a call: its command, or the first known input field."""
    fields = []
    for key in TARGET_KEYS:
        raw = F.get_json_object(tool_input, f"$.{key}")
        cut = F.get_json_object(tool_input, f"$.{key}.truncated")
        fields.append(F.coalesce(cut, raw))
    label = F.coalesce(*fields, F.lit(""))
    return clip_line(F.when((tool == "Bash") & command.isNotNull(), command).otherwise(label), LABEL_CHARS)


def old_decision(final: Column, tool: Column, has_unscored: Column, has_fingerprint: Column) -> Column:
    """``struct<decision, note>`` of a logged record, older shapes included."""
    unscored_shape = (tool != "Bash") & ~has_unscored
    note = (
        F.when(final == "unadjudicated", F.lit("stub-era 'unadjudicated', counted as ask"))
        .when(final.isin("allow", "ask", "deny"), F.lit(None).cast("string"))
        .when(final.isNotNull(), F.concat(F.lit("unknown final "), final))
        .when(unscored_shape & has_fingerprint, F.lit("no decision logged (pass-through)"))
        .when(unscored_shape, F.lit("older record: logged raw, no decision"))
        .otherwise(F.lit("no final in the record (older version)"))
    )
    return F.struct(decision_of(final).alias("decision"), note.alias("note"))


def decision_of(final: Column) -> Column:
    """Final value as a compared decision."""
    return (
        F.when(final.isin("allow", "deny", "ask"), final)
        .when(final == "unadjudicated", F.lit("ask")).otherwise(F.lit("none"))
    )


def legacy_defaults(log: DataFrame) -> DataFrame:
    """Fill what records written before a field existed were judged with."""
    return log.withColumns({
        "backend_host": F.coalesce("backend_host", F.lit(LEGACY_HOST)),
        "expected_model": F.coalesce("expected_model", F.lit(LEGACY_MODEL)),
    })


def decision_emit(final: Column, decide_all: bool = True) -> Column:
    """What enforcing would print: allow only when deciding everything."""
    allow = F.lit("allow") if decide_all else F.lit(None).cast("string")
    return (
        F.when(final == "allow", allow).when(final.isin("deny", "ask"), final)
        .when(final == "unadjudicated", F.lit("ask"))
    )


def emit_reason(final: Column, score: Column, verdict: Column, skip: Column, rule_ids: Column) -> Column:
    """The sentence that goes with a decision."""
    rules = F.when(F.size(rule_ids) > 0, F.array_join(rule_ids, ",")).otherwise(F.lit("none"))
    s = score.cast("string")
    return (
        F.when(final == "allow", F.concat(F.lit("ALLOW, score "), s, F.lit(" ["), verdict, F.lit("], rules "), rules))
        .when(final == "ask", F.concat(F.lit("WARN, score "), s, F.lit(", judge failed; rules "), rules))
        .when(final == "deny", F.concat(
            F.lit("DENY, score "), s, F.lit(" ["), verdict, F.lit("], skip "), F.coalesce(skip, F.lit("none")),
            F.lit(", rules "), rules))
        .otherwise(F.concat(F.lit("WARN, score "), s, F.lit(", no judge configured; rules "), rules))
    )


def payload_keys(payload: Column) -> Column:
    """Top-level keys of a payload."""
    return F.json_object_keys(payload)


def lineage_stamp(df: DataFrame, stamp: dict[str, object]) -> DataFrame:
    """Stamp every row with what produced it."""
    return df.withColumns({k: F.lit(v) for k, v in stamp.items()})


def backend_host(url: Column) -> Column:
    """host[:port] of a URL, without scheme, user info or path."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^@/?#]*@)?([^/?#]*)", 1)
