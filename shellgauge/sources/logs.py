"""Scans of JSON-lines logs, transcripts, corpora, rule files and cached answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellgauge.functions.text import is_blank
from shellgauge.operators.answers import ANSWER_TYPE
from shellgauge.operators.context import human_prompts, tool_uses
from shellgauge.session import small

# Splits whose first rows are broadcast; beyond, they are joined by shuffle.
MAX_SPLITS = 200_000


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line, value``: text lines with their 1-based number in their file.

    Rows of a split carry consecutive ids, so a line's number in its split is its
    distance from the split's first id. Only one row per split is aggregated and
    joined back, with the lines of the splits before it; the text is not moved.
    """
    raw = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"))
    placed = raw.withColumn("__row", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("file", "__block").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    line = F.col("__row") - F.col("__first") + F.col("__before") + 1
    return placed.join(small(splits, MAX_SPLITS), ["file", "__block"]).select("file", line.alias("line"), "value")


def classify_log_line(value: Column, parsed: Column) -> Column:
    """Null for a decision event, else why the line is skipped."""
    kind = F.coalesce(F.try_variant_get(parsed, "$.kind", "string"), F.lit("?"))
    return (
        F.when(parsed.isNull(), F.lit("not JSON"))
        .when(kind != "event", F.concat(F.lit("not an event (kind="), kind, F.lit(")")))
        .when(F.try_variant_get(parsed, "$.tool_name", "string").isNull(), F.lit("no tool_name"))
    )


def scan_event_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line, record, reason``: every non-blank line, skipped ones with a reason."""
    lines = scan_lines(spark, paths).filter(~is_blank(F.col("value")))
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    return parsed.withColumn("reason", classify_log_line(F.col("value"), F.col("record"))).drop("value")


def log_columns(events: DataFrame) -> DataFrame:
    """Typed columns of decision events read by ``scan_event_log``."""
    get = lambda p, t="string": F.try_variant_get("record", f"$.{p}", t)
    return events.filter(F.col("reason").isNull()).select(
        "file", "line", get("ts").alias("ts"), get("tool_name").alias("tool_name"),
        get("tool_use_id").alias("tool_use_id"), get("command").alias("command"),
        F.to_json(F.try_variant_get("record", "$.tool_input", "variant")).alias("tool_input"),
        get("mode").alias("mode"), get("config_fingerprint").alias("config_fingerprint"),
        get("overrides", "array<string>").alias("overrides"), get("rubric_hash").alias("rubric_hash"),
        get("final").alias("final"), get("would_emit").alias("would_emit"), get("aggregate", "double").alias("aggregate"),
        get("provisional", "struct<strict:string,balanced:string,auto:string>").alias("provisional"),
        get("skip_predicate").alias("skip_predicate"),
        F.transform(get("fired_rules", "array<struct<id:string>>"), lambda r: r["id"]).alias("rule_ids"),
        get("would_adjudicate", "boolean").alias("would_adjudicate"), get("unscored", "boolean").alias("unscored"),
        get("judge.state").alias("state"), get("judge.state_hash").alias("state_hash"),
        get("judge.model").alias("model"), get("judge.rubric_hash").alias("judge_rubric_hash"),
        get("judge.backend_host").alias("backend_host"), get("judge.expected_model").alias("expected_model"),
        get("judge.tier").alias("tier"), get("judge.verdict").alias("judge_verdict"),
        get("judge.level").alias("level"), get("judge.latency_ms", "bigint").alias("latency_ms"),
        get("judge.error").alias("judge_error"),
        (F.schema_of_variant(F.try_variant_get("record", "$.judge.answers", "variant")).startswith("OBJECT")).alias("has_answers"),
    )


def scan_transcript(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``session, seq, record, bad``: transcript lines, the session named by its file."""
    lines = scan_lines(spark, paths).filter(~is_blank(F.col("value")))
    return transcript_records(lines.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("session"), F.col("line").alias("seq"), "value"))


def transcript_records(lines: DataFrame) -> DataFrame:
    """Parse transcript lines; torn ones are counted, not fatal."""
    parsed = F.try_parse_json("value")
    return lines.withColumn("record", parsed).withColumn("bad", F.col("record").isNull()).drop("value")


def transcript_prompts(records: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``session, seq, part, prompt``: what the human typed; ``extra`` columns of the line stay."""
    return records.filter(~F.col("bad")).select("session", "seq", *extra, F.posexplode(human_prompts(F.col("record"))).alias("part", "prompt"))


def transcript_calls(records: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``session, seq, part, tool_use_id, name, input``: tool calls in order; ``extra`` columns of the line stay."""
    calls = records.filter(~F.col("bad")).select(
        "session", "seq", *extra, F.posexplode(tool_uses(F.col("record"))).alias("part", "u"))
    return calls.select("session", "seq", *extra, "part", F.col("u.id").alias("tool_use_id"), "u.name", "u.input")


def answers_column(value: Column) -> Column:
    """Answers of a JSON object ``{axis: {type, ..}}`` as an array, labels in wire order."""
    entry = "struct<type:string,noul:double,score:double,choice:string,legend:string,probabilities:string>"
    wire = F.from_json(value, f"map<string,{entry}>")
    return F.transform(F.map_entries(wire), lambda e: F.struct(
        e["key"].alias("axis"), e["value"]["type"].alias("type"), e["value"]["noul"].alias("noul"),
        e["value"]["score"].alias("score"), e["value"]["choice"].alias("choice"),
        F.json_object_keys(e["value"]["legend"]).alias("legend"),
        F.json_object_keys(e["value"]["probabilities"]).alias("labels"),
        F.map_values(F.from_json(e["value"]["probabilities"], "map<string,double>")).alias("probs"),
    ).cast(ANSWER_TYPE))


def scan_reference_items(lines: DataFrame, rubric_hash: str, model: str) -> DataFrame:
    """Classify mixed input lines (``n, value``) into pairs, run rows and log records, or a skip reason."""
    v = F.try_parse_json("value")
    get = lambda p, t="string": F.try_variant_get(v, f"$.{p}", t)
    has = lambda p: F.variant_get(v, f"$.{p}", "variant").isNotNull()
    null = F.lit(None).cast("string")
    failed = lambda p: has(p) & (F.schema_of_variant(F.variant_get(v, f"$.{p}", "variant")) != "VOID")
    pair, run, record = has("reference") & has("target"), has("state_rendered"), has("judge.state")
    shape = F.when(pair, F.lit("pair")).when(run, F.lit("run")).when(record, F.lit("record"))
    j = lambda p: F.when(run, get(p)).otherwise(get(f"judge.{p}"))
    rh = F.when(pair, get("rubric_hash")).otherwise(j("rubric_hash"))
    prefix = F.when(pair, F.lit("pair-")).when(run, F.lit("row-")).otherwise(F.lit("record-"))
    answers = F.when(run, get("answers")).otherwise(get("judge.answers"))
    reason = (
        F.when(v.isNull(), F.lit("not JSON"))
        .when(shape.isNull(), F.lit("not a pair, run row or judge record"))
        .when(run & failed("error"), F.lit("run row: judge error"))
        .when(record & ~run & ~pair & failed("judge.error"), F.lit("log record: judge call failed"))
        .when(~pair & ~j("model").eqNullSafe(F.lit(model)), F.lit(f"reference is not {model}"))
        .when(rh != rubric_hash, F.concat(F.lit("rubric_hash "), rh, F.lit(f" (not {rubric_hash})")))
        .when(~pair & answers.isNull(), F.lit("no answers"))
    )
    out = lines.select("n", "value", shape.alias("shape"), reason.alias("reason"),
                       F.coalesce(get("id"), get("item_id"), get("tool_use_id"), F.concat(prefix, F.col("n").cast("string"))).alias("item_id"),
                       F.coalesce(get("state"), get("state_rendered"), get("judge.state")).alias("state"),
                       F.when(pair, get("reference")).otherwise(answers).alias("reference"),
                       F.when(pair, get("target")).alias("target"),
                       F.when(pair, F.coalesce(get("target_model"), F.lit(""))).otherwise(null).alias("target_model"))
    return out.drop("value")


def scan_command_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``command`` lines; comments and blanks dropped, ``json:`` lines unescaped."""
    return corpus_commands(spark.read.text(path))


def corpus_commands(lines: DataFrame) -> DataFrame:
    value = F.col("value")
    text = F.get_json_object(F.concat(F.lit('{"v":'), value.substr(F.lit(6), F.length(value)), F.lit("}")), "$.v")
    return lines.filter(~is_blank(value) & ~value.startswith("#")).select(
        F.when(value.startswith("json:"), text).otherwise(value).alias("command"))


def scan_rule_bank(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file ``{_meta, rules[]}``; raises when the count differs from the header."""
    schema = (
        "_meta struct<version:string,date:string,total_rules:int>, rules array<struct<rule_id:string,"
        "description:string,failure_family:string,mitre_techniques:array<string>,confidence:double,"
        "provenance_tier:string,pattern_regex:string>>")
    doc = spark.read.schema(schema).json(path, multiLine=True)
    checked = doc.withColumn("ok", F.when(
        F.size("rules") == F.col("_meta.total_rules"), F.lit(True)).otherwise(
        F.raise_error(F.lit("total_rules does not match the number of rules")).cast("boolean")))
    return checked.filter("ok").select(
        F.concat_ws("+", "_meta.version", "_meta.date").alias("rules_version"), F.posexplode("rules").alias("ord", "r")).select(
        "rules_version", "ord", "r.*")


def scan_answer_cache(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Cached answers ``{model}/{rubric_hash}/{state_hash}.json``; failed or older entries dropped."""
    doc = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    part = lambda i: F.element_at(F.split(F.regexp_replace("file", r"\.json$", ""), "/"), -i)
    get = lambda p, t="string": F.try_variant_get(F.try_parse_json("value"), f"$.{p}", t)
    rows = doc.select(part(3).alias("model_dir"), part(2).alias("rubric_hash"), part(1).alias("state_hash"),
                      get("model").alias("model"), get("error").alias("error"),
                      get("cache_version", "int").alias("cache_version"),
                      answers_column(F.get_json_object("value", "$.answers")).alias("answers"))
    return rows.filter(F.col("error").isNull() & (F.coalesce("cache_version", F.lit(version)) == version))
