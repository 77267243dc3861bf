"""From transcript records to what a judge sees of every call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.catalogs.profiles import CONTEXT
from shellgauge.functions.text import clip
from shellgauge.operators import context as ctx
from shellgauge.session import checkpoint
from shellgauge.sources import logs

# Turns per rank bucket: a busy session is ranked by many tasks.
BUCKET = 1000
# Milliseconds per bucket of a time line.
TIME_BUCKET = 600_000
# Bounds of a time line: before every line, and after it.
START, END = -(2**62), 2**62


def ranked_calls(records: DataFrame, field_chars: int = ctx.FIELD_CHARS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Calls with their text and their rank in the session.

    Ranking reads its input twice, so the parsed calls are written once first.
    """
    calls = logs.transcript_calls(records, extra)
    texts = checkpoint(calls.withColumn("call_text", ctx.call_text(F.col("name"), F.col("input"), field_chars)))
    return ctx.positions(texts, ["session"], ["seq", "part"], F.floor(F.col("seq") / BUCKET))


def ranked_prompts(records: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Human prompts with their rank in the session, written once like the calls."""
    prompts = checkpoint(logs.transcript_prompts(records, extra))
    return ctx.positions(prompts, ["session"], ["seq", "part"], F.floor(F.col("seq") / BUCKET))


def with_prompt_count(calls: DataFrame, prompts: DataFrame) -> DataFrame:
    """How many prompts precede each call: both share one time line, ranked bucket by bucket."""
    line = calls.withColumn("__kind", F.lit(1)).unionByName(
        prompts.select("session", "seq", F.lit(0).alias("__kind")), allowMissingColumns=True)
    numbered = ctx.running_count(
        line, ["session"], ["seq", "__kind"], F.floor(F.col("seq") / BUCKET), F.col("__kind") == 0, "prior_prompts")
    return numbered.filter(F.col("__kind") == 1).drop("__kind")


def with_request(counted: DataFrame, prompts: DataFrame, budget: int = ctx.FIELD_CHARS) -> DataFrame:
    """Attach to each call the user request as of the last prompt before it.

    The number of prompts so far is the key of an equi-join: no call meets all
    prompts of its session. A prompt with very many calls is a skewed key that
    adaptive execution splits.
    """
    requests = ctx.join_user_request(prompts, "session", "pos", "prompt", budget).select(
        F.struct("session", F.col("pos").alias("n")).alias("__at"), "user_request", "prompts_kept")
    at = F.struct("session", F.col("prior_prompts").alias("n"))
    return counted.withColumn("__at", at).join(requests, "__at", "left").drop("__at")


def call_states(records: DataFrame, limits: dict | None = None) -> DataFrame:
    """Every recorded call with its level, its decoded forms, its state text and hash."""
    lim = {**CONTEXT, **(limits or {})}
    prompts = checkpoint(ranked_prompts(records))
    calls = checkpoint(ranked_calls(records, lim["field_chars"]))
    counted = with_prompt_count(calls, prompts)
    fitted = ctx.fitted_history(counted, "session", "pos", "call_text", lim["history_chars"])
    c = with_request(fitted, prompts, lim["field_chars"]).withColumn(
        "user_request", F.coalesce("user_request", F.lit("")))
    return _with_state(c, F.lit(True), F.lit(True), lim)


def _with_state(c: DataFrame, has_transcript: Column, found_current: Column, lim: dict) -> DataFrame:
    """Level, reason, decoded forms, state text and its hash of calls whose context is attached."""
    shell = F.col("name") == "Bash"
    known = c.withColumns({
        "level": ctx.context_level(has_transcript, F.col("actions_total"), F.col("user_request"), lim["max_level"]),
        "level_reason": ctx.level_reason(has_transcript, found_current, F.col("actions_total"), lim["max_level"]),
        "args": F.when(shell, F.get_json_object("input", "$.command")).otherwise(ctx.sorted_json(F.col("input"))),
        "tool": F.when(shell, F.lit("bash")).otherwise(F.col("name")),
    })
    decoded = known.withColumn("decoded", ctx.decode_payloads(F.col("args")))
    state = ctx.render_state(
        F.col("level"), F.col("tool"), clip(F.col("args"), lim["field_chars"]),
        clip(F.col("user_request"), lim["field_chars"]), F.col("prior_actions"), F.col("decoded"))
    return decoded.withColumn("state", state).withColumn("state_hash", ctx.state_hash(F.col("level"), F.col("state")))


def logged_states(log_calls: DataFrame, records: DataFrame, limits: dict | None = None,
                  time_bucket: int = TIME_BUCKET) -> DataFrame:
    """Logged calls with the state a judge sees, also of calls that their transcript does not hold.

    ``log_calls``: ``call_id, session, tool_use_id, at, name, input``; ``records``
    also have ``at``, the time of their line in the same unit. A call that its
    transcript holds takes what stands before it (its first line, where an id
    repeats). Any other takes the transcript up to the furthest line written
    strictly before its time, all of it where it has no time. Lines without a time are
    context only of what comes after a later line. A null session has no
    transcript, and one without any line cannot be read: both give L0.
    """
    lim = {**CONTEXT, **(limits or {})}
    prompts = checkpoint(ranked_prompts(records, ("at",)))
    calls = checkpoint(ranked_calls(records, lim["field_chars"], ("at",)))
    placed = checkpoint(_placed(log_calls, records, calls, prompts, time_bucket))
    # nothing stands at a place below zero: calls without context are spread over such places, not over one key
    nowhere = -1 - F.pmod(F.xxhash64("call_id"), F.lit(4096))
    place = lambda n: F.when(F.col(n) > 0, F.col(n)).otherwise(nowhere)
    at = lambda pos: F.struct("session", pos.alias("n"))
    wanted = placed.filter("call_pos > 0").select(at(F.col("call_pos")).alias("__at")).distinct()
    marked = calls.withColumn("__at", at(F.col("pos"))).join(wanted.withColumn("__wanted", F.lit(True)), "__at", "left")
    history = ctx.fitted_history(
        marked, "session", "pos", "call_text", lim["history_chars"], after=True, wanted="__wanted"
    ).select("__at", "prior_actions")
    fitted = placed.withColumn("__at", at(place("call_pos"))).join(history, "__at", "left").drop("__at").withColumn(
        "prior_prompts", place("prior_prompts"))
    c = with_request(fitted, prompts, lim["field_chars"]).withColumns({
        "user_request": F.coalesce("user_request", F.lit("")),
        "prior_actions": F.coalesce("prior_actions", F.array().cast("array<string>")),
        "actions_total": F.coalesce("call_pos", F.lit(0)).cast("bigint"),
        "prompts_total": F.greatest("prior_prompts", F.lit(0)).cast("bigint"),
    })
    read = _with_state(c, F.col("has_transcript"), F.col("found_current"), lim)
    # Fixed value: the reason where the file of a session does not exist.
    unread = F.col("session").isNotNull() & ~F.col("has_transcript")
    return read.withColumn("level_reason", F.when(
        unread, F.lit("transcript unreadable: entity not found")).otherwise(F.col("level_reason")))


def _placed(log_calls: DataFrame, records: DataFrame, calls: DataFrame, prompts: DataFrame,
            time_bucket: int) -> DataFrame:
    """Logged calls with the number of recorded calls and prompts before them, null without a transcript."""
    key = F.struct("session", "tool_use_id")
    spots = with_prompt_count(calls.select("session", "seq", "tool_use_id", "pos"), prompts)
    own = spots.filter("tool_use_id is not null").groupBy(key.alias("__own")).agg(
        F.min(F.struct("pos", "prior_prompts")).alias("__spot"))
    asked = log_calls.filter("session is not null").withColumn("__own", key).join(own, "__own", "left").drop("__own")
    line = (
        asked.withColumns({"__at": F.coalesce("at", F.lit(END)), "__kind": F.lit(0),
                           "call_pos": F.lit(None).cast("bigint"), "prior_prompts": F.lit(None).cast("bigint")})
        .unionByName(records.select("session").filter("session is not null").distinct().select(
            "session", F.lit(START).alias("__at"), F.lit(-1).alias("__kind"), F.lit(0).cast("bigint").alias("call_pos"),
            F.lit(0).cast("bigint").alias("prior_prompts")), allowMissingColumns=True)
        .unionByName(calls.filter("at is not null").select(
            "session", F.col("at").alias("__at"), F.lit(1).alias("__kind"), F.col("pos").alias("call_pos")),
            allowMissingColumns=True)
        .unionByName(prompts.filter("at is not null").select(
            "session", F.col("at").alias("__at"), F.lit(1).alias("__kind"), F.col("pos").alias("prior_prompts")),
            allowMissingColumns=True)
    )
    # a call without a time follows every line; one with a time goes before lines of the same time
    seen = ctx.as_of(line, ["session"], ["__at", "__kind"], F.floor(F.col("__at") / time_bucket),
                     ["call_pos", "prior_prompts"]).filter("__kind = 0")
    found = F.col("__spot").isNotNull()
    known = seen.withColumns({
        "has_transcript": F.col("call_pos").isNotNull(), "found_current": found,
        "call_pos": F.when(found, F.col("__spot.pos") - 1).otherwise(F.col("call_pos")),
        "prior_prompts": F.when(found, F.col("__spot.prior_prompts")).otherwise(F.col("prior_prompts")),
    }).drop("__spot", "__at", "__kind")
    none = log_calls.filter("session is null").withColumns({"has_transcript": F.lit(False), "found_current": F.lit(False)})
    return known.unionByName(none, allowMissingColumns=True)
