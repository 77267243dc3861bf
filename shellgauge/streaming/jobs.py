"""Streaming forms: scoring, errors, session context, dedupe, running counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shellgauge.catalogs.profiles import DEFAULT, Profile
from shellgauge.operators.projections import command_of, decision_emit, scoreability
from shellgauge.plans.analyze import analyze

CALL_SCHEMA = "tool_use_id string, session_id string, ts timestamp, tool_name string, tool_input string"


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls arriving as JSON lines; each line kept as text so that bad ones can be reported."""
    return spark.readStream.text(path)


def parse_calls(lines: DataFrame) -> DataFrame:
    """Typed calls and, for a line that is not a call, the error with size and digest."""
    parsed = F.from_json("value", CALL_SCHEMA)
    bad = F.try_parse_json("value").isNull() | parsed["tool_name"].isNull()
    return lines.select(
        parsed.alias("c"), F.when(bad, F.lit("payload is not a call")).alias("error"),
        F.octet_length("value").cast("bigint").alias("payload_len"), F.sha2("value", 256).alias("payload_sha256"),
    ).select("c.*", "error", "payload_len", "payload_sha256")


def score_calls(calls: DataFrame, profile: Profile = DEFAULT, mode: str = "balanced") -> DataFrame:
    """One decision record per call; calls that cannot be scored are WARN without a judge."""
    reason = scoreability(F.col("tool_name"), F.col("tool_input"))
    ready = calls.withColumn("unscored_reason", reason).withColumn(
        "command", F.coalesce(F.when(F.col("unscored_reason").isNull(), command_of(F.col("tool_input"))), F.lit("")))
    scored = analyze(ready, profile, mode)
    open_ = F.col("unscored_reason").isNotNull()
    final = F.when(open_, F.lit("unadjudicated")).otherwise(F.col("final"))
    return scored.select(
        "tool_use_id", "session_id", "ts", "tool_name", F.when(~open_, F.col("command")).alias("command"),
        "unscored_reason", F.when(~open_, F.col("aggregate")).alias("aggregate"),
        F.when(open_, F.lit("WARN")).otherwise(F.col("provisional")[mode]).alias("verdict"),
        F.when(~open_, F.col("skip_predicate")).alias("skip_predicate"),
        F.when(~open_, F.col("rule_ids")).alias("rule_ids"),
        final.alias("final"), decision_emit(final).alias("would_emit"))


def stream_score(calls: DataFrame, out: str, checkpoint: str, profile: Profile = DEFAULT) -> StreamingQuery:
    """Score a stream of calls and append the records, one folder per date."""
    records = score_calls(calls, profile).withColumn("event_date", F.to_date("ts"))
    return (records.writeStream.format("parquet").outputMode("append").partitionBy("event_date")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_with_errors(lines: DataFrame, out: str, checkpoint: str, profile: Profile = DEFAULT) -> StreamingQuery:
    """Score good lines, write bad ones as error records, and go on.

    A retried batch overwrites its own folders, so nothing is written twice.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        good = batch.filter(F.col("error").isNull()).drop("error", "payload_len", "payload_sha256")
        bad = batch.filter(F.col("error").isNotNull()).select(
            F.lit("error").alias("kind"), F.lit("parse").alias("stage"), "error", "payload_len", "payload_sha256")
        score_calls(good, profile).write.mode("overwrite").parquet(f"{out}/records/batch={epoch}")
        bad.write.mode("overwrite").parquet(f"{out}/errors/batch={epoch}")
        batch.unpersist()

    return (parse_calls(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_session_context(calls: DataFrame, budget: int = 12000, turn_cost: int = 8) -> DataFrame:
    """Per call, the newest earlier calls of its session that fit the budget.

    ``calls``: ``session_id, tool_use_id, ts, call_text`` with a watermark on
    ``ts``. State holds only turns that can still be kept, so it is bounded by
    the budget; a late call sees the turns known when it arrives.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (turns, total) = state.get if state.exists else ([], 0)
        turns = list(turns)
        # One Arrow batch at a time: a busy session never sits in memory whole.
        for batch in batches:
            out = []
            for row in batch.sort_values(["ts", "tool_use_id"]).itertuples():
                used, kept = 0, []
                for turn in reversed(turns):
                    if kept and used + len(turn) + turn_cost > budget:
                        break
                    used += len(turn) + turn_cost
                    kept.append(turn)
                turns = kept[::-1]
                out.append((key[0], row.tool_use_id, list(turns), total))
                turns.append(row.call_text)
                total += 1
            yield pd.DataFrame(out, columns=["session_id", "tool_use_id", "prior_actions", "actions_total"])
        state.update((turns, total))

    return calls.groupBy("session_id").applyInPandasWithState(
        update, "session_id string, tool_use_id string, prior_actions array<string>, actions_total bigint",
        "turns array<string>, total bigint", "append", GroupStateTimeout.NoTimeout)


def stream_dedupe(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One record per call id within the watermark."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tool_use_id"])


def stream_outcome_counts(records: DataFrame, delay: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Outcomes per window; partial counts are combined before the shuffle."""
    return (records.withWatermark("ts", delay).groupBy(F.window("ts", size), "final", "verdict")
            .agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("window_start"), "final", "verdict", "n"))
