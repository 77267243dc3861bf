"""Sinks: decision log, error records, pairs, calibration parameters, replay report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decision_log(df: DataFrame, path: str, fmt: str = "parquet", ts: str = "ts", files_per_date: int = 0) -> None:
    """Append records under one folder per date.

    By default every task writes the dates it holds, without a shuffle. With
    ``files_per_date`` rows are first spread by date and a hash of the record,
    which bounds the number of files and splits a busy day over several tasks.
    """
    dated = df.withColumn("event_date", F.to_date(ts))
    if files_per_date:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != ts][:1]), F.lit(files_per_date))
        dated = dated.withColumn("__salt", salt).repartition("event_date", "__salt").drop("__salt")
    dated.write.mode("append").partitionBy("event_date").format(fmt).save(path)


def error_records(df: DataFrame, error: str, stage: str) -> DataFrame:
    """Error rows of a job: what failed, where, and a digest of the payload."""
    return df.filter(F.col(error).isNotNull()).select(
        F.lit("error").alias("kind"), F.lit(stage).alias("stage"), F.col(error).alias("error"),
        *[c for c in ("tool_use_id", "ts", "payload_len", "payload_sha256") if c in df.columns])


def pairs(df: DataFrame, path: str) -> None:
    """The pairs a fit used, as JSON lines, for an offline refit."""
    df.select("id", "rubric_hash", "target_model", "reference", "target").write.mode("overwrite").json(path)


def calibration(params: DataFrame, path: str, rubric_hash: str, model: str, source: str) -> None:
    """Per-axis parameters with what they are pinned to."""
    stamped = params.withColumns({
        "format": F.lit("calibration/1"), "rubric_hash": F.lit(rubric_hash), "model": F.lit(model),
        "source": F.lit(source), "fitted_at": F.current_timestamp()})
    # At most one row per rubric axis: one small file.
    stamped.coalesce(1).write.mode("overwrite").json(path)


def replay_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-record rows and the summary, side by side."""
    results.write.mode("overwrite").parquet(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")
